import pytest

from tidewatch.session import build_session, prepare


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()
