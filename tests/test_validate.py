import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import validate as V


def records(spark, texts):
    rows = [(i, base64.b64encode(t.encode()).decode()) for i, t in enumerate(texts)]
    return V.decode_records(spark.createDataFrame(rows, "event_id LONG, data STRING"))


@pytest.mark.parametrize(("text", "valid", "errors"), [
    ('{"event_type":"session_started","payload":{}}', True, []),
    ('{"payload":{}}', False, ["event_type:critical"]),
    ('{"event_type":"x","payload":{}}', False, ["event_type:error"]),
    ('{"event_type":"session_started"}', False, ["payload:critical"]),
    ('{"event_type":"session_started","payload":[]}', True, []),
    ('{"event_type":"session_started","payload":null}', False, ["payload:critical"]),
    ('{"event_type":"session_started","payload":"text"}', False, ["payload:critical"]),
    ('{"event_type":0,"payload":{}}', False, ["event_type:critical"]),
    ('{"event_type":7,"payload":{}}', False, ["event_type:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":{"iops":-1}}', False, ["metrics.iops:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":{"iops":null}}', False, ["metrics.iops:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":{"iops":0,"latency":0.5,"errorRate":100}}', True, []),
    ('{"event_type":"session_started","payload":{},"metrics":{"latency":"1"}}', False, ["metrics.latency:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":{"errorRate":100.5}}', False, ["metrics.errorRate:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":{"errorRate":1e9}}', False, ["metrics.errorRate:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":"m"}', False, ["metrics:error"]),
    ('{"event_type":"session_started","payload":{},"metrics":0}', True, []),
    ('{"event_type":"session_started","payload":{},"metrics":[]}', True, []),
    ('{"event_type":"session_started","payload":{},"timestamp":"nope"}', True, ["timestamp:warning"]),
    ('{"event_type":"session_started","payload":{},"timestamp":"2024-01-01T00:00:00.5Z"}', True, []),
    ("{bad", False, ["raw_data:critical"]),
    ("null", False, ["raw_data:critical"]),
    ("7", False, ["event_type:critical", "payload:critical"]),
])
def test_rules(spark, text, valid, errors):
    r = V.validate_events(records(spark, [text])).first()
    assert r.is_valid == valid and [f"{e.field}:{e.severity}" for e in r.errors] == errors


def test_bad_base64_is_quarantined(spark):
    df = V.validate_events(V.decode_records(spark.createDataFrame([("%%%",), (None,)], "data STRING")))
    assert [r.is_valid for r in df.collect()] == [False, False]


def test_parse_happens_once(spark):
    """A filter on the result must not pull the parse below itself a second time."""
    checked = V.validate_events(records(spark, ["{}"])).where("is_valid")
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_summary(spark):
    text = '{"payload":1,"metrics":{"iops":-1},"timestamp":"x"}'
    r = V.malformed_summary(V.validate_events(records(spark, [text]))).first()
    assert (r.severity, r.summary) == ("critical", "Found 2 critical, 1 errors, 1 warnings")


def test_ingest_gate_first_rule_wins(spark):
    texts = ["", "{x", "{}", '{"event_type":"a"}', '{"event_type":"session_started"}', '{"event_type":"session_started","payload":{}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING")
    got = [r.reject_reason for r in V.reject_reason(df).orderBy("i").collect()]
    assert got[:3] == ["Request body is required", "Request body is not valid JSON", "event_type is required"]
    assert got[3].startswith("Invalid event_type. Must be one of: session_started, ") and got[4] == "payload is required and must be an object" and got[5] is None


def test_required_gate(spark):
    texts = ['{"entity_id":"a","entity_type":"b","timestamp":"t"}', '{"entity_id":1,"timestamp":"t","metrics":[],"metadata":{}}']
    got = [r.missing for r in V.missing_required(records(spark, texts)).orderBy("event_id").collect()]
    assert got == [[], ["entity_id", "entity_type", "metrics"]]


def test_short_rules(spark):
    r = V.validate_short(records(spark, ['{"metrics":{"iops":-2}}'])).first()
    assert r.severity == "critical" and len(r.reasons) == 4 and not r.is_valid


def test_field_drift_and_items(spark):
    texts = [
        '{"event_type":"session_completed","timestamp":"2024-01-05T10:00:00Z","payload":{"customer_id":"c1","tutor_id":"t1","student_rating":4,"actual_duration_minutes":50,"no_show":true}}',
        '{"event_type":"tutor_availability_updated","payload":{"tutor_id":"t1","available_slots_this_week":3,"subjects":["a","b"],"accepts_instant_book":true}}',
        '{"event_type":"session_completed","payload":{"tutor_id":""}}',
    ]
    at = instant("2024-01-31 00:00:00")
    valid, _ = V.split_valid(V.validate_events(records(spark, texts)))
    none = F.lit(None).cast("string")
    events = V.normalise_payload(V.enrich(valid, at, F.lit("1.2.3.4"), none))
    first = events.orderBy("event_id").first()
    assert (first.student_id, first.rating, first.duration_min, first.source_ip, first.ts) == ("c1", 4.0, 50.0, "1.2.3.4", dt.datetime(2024, 1, 5, 10))
    items = V.event_items(events, at).collect()
    assert sorted(r.entity_type for r in items) == ["event", "event", "event", "tutor", "tutor"]
    delta = next(r for r in items if r.sessions_completed_count == 1)
    assert (delta.session_rating_sum, delta.session_rating_count, delta.no_show_count, delta.ttl) == (4.0, 1, 1, 1706659200 + 90 * 86400)
    profile = next(r for r in items if r.available_slots_this_week is not None)
    assert profile.subjects == ["a", "b"] and profile.instant_book_enabled
