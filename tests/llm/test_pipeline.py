"""The pipeline against its stages done one by one, and the entry with and without the package."""

import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import words

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What every stage returns, written and read again."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
    return out


def test_stages_keep_the_columns_and_decide(spark, kept):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("toxicity", "quality", "line_dedup", "near_dedup"):
        assert kept[name].dtypes == source.dtypes
    n = {name: df.count() for name, df in kept.items()}
    assert source.count() > n["toxicity"] > n["quality"] == n["line_dedup"] > n["near_dedup"] > 100
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = kept["toxicity"].join(labels.where("toxic = 1"), "doc_id").count()
    lost = labels.where("toxic = 0").join(source, "doc_id").join(kept["toxicity"], "doc_id", "left_anti").count()
    assert wrong <= 1 and lost <= 1
    assert kept["quality"].join(labels.where("quality = 0"), "doc_id").count() <= 1
    assert kept["line_dedup"].where("n_chars <> length(text)").count() == 0


def test_run_equals_the_stages(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept["packing"].collect()))
    ids = {r.doc_id for r in kept["packing"].select("doc_id").collect()}
    assert ids == {r.doc_id for r in kept["near_dedup"].select("doc_id").collect()}
    fill = defaultdict(int)
    for r in kept["packing"].collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_near_copies_leave_one(spark):
    base = words(1, 80)
    docs = spark.createDataFrame([(i, base + f" end{i}", "en", "s", 1) for i in (5, 3, 9)] + [(None, base, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("gone", F.lit(1))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["3", "None"]


NAMES = ("gone", "line_dedup", "toxicity_score", "quality_score", "document", "__id", "__cut_")


def awkward(spark):
    """Null, empty, repeated rows, and columns named as the stages name theirs."""
    base = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "plain words here", None, None, 16), (3, "plain words here", None, None, 16), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(7).alias(n) for n in NAMES])


def test_stages_with_awkward_rows_and_names(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[n] == 7 for r in got for n in NAMES) and len(got) == (5 if name in ("line_dedup", "near_dedup") else len(got))
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, SF).collect()} == {1, 2, 3, None}


def test_stages_with_empty_tables(spark, tmp_path):
    docs = awkward(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == 0  # 0.5 for every text
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 5


def test_entry_works_without_the_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 140 and out[1] == "False"
