"""The corpus pipeline: five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are written and read again,
so a stage starts from files that all executors reach. All stages but the last return the columns of ``documents``, whatever
further columns there are and whatever their names. Every row is judged on its own content: null and empty texts are scored
as texts without words, have one empty line, no near copies and one token; repeated rows are kept or rejected alike, except
that of near copies with different ids one id stays. Empty tables give empty tables, and without labels every text gets the
same score (0.5, which the toxicity stage rejects and the quality stage keeps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import spare_name, staged
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.near_dup import near_duplicates
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.quality import score_quality
from tidewatch.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 for toxicity."""
    score = spare_name(docs, "toxicity_score")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), column=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least 0.3 for quality."""
    score = spare_name(docs, "quality_score")
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), column=score)
    return scored.where(F.col(score) >= 0.3).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that others repeat; ``n_chars`` follows the text."""
    found = spare_name(docs, "line_dedup")
    cut = dedup_lines(docs, column=found)
    chars = F.when(F.col(f"{found}.n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).drop(found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    name = spare_name(docs, "gone")
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
ORACLE_SQL = None  # SQL can't express the trained stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"after_{name}")
    return docs
