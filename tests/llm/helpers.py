"""Small tables with awkward rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text) pairs as a documents table."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def words(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(df):
    return sorted(df.collect(), key=str)
