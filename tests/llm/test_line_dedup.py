import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidewatch.llm import line_dedup as L


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line))


def brute(docs, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held[key(line)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LONG = "Licensed under the Apache License, Version 2.0."
CASES = [
    (1, f"a\n  {LONG}\t\nb"), (2, LONG.upper()), (3, f"{LONG}\n{LONG}"), (4, f"x\n{LONG}\r"), (5, f"{LONG}\nlast {words(1, 30)}"), (6, None), (7, ""), (8, "\n\n"),
    (9, "é" * 40), (10, "é" * 40 + "\n"), (11, " " + "é" * 40), (12, "é" * 40), (13, "é" * 40), (14, "É" * 40), (15, "é" * 39), (16, "é" * 40 + "\n" + words(2, 20_000)),
    (3, f"again\n{LONG}"), (None, LONG), (17, "\x00" + LONG), (-5, LONG),
]


def test_equals_brute_force(spark):
    got = L.dedup_lines(documents(spark, CASES)).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.coalesce("text", F.lit("")).alias("t"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(CASES), key=str)


def test_other_columns_stay_and_names_may_clash(spark):
    docs = documents(spark, CASES[:5]).withColumn("n_lines", F.lit("mine")).withColumn("keeper", F.lit(1)).withColumn("digest", F.lit(2))
    got = L.dedup_lines(docs)
    assert got.columns == [*docs.columns, "line_dedup"] and {r.n_lines for r in got.collect()} == {"mine"}


def test_empty_table(spark):
    assert L.dedup_lines(documents(spark, [])).collect() == []


def test_a_full_filter_gives_the_same_rows(spark):
    """A filter far too small suspects nearly every line, and still only confirmed repeats go."""
    docs = [(i, "\n".join(f"line {j} of document {i} " + "z" * 30 for j in range(400)) + f"\nshared by everyone {'y' * 40}") for i in range(60)]
    got = L.dedup_lines(documents(spark, docs), filter_bits=1 << 20).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs))
    with pytest.raises(ValueError):
        L.dedup_lines(documents(spark, docs), filter_bits=1000)


def test_merge_counts_across_tasks():
    import numpy as np
    import pandas as pd

    def row(s, a, b):
        return {"segment": s, "once": np.array(a, "<u4").tobytes(), "twice": np.array(b, "<u4").tobytes()}

    out = {r["segment"].iloc[0]: np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"].iloc[0], np.uint8), bitorder="little")).tolist()
           for r in L._merge(iter([pd.DataFrame([row(0, [1, 2], [7]), row(0, [2, 7], [])]), pd.DataFrame([row(3, [5], [])])]))}
    assert out == {0: [2, 7], 3: []}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs)]
    assert sorted(map(tuple, L.query(spark, sf).collect())) == sorted(want)
