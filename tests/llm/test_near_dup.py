import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidewatch.llm import near_dup as N


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """doc_id -> (sizes, component) by comparing all pairs."""
    docs = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i), i == find(i)) for i, s in docs)


def mutated(text, seed, share):
    rng, w = random.Random(seed), text.split()
    return " ".join(f"m{rng.random()}" if rng.random() < share else x for x in w)


def table():
    docs = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE  two\n"), (5, "one two three four five"), (6, "one two three four"), (7, words(7, 30_000))]
    base = {k: words(100 + k, n) for k, n in enumerate((6, 12, 40, 90, 300, 2000))}
    docs += [(10 + k, t) for k, t in base.items()]
    # near copies at all distances around the border
    docs += [(1000 * k + i, mutated(t, i, share)) for k, t in base.items() for i, share in enumerate([0, 0, .005, .01, .015, .02, .025, .03, .04, .05, .08, .2], 100)]
    # a passage that every one of these holds, in short and long company
    docs += [(20_000 + i, f"{words(5000 + i, 5 * i)} {words(1, 80)} {words(6000 + i, 3 * i)}") for i in range(60)]
    # a chain: each is near the next, the ends aren't
    chain = words(9, 200).split()
    docs += [(30_000 - i, " ".join(chain[8 * i:8 * i + 120])) for i in range(10)]
    return docs


def test_equals_brute_force(spark):
    docs = table()
    got = N.near_duplicates(documents(spark, docs)).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_clashing_columns_repeated_rows_and_null_ids(spark):
    a, b = words(1, 50), words(2, 50)
    docs = [(5, a), (5, a), (7, b), (7, mutated(a, 1, 0.01)), (3, b), (None, a), (9, words(3, 50))]
    df = documents(spark, docs).withColumn("component_id", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("value", F.lit(2)).withColumn("n", F.lit(3))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    # the two texts of 7 join the others' groups
    assert got == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False), (False, 7, 3, False), (False, 7, 3, False), (False, 9, 9, True), (True, 0, None, True)]


def test_ids_with_several_texts(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    docs = [(8, a), (8, b), (20, mutated(a, 1, 0.01)), (21, mutated(b, 2, 0.01)), (30, c), (31, ""), (31, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(documents(spark, docs)).collect())
    assert got == [(8, 8, True), (8, 8, True), (20, 8, False), (21, 8, False), (30, 30, True), (31, 30, False), (31, 30, False)]


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).collect() == []


def test_large_group_of_copies_costs_in_proportion(spark):
    base = words(1, 60)
    docs = [(i, base + f" end{i % 400}") for i in range(1200)]
    got = N.near_duplicates(documents(spark, docs)).agg(F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (0, 1)


def test_sets_hold_every_shingle():
    docs = [t for _, t in table()]
    assert [len(s) for s in N.shingle_sets(docs)] == [len(shingles(t)) for t in docs]
    a, b = N.shingle_sets(["a b c d e f", "b c d e f g"])
    assert len(np.intersect1d(a, b)) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, N.query(spark, sf).collect())) == brute(docs)
