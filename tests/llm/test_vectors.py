import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import topk as T
from tidewatch.llm import vec_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def valid(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


def near(rows):
    """vec_id, n_links, component of rows with distinct ids, by all pairs."""
    good = [(i, v / np.linalg.norm(v)) for i, v in valid(rows) if v.any()]
    ids = np.array([i for i, _ in good])
    linked = np.array([[i != j and len(a) == len(b) and a @ b >= 0.95 for j, b in good] for i, a in good])
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], 1 << 60).min(1))
        if (new == low).all():
            break
        low = new
    out = {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), low, strict=True)}
    return sorted((i, *out.get(i, (0, i)), out.get(i, (0, i))[1] == i) for i, _ in rows if i is not None)


def cloud(dim=32, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim)) for i in range(400)]
    for k in range(8):  # groups around a centre, at all distances around the border
        centre = rng.standard_normal(dim)
        rows += [(1000 * (k + 1) + i, centre * rng.uniform(0.1, 9) + 0.1 * (i % 5) * np.linalg.norm(centre) / dim**0.5 * rng.standard_normal(dim)) for i in range(25)]
    rows += [(50_000 + i, rows[0][1]) for i in range(40)]  # equal vectors
    rows += [(60_000, None), (60_001, []), (60_002, [0.0] * dim), (60_003, [float("nan")] * dim), (60_004, [float("inf"), *[1.0] * (dim - 1)]), (60_005, [None, *[1.0] * (dim - 1)]), (None, rows[0][1]), (60_006, [1.0, 2.0]), (60_007, [2.0, 4.0]), (60_008, [3.0])]
    return [(i, None if v is None else list(v)) for i, v in rows]


def test_near_vectors_equal_brute_force(spark):
    rows = cloud()
    df = table(spark, rows).withColumn("class", F.lit("mine")).withColumn("size", F.lit(3)).withColumn("n_links", F.lit(1))
    got = [tuple(r) for r in V.near_vectors(df).collect()]
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)]
    got, want = sorted(r for r in got if r[0] is not None), near(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 3000 and 0.99 * there <= found <= there
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_recall_at_the_border():
    """Pairs at exactly 0.95 share a filter far more often than nine times in ten."""
    code, least = V.probed(64, 3200, 16, 0.95)
    x, y = V.border_pairs(64, 0.95, seed=2, n=2000)  # other pairs than the probe's own
    assert V.met(code, least, x, y) > 0.99


def test_recall_holds_with_many_filters(spark):
    """As many filters as a million vectors get: 2000 pairs just above the border, far from each other."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    got = V.near_vectors(table(spark, enumerate(np.concatenate([x, y]).tolist())), filter_rows=1)
    assert 0.99 * 4000 <= got.agg(F.sum("n_links")).first()[0] <= 4000


@pytest.mark.parametrize(("dim", "filters"), [(2, 125), (8, 3_125), (64, 625_000), (384, 62_500)])
def test_recall_by_dimension_and_filters(dim, filters):
    code, least = V.probed(dim, filters, 16, 0.95)
    assert V.met(code, least, *V.border_pairs(dim, 0.95, 22)) >= 0.99


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 40)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, list(centre + 0.001 * rng.standard_normal(16))) for i in range(300)]
    got = {tuple(r)[1:] for r in V.near_vectors(table(spark, rows)).collect()}
    assert got == {(299, 0, True), (299, 0, False)}


def test_repeated_ids_join_groups(spark):
    rows = [(1, [1.0, 0]), (2, [1.0, 0.01]), (2, [0, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0])]
    got = sorted(tuple(r) for r in V.near_vectors(table(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert V.near_vectors(table(spark, [])).collect() == []


def best(rows, queries, k):
    good = [(i, np.floor(64 * v).astype(np.int64)) for i, v in valid(rows)]
    out = []
    for q, v in good:
        if queries(q):
            scores = sorted((-int(v @ c), i) for i, c in good if i != q and len(c) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_k_equals_brute_force(spark, k):
    rows = cloud(dim=20, seed=4)
    df = table(spark, rows).withColumn("score", F.lit(1)).withColumn("block", F.lit("x")).withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in T.top_inner_products(df.where("vec_id % 20 = 0"), df, k=k).collect())
    assert got == best(rows, lambda i: i % 20 == 0, k)


def test_top_k_ties_large_numbers_and_empty_tables(spark):
    rows = [(i, [1e8, -1e8, float(i % 2)]) for i in range(60)]
    df = table(spark, rows)
    assert sorted(tuple(r) for r in T.top_inner_products(df.where("vec_id < 3"), df, k=5).collect()) == best(rows, lambda i: i < 3, 5)
    empty = table(spark, [])
    assert T.top_inner_products(empty, df).collect() == [] and T.top_inner_products(df, empty).collect() == []
    # a query id with two vectors counts with the smaller one; equal candidate rows are candidates each
    rows = [(0, [2.0]), (0, [1.0]), (5, [1.0]), (5, [1.0])]
    df = table(spark, rows)
    assert [tuple(r) for r in T.top_inner_products(df.where("vec_id = 0"), df, k=3).orderBy("rank").collect()] == [(0, 1, 5, 4096), (0, 2, 5, 4096)]
