"""Vector codes against a search of all entries."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewatch.llm.vec_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """{vec_id: (code, error)}, codebooks; every entry compared."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(scale * float(np.float32(v))) for v in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for k in range(rounds + 1):
        d = [((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        codes = [a.argmin(1) for a in d]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = x[codes[p] == e, p]
                    if len(mine):
                        books[p][e] = [math.floor(int(s) // len(mine)) for s in mine.sum(0)]
    error = sum(a.min(1) for a in d)
    return [(r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), r[2]) for i, r in enumerate(kept)], np.array(books)


def vectors(n, dim=32, seed=3, spread=0.1):
    rng = np.random.default_rng(seed)
    return [(int(i) * 7, [float(v) for v in np.float32(rng.normal(0, spread, dim))], int(i) % 4 or None) for i in rng.permutation(n)]


AWKWARD = [(1, None, 1), (2, [], 1), (3, [0.1, float("nan")] * 16, 2), (4, [0.1, float("inf")] * 16, 2), (5, [None, 0.1] * 16, None), (None, [0.25] * 32, 1), (0, [0.0] * 32, None)]


@pytest.mark.parametrize("spread", [0.004, 0.1, 50.0])  # many ties and equal sums, usual, wide
def test_search_finds_the_nearest(spread):
    rng = np.random.default_rng(int(spread * 1000))
    for dim in (1, 3, 4):
        parts, entries = (np.floor(rng.normal(0, spread * 256, (n, dim))).astype(np.int64) for n in (500, 40))
        entries[7] = entries[20]
        d = ((parts[:, None] - entries[None]) ** 2).sum(2)
        index, best = V.equal_average_search(parts, entries)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_bound_is_strict():
    """An entry whose bound equals the best distance may win by its lower index."""
    index, best = V.equal_average_search(np.array([[0]]), np.array([[3], [-3], [3]]))
    assert (index[0], best[0]) == (0, 9)
    index, _ = V.equal_average_search(np.array([[0]]), np.array([[-3], [3]]))
    assert index[0] == 0


@pytest.mark.parametrize("rows", [vectors(300) + AWKWARD, vectors(9), vectors(200) * 2, [(5, [0.1] * 32, 1)] * 80])
def test_against_plain(spark, rows):
    found, books = V.compress(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, want_books = plain(rows)
    assert (books == want_books).all()
    got = [(r.vector.vec_id, r.code.hex(), r.error, r.vector.label) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query(spark, tmp_path):
    rows = vectors(300) + AWKWARD
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = plain(rows)
    per_label = {}
    for _, _, error, label in want:
        per_label[label] = per_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    got = [tuple(r) for r in V.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, c, e, per_label[label], digest) for i, c, e, label in want), key=str)


def test_decoded_vectors_are_near(spark):
    rows = vectors(400)
    found, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    out = found.select("vector.embedding", "error", V.decode(F.col("code"), books, 256).alias("back")).collect()
    for r in out:
        gap = sum((a - b) ** 2 for a, b in zip(r.embedding, r.back, strict=True))
        assert abs(math.sqrt(gap) - math.sqrt(r.error) / 256) < math.sqrt(32) / 256


def test_empty_table_and_clashing_names(spark):
    found, books = V.compress(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and books.size == 0
    assert V.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    clash = spark.createDataFrame(vectors(70), SCHEMA).withColumn("code", F.lit(1)).withColumn("error", F.lit("e")).withColumn("vector", F.lit(2))
    row = V.compress(clash)[0].first()
    assert (row.vector.code, row.vector.error, row.vector.vector, len(row.code)) == (1, "e", 2, 16)


def test_unfit_vectors_are_errors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        V.compress(spark.createDataFrame([(1, [0.1] * 10, 1)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        V.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))
