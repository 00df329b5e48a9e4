"""The manifest against a plain tree, with many partitions and ragged runs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import tidewatch.llm.merkle as M
from tests.llm.helpers import DOCS

SCHEMA = DOCS


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def plain_tree(leaves, fanout):
    """(root, for each leaf its siblings level by level as (left, right))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fanout * fanout:k // fanout * fanout + fanout]
            paths[i].append(("".join(run[:k % fanout]), "".join(run[k % fanout + 1:])))
        level = [h("".join(level[k:k + fanout])) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], paths


def plain_manifest(rows, fanout):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = (mine, *plain_tree([plain_leaf(r) for r in mine], fanout))
    root, upper = plain_tree([trees[s][1] for s in names], fanout)
    return sorted((r[0], s, plain_leaf(r), trees[s][1], root, paths + upper[k])
                  for k, s in enumerate(names) for r, paths in zip(trees[s][0], trees[s][2], strict=True)) if None not in [r[0] for r in rows] else [
        (r[0], s, plain_leaf(r), trees[s][1], root, paths + upper[k]) for k, s in enumerate(names) for r, paths in zip(trees[s][0], trees[s][2], strict=True)]


def table(sizes, seed=1):
    rng, rows, n = random.Random(seed), [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 3, rng.choice([None, "", "Text " + "ÄB" * rng.randrange(5)]), rng.choice([None, "en"]), source, rng.choice([None, 5])))
            n += 1
    rng.shuffle(rows)
    return rows


def got(df):
    return [(r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.l, p.r) for p in r.path]) for r in df.collect()]


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 2, "b": 1}, {"a": 70, None: 3, "b": 9, "é": 1, "": 30}, {f"s{k:02}": 1 for k in range(11)}, {"big": 130, **{f"s{k}": k % 4 + 1 for k in range(9)}},
])
def test_against_plain_tree(spark, sizes, fanout):
    rows = table(sizes)
    assert sorted(got(M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout)), key=str) == sorted(plain_manifest(rows, fanout), key=str)


def test_repeated_rows_and_null_ids(spark):
    """Equal rows count each; rows of one id go by their leaf; rows without id come first."""
    rows = [(5, "t", "en", "a", 1)] * 40 + [(5, "u", "en", "a", 1), (None, "v", "en", "a", 1), (None, None, None, "a", None), (1, None, None, None, None)]
    assert sorted(got(M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)), key=str) == sorted(plain_manifest(rows, 2), key=str)


def test_every_proof_leads_to_the_root(spark):
    rows = table({"a": 70, None: 3, "b": 9})
    found = M.manifest(spark.createDataFrame(rows, SCHEMA), 3).select("root", M.folded(F.col("leaf"), F.col("path")).alias("end"), M.folded(M.digest(F.lit("x")), F.col("path")).alias("other"))
    assert all(r.end == r.root != r.other for r in found.collect())


def test_query_tampering_and_other_columns(spark, tmp_path):
    rows = table({"a": 40, None: 2, "b": 19}) + [(10_000, "X" * 300_000, "en", "b", 300_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("carried", F.lit(2)).withColumn("pos", F.lit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: (r, p) for r, p in ((next(x for x in rows if x[0] == m[0]), m) for m in plain_manifest(rows, 16))}
    lower = {i: i + 32 for i in range(65, 91)}
    out = M.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and not all(r.verified for r in out)
    for r in out:
        row, (_, _, leaf, subroot, root, path) = want[r.doc_id]
        tampered = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        node = plain_leaf((row[0], row[1].translate(lower), *row[2:])) if tampered and row[1] is not None else leaf
        for left, right in path:
            node = h(left + node + right)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, h("".join(a + b for a, b in path)))
        assert (r.folded_root, r.verified) == (node, node == root)


def test_empty_table(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
