"""Exact top-k by inner product: the three-phase uniform threshold over lists of local scores.

The components are cut into ``lists`` slices; a slice's inner product with the query is a local score, and a candidate's
score is the sum of its local scores. Candidates and queries are packed into blocks, and a cell is a block of each.

1. Every cell gathers, per query and list, its ``k`` best local scores, and returns the k best totals of those candidates.
   The k-th best total over all cells is a safe cutoff: at least k candidates reach it.
2. With the query's cutoff t, a candidate that reaches t has a local score of at least t / lists in some list (else the sum
   would stay below t). Each cell collects exactly those entries.
3. Collected candidates whose upper bound (known local scores, t / lists for the others) falls below t are dropped; the
   rest are resolved exactly, and each cell returns at most k per query, ties to the smaller id.

The cutoffs are one number per query; they travel with the query blocks. All queries meet all candidates, as the task says,
so the work is their product; per cell memory is bounded by the block sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import batches, staged

BLOCK = 4_096
QUERIES = 1_024
AT_ONCE = 128  # queries of a block that a task scores together
NONE = -(1 << 62)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every valid vector."""
    value = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long"), F.transform(value, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(block, dim, ids binary, data binary): rows of equal length packed as they lie in their partition, written once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, size):
            for dim, part in frame.groupby(frame["v"].map(len)):
                yield pd.DataFrame({"dim": [dim], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "data": [np.array(part["v"].tolist(), np.int64).tobytes()]})

    return staged(rows.mapInPandas(run, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id()), name)


def _read(row, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}data"], np.int64).reshape(-1, row["dim"])


def local_scores(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """One matrix (queries, candidates) per list, in integers that doubles hold exactly (else as longs)."""
    cuts = np.linspace(0, q.shape[1], min(lists, q.shape[1]) + 1).astype(int)
    small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if small else np.int64
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _gather(k: int, lists: int):
    """Phase 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                (qi, q), (ci, c) = _read(row, "q_"), _read(row, "")
                out_q, out_s = [], []
                for at in range(0, len(qi), AT_ONCE):
                    local = local_scores(q[at:at + AT_ONCE], c, lists)
                    total = sum(local)
                    m = min(k + 1, len(ci))  # one more, as the query itself may be among them
                    tops = [np.argpartition(s, len(ci) - m, axis=1)[:, len(ci) - m:] for s in local]
                    for i, own in enumerate(qi[at:at + AT_ONCE]):
                        seen = np.unique(np.concatenate([t[i] for t in tops]))
                        s = total[i, seen[ci[seen] != own]]
                        out_q.append(own)
                        out_s.append(np.sort(s)[::-1][:k].astype(np.int64))
                yield pd.DataFrame({"query_id": out_q, "scores": out_s})

    return run


def _collect(k: int, lists: int):
    """Phases 2 and 3."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                (qi, q), (ci, c) = _read(row, "q_"), _read(row, "")
                cutoff = np.frombuffer(row["cutoffs"], np.int64)
                found = []
                for at in range(0, len(qi), AT_ONCE):
                    local = local_scores(q[at:at + AT_ONCE], c, lists)
                    for i, own in enumerate(qi[at:at + AT_ONCE]):
                        t = cutoff[at + i]
                        if t == NONE:  # fewer than k candidates in all
                            open_ = np.flatnonzero(ci != own)
                        else:
                            share = t / len(local)
                            mine = np.stack([s[i] for s in local])
                            enough = (mine >= share).any(0)
                            upper = np.maximum(mine, share).sum(0)
                            open_ = np.flatnonzero(enough & (upper >= t - 1e-6 * max(1.0, abs(float(t)))) & (ci != own))
                        exact = c[open_] @ q[at + i]
                        reach = exact >= t
                        open_, exact = open_[reach], exact[reach]
                        keep = best(exact, ci[open_], k)
                        found.append((np.full(len(keep), own), ci[open_[keep]], exact[keep]))
                yield pd.DataFrame({n: np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_inner_products(queries: DataFrame, vectors: DataFrame, k: int = 20, scale: int = 64, lists: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): the ``k`` highest integer inner products of each query.

    Both tables hold vec_id and embedding; a component x counts as floor(scale * x). Candidates are all rows with another
    vec_id than the query's; with fewer than ``k`` all are returned. Ties go to the smaller vec_id. Null and empty vectors,
    vectors with null or non-finite components and rows without vec_id take no part, nor do candidates of another length
    than the query. A query id that occurs again with another vector counts with its smallest vector; repeated candidate
    rows are candidates each. Empty tables give no rows. Other columns are not used.
    """
    own = whole_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = packed(own, QUERIES, "query_blocks")
    c = packed(whole_vectors(vectors, scale), BLOCK, "candidate_blocks")
    # each candidate block is paired with every query block of its length, through the list of their numbers
    numbers = q.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    right = c.join(numbers, "dim").select("ids", "data", F.explode("blocks").alias("b"))
    left = q.select("block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    cells = left.join(right, F.col("block") == F.col("b"))

    gathered = cells.select("dim", "q_ids", "q_data", "ids", "data").mapInPandas(_gather(k, lists), "query_id long, scores array<long>")
    scores = gathered.select("query_id", F.explode("scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoff = staged(scores.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "score"), "cutoffs")

    def with_cutoffs(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        ids = np.frombuffer(row["q_ids"], np.int64)
        known = dict(zip(part["query_id"], part["score"], strict=True))
        return pd.DataFrame({"block": [row["block"]], "cutoffs": [np.array([known.get(i, NONE) for i in ids.tolist()], np.int64).tobytes()]})

    # a block has at most QUERIES cutoffs
    members = q.select("block", "ids").mapInPandas(_members, "block long, query_id long")
    held = members.join(cutoff, "query_id", "left").select("block", "query_id", F.coalesce("score", F.lit(NONE)).alias("score"))
    cuts = held.join(q.select("block", F.col("ids").alias("q_ids")), "block").groupBy("block").applyInPandas(with_cutoffs, "block long, cutoffs binary")
    cuts = staged(cuts, "block_cutoffs").select(F.col("block").alias("k"), "cutoffs")
    second = cells.join(cuts, F.col("block") == F.col("k")).select("dim", "q_ids", "q_data", "ids", "data", "cutoffs")
    found = second.mapInPandas(_collect(k, lists), "query_id long, vec_id long, score long")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block, ids in zip(frame["block"], frame["ids"], strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pd.DataFrame({"block": np.full(len(ids), block), "query_id": ids})


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every row for each row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_inner_products(vectors.where("vec_id % 20 = 0"), vectors)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
