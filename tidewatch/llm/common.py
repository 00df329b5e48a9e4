"""Helpers shared by the corpus operators."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_dir

ASCII_SPACE = b" \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back: later steps start from the files,
    so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unclaimed(df: DataFrame, name: str) -> str:
    """``name``, an error if the table has such a column: a result is never put over a column that passes through."""
    if spare_name(df, name) != name:
        raise ValueError(f"the table has a column {name}; give the result another name")
    return name


def held_out(doc_id: Column) -> Column:
    """Rows kept away from label learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps: each round sends at most one row per edge and direction,
    and the number of rounds grows with the logarithm of the longest chain. Every aggregate is a plain
    ``min`` with map-side combining, so a hub with a third of all edges is no hot task. The edge list is
    written after each round.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # large star: the larger neighbours of u move to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, large.u == least.k)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = staged(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        # done when every node has one parent and no parent has a parent: the edges are stars
        parents = nxt.groupBy("u").agg(F.count("*").alias("n"))
        open_ = parents.where("n > 1").limit(1).count() or nxt.select("v").join(nxt.select("u"), F.col("v") == F.col("u"), "left_semi").limit(1).count()
        e = nxt
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def among(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose long ``key`` is in ``wanted`` (one column w), without shuffling the others.

    The wanted keys set bits of a map that is broadcast (at most ``bits`` / 64 rows, whatever the input); rows whose bit
    is unset stay out before any shuffle, and a semi join drops what the map lets through by chance.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    place = at(F.col("w"))
    words = wanted.groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(w), {bits}L) & 63 AS INT))")).alias("__bits"))
    mine = at(F.col(key))
    held = df.withColumn("__at", mine).join(F.broadcast(words), F.shiftright(F.col("__at"), 6) == F.col("__word"))
    held = held.where(F.expr("(__bits & shiftleft(1L, CAST(__at & 63 AS INT))) <> 0")).drop("__at", "__word", "__bits")
    # an inner join with distinct keys: a semi join would be moved below the map, to all rows
    return held.join(wanted.select(F.col("w").alias("__w")).distinct(), F.col(key) == F.col("__w")).drop("__w")


def batches(frames: Iterator, rows: int) -> Iterator:
    """The same rows in frames of at most ``rows``."""
    for frame in frames:
        for i in range(0, len(frame), rows):
            yield frame.iloc[i:i + rows]


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, chars: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fifth, the same ones at every
    run: the first by a hash of their id. Ids labelled twice count with the larger label, and of several texts of an id the
    first in order counts; texts over ``chars`` are left out of the sample. Both bounds are parameters, so the sample fits in
    one task."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(column).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    short = docs.select(F.col("doc_id").cast("long"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    found = short.join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")


def trained(sample: DataFrame, train: Callable[[list[str], list[int]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``train``(texts, labels) over the bounded ``sample``, in one task; only the weights come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(row for frame in frames for row in frame.itertuples(index=False, name=None))
        out = io.BytesIO()
        np.savez(out, **train([t for _, t, _ in rows], [int(y) for *_, y in rows]))
        yield pd.DataFrame({"weights": [out.getvalue()]})

    found = sample.repartition(1).mapInPandas(run, "weights binary").first()
    if found is None:  # nothing labelled, so not even one task
        return train([], [])
    with np.load(io.BytesIO(found.weights)) as weights:
        return dict(weights)


class Adam:
    """Gradient steps on a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.w, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.w[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.w[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.w[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)
