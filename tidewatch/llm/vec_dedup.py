"""Embedding near-dedup with spherical-cap filters.

Filter directions form a random product code: a random rotation cuts a vector into two halves, each half has its own list
of random unit directions, and a filter is a pair of them. Its value is the sum of two inner products, so a vector finds
all filters above the cap height by combining two short sorted lists, without looking at every filter. Vectors that share
a filter are compared in double precision, in cells of bounded size. A pair that shares several filters is counted in its
smallest one; cells return counts and one link to the cell's smallest member per vector, never pairs.

The number of filters follows the number of vectors, so that a filter holds ``filter_rows`` on average; the cap height
is the quantile at which a random direction has ``caps`` filters. The higher the caps, the rarer a filter is shared, so a
vector below the height in most filters gets its ``least`` best ones; ``least`` is raised for the dimension and the number
of filters at hand until at least RECALL of the pairs of a probe, drawn at exactly the smallest cosine, share a filter.
A pair that shares none is not found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, staged

CELL = 2_000  # rows of one side of a cell
RECALL, PROBE = 0.995, 2_000  # share of probe pairs that must meet in a filter, pairs of the probe


class CapCode:
    """The product code for one dimension: rotation, directions of both halves, cap height."""

    def __init__(self, dim: int, filters: int, caps: float, seed: int = 20):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.half, self.size = dim, (dim + 1) // 2, max(2, int(np.ceil(np.sqrt(filters))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.left = self._directions(rng, self.half)
        self.right = self._directions(rng, dim - self.half) if dim > 1 else np.zeros((self.size, 0))
        probe = rng.standard_normal((200, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        a, b = self._halves(probe)
        if self.size <= 400:
            left, right = np.divmod(np.arange(self.size**2), self.size)
        else:
            left, right = rng.integers(0, self.size, 100_000), rng.integers(0, self.size, 100_000)
        self.height = self._quantile(a, b, left, right, max(0.0, 1 - caps / self.size**2))

    @staticmethod
    def _quantile(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> float:
        """The quantile of all sums of the pairs (left, right); only the largest sums are held, a few rows' at a time."""
        total = len(a) * len(left)
        at = share * (total - 1)
        top = np.empty(0)
        for i in range(0, len(a), 8):
            top = np.concatenate([top, (a[i:i + 8, left] + b[i:i + 8, right]).ravel()])
            keep = min(len(top), total - int(at))
            top = np.partition(top, len(top) - keep)[len(top) - keep:]
        low, high = np.sort(top)[[0, min(1, len(top) - 1)]]
        return float(low + (high - low) * (at - int(at)))

    def _directions(self, rng, dim):
        x = rng.standard_normal((self.size, max(dim, 1)))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def _halves(self, x):
        x = x @ self.rotation
        return x[:, :self.half] @ self.left.T, x[:, self.half:] @ self.right.T if self.dim > 1 else np.zeros((len(x), self.size))

    def decode(self, unit: np.ndarray, least: int) -> list[np.ndarray]:
        """Sorted filter numbers above the cap height of each row; at least the ``least`` best."""
        a, b = self._halves(unit)
        oa, ob = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        out = []
        for i in range(len(unit)):
            # for the r-th best left direction, how many of the right ones are high enough
            n = np.searchsorted(-sb[i], sa[i] - self.height, side="right")
            rows = np.repeat(np.arange(self.size), n)
            cols = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(rows) < least:
                m = min(least, self.size)  # the best sums lie among the best of both sides
                best = np.argsort(-(sa[i, :m, None] + sb[i, None, :m]).ravel(), kind="stable")[:least]
                rows, cols = best // m, best % m
            out.append(np.unique(oa[i, rows].astype(np.int64) * self.size + ob[i, cols]))
        return out


def border_pairs(dim: int, cosine: float, seed: int, n: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and their partners at exactly ``cosine``; in one dimension, where there are none, themselves."""
    rng = np.random.default_rng([seed, dim])
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    y -= (y * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


def met(code: CapCode, least: int, x: np.ndarray, y: np.ndarray) -> float:
    """Share of the pairs that have a filter in common."""
    found = [zip(code.decode(x[at:at + 500], least), code.decode(y[at:at + 500], least), strict=True) for at in range(0, len(x), 500)]
    return float(np.mean([len(np.intersect1d(a, b)) > 0 for part in found for a, b in part]))


@lru_cache(maxsize=8)
def probed(dim: int, filters: int, caps: float, min_cosine: float) -> tuple[CapCode, int]:
    """The code, and the number of filters a vector has at least so that the probe reaches RECALL."""
    code, least = CapCode(dim, filters, caps), 4
    x, y = border_pairs(dim, min_cosine, 21)
    while least < code.size**2 and met(code, least, x, y) < RECALL:
        least = min(code.size**2, least + max(2, least // 2))
    return code, least


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_links(unit: np.ndarray, filters: list[np.ndarray], here: int, side: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one cell that reach ``min_cosine``, and whether this filter is the smallest they share.
    Pairs within a side are taken when there is only one side, else only pairs between the sides."""
    first = np.flatnonzero(side == side.min())
    second = np.flatnonzero(side == side.max())
    pairs = []
    for at in range(0, len(first), 512):
        rows = first[at:at + 512]
        i, j = np.nonzero(unit[rows] @ unit[second].T >= min_cosine)
        i, j = rows[i], second[j]
        pairs.append(np.stack([i, j], 1)[i < j] if len(first) == len(unit) else np.stack([i, j], 1))
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    width = max(1, max(int((f < here).sum()) for f in filters))
    earlier = np.full((len(filters), width), -1, np.int64)
    for r, f in enumerate(filters):
        f = f[f < here]
        earlier[r, :len(f)] = f
    smallest = np.ones(len(pairs), bool)
    for at in range(0, len(pairs), 100_000):
        i, j = pairs[at:at + 100_000].T
        shared = np.zeros(len(i), bool)
        right = earlier[j]
        for c in range(width):
            left = earlier[i, c]
            shared |= ((right == left[:, None]) & (left[:, None] >= 0)).any(1)
        smallest[at:at + 100_000] = ~shared
    return pairs, smallest


def _compare(min_cosine: float):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        here, ids, size = int(cell["filter"].iloc[0]), cell["class"].to_numpy(), cell["size"].to_numpy()
        pairs, counted = cell_links(unit_rows(cell["vector"]), [np.asarray(f) for f in cell["filters"]], here, cell["side"].to_numpy(), min_cosine)
        links = np.zeros(len(cell), np.int64)
        i, j = pairs[counted].T
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        # the cell's groups: the smallest class reachable within the cell
        root = ids.copy()
        while len(pairs):
            low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
            new = root.copy()
            np.minimum.at(new, pairs[:, 0], low)
            np.minimum.at(new, pairs[:, 1], low)
            if (new == root).all():
                break
            root = new
        held = (links > 0) | (root != ids)
        return pd.DataFrame({"class": ids[held], "links": links[held], "root": root[held]})

    return run


def vector_links(classes: DataFrame, min_cosine: float, caps: float, filter_rows: int) -> DataFrame:
    """(class, links, root) per class and cell: rows linked through this cell, and a smaller class of its group."""
    filters = max(16, int(classes.count() * caps / filter_rows))  # tasks make the code from these numbers and its seed

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len)):
                code, least = probed(dim, filters, caps, min_cosine)
                for at in range(0, len(part), 500):
                    rows = part.iloc[at:at + 500]
                    yield rows.assign(dim=dim, filters=code.decode(unit_rows(rows["vector"]), least))

    found = staged(classes.mapInPandas(decode, "class long, size long, vector array<double>, dim int, filters array<long>"), "caps")
    rows = found.withColumn("filter", F.explode("filters"))
    sizes = found.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    # a filter with more rows is cut into sides by hash; each pair of sides is a cell
    many = sizes.select(F.col("dim").alias("d"), F.col("filter").alias("f"), F.ceil(F.col("n") / CELL).cast("int").alias("sides"))
    cut = rows.join(staged(many, "many"), (F.col("dim") == F.col("d")) & (F.col("filter") == F.col("f")), "left").drop("d", "f")
    own = F.pmod(F.xxhash64("class"), F.col("sides")).cast("int")
    cut = cut.withColumn("side", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.when(F.col("sides").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("sides") - 1))))
    cells = cut.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return cells.select("dim", "filter", "low", "high", "side", "class", "size", "vector", "filters").groupBy("dim", "filter", "low", "high").applyInPandas(
        _compare(min_cosine), "class long, links long, root long")


def near_vectors(vectors: DataFrame, min_cosine: float = 0.95, caps: float = 16, filter_rows: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Linked are other rows whose cosine, in double precision, is at least ``min_cosine``. Equal vectors are compared once
    and count as often as they occur. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without vec_id, link with nothing; the latter get a null component and are kept. Vectors of different lengths aren't
    compared. Rows that share a vec_id are rows of their own for n_links and one node for component_id. Equal 64-bit
    hashes stand for equal vectors once the vectors themselves have been grouped.
    """
    value = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists(value, lambda x: x != 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = staged(vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(good, F.lit(False)), value).alias("vector")).withColumn(
        "class", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    classes = staged(rows.where("vector is not null").groupBy("class", "vector").agg(F.count("*").alias("size")).select("class", "size", "vector"), "classes")
    found = staged(vector_links(classes, min_cosine, caps, filter_rows), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class"), "component")
    # a class's rows share its group; an id in two groups joins them
    sizes = classes.select("class", "size").join(links, "class", "left").join(group, "class", "left")
    sizes = staged(sizes.select(F.col("class").alias("c"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("g")), "sizes")
    known = staged(rows.join(sizes, F.col("class") == F.col("c"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "g"), "known")
    ids = known.where("g is not null").groupBy("g").agg(F.min("vec_id").alias("low"))
    twice = known.where("g is not null").groupBy("vec_id").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b")
    if twice.limit(1).count():
        both = known.join(twice.select(F.col("vec_id").alias("v"), F.col("a").alias("to")), F.col("vec_id") == F.col("v")).where("g is not null")
        wider = components(both.select(F.col("g").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("g"), F.col("component").alias("w"))
        joined = ids.join(wider, "g", "left").select("g", "low", F.coalesce("w", "g").alias("w"))
        ids = joined.join(joined.groupBy("w").agg(F.min("low").alias("lowest")), "w").select("g", F.col("lowest").alias("low"))
    out = known.join(staged(ids.select(F.col("g").alias("h"), "low"), "ids"), F.col("g") == F.col("h"), "left")
    component = F.coalesce("low", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it is kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
