"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Sketch: a document's set of five-word shingles is hashed once; the ``k`` smallest hashes are its sketch. Rows with
   equal sets form a class, and only one row per class goes on.
2. Inverted lists of retained values. Only values that two classes retain matter. With similarity s >= 0.75 two sketches
   share at least ``c`` of their retained values (exactly for sets that fit in their sketch, else with the margin below),
   so two such classes share one of the ``len - c + 1`` rarest values of each: the lists hold those alone. A passage that
   many documents share is frequent, so it stays out of the lists unless it makes up much of a document.
3. Links are wanted only as far as they join groups. First every list compares its members with its first member, one
   pair per member. The sketch of the union (the k smallest of both) estimates the similarity and filters the pairs; the
   full sets of the others are made again from the texts and compared exactly. Linked members become one group.
4. Lists whose other members still lie in several groups compare them across groups, in cells of bounded size: members
   come with their full sets, sketches that share too few values are skipped, and the rest are compared exactly by one
   product of 0-1 matrices. A cell returns one link per group, never pairs, so a group of thousands of near copies makes
   rows in proportion to its size.

Margin: with k = 64 and similarity 0.75, the shared part of the union's sketch is binomial with mean 48 and deviation
3.5; ``c = 32`` and the same bound in the filter are 4.6 deviations below (a chance of about 1e-5 at exactly 0.75, less
above).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import among, batches, components, mix64, staged

K = 64
SHARED = 32  # retained values that two similar sketches share at least, of K
WORDS = 5
CELL = 500_000  # shingles of one side of a cell
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes (int64) of the shingles of each text; empty without words."""
    split = [(t or "").encode().lower().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [w for ws in split for w in ws]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        rolled += mix64(h[j:j + len(rolled)] + ODD[j]) * ODD[j]
    rolled = mix64(rolled).view(np.int64)
    out, at = [], 0
    for ws, n in zip(split, lengths, strict=True):
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        elif n:
            whole = xxhash.xxh3_64_intdigest(b" ".join(ws), seed=int(n))
            out.append(np.array([whole], np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, same binary, sketch array<long>): ``same`` is equal for equal sets, null without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 500):
            sets = shingle_sets(frame["text"].tolist())
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64").array, "n_shingles": [len(s) for s in sets],
                "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sketch": [s[:k] for s in sets],
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, same binary, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int, shared: int) -> DataFrame:
    """(value, rep, n): the rarest retained values of each class, without those that no other class retains."""
    held = F.least(F.col("n"), F.lit(k))
    need = F.when(held * 4 >= 3 * k, F.least(F.ceil(held * 0.75), F.lit(shared))).otherwise(F.ceil(held * 0.75))
    sizes = classes.select(F.col("rep").alias("r"), "n", (held - need + 1).alias("prefix"), held.alias("held"))
    values = classes.select("rep", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1").select(F.col("value").alias("v"), "often")
    common = values.join(often, F.col("value") == F.col("v")).drop("v")
    # a class's values are at most k: its other values occur once and come first among the rarest
    by_rarity = common.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("vs"))
    by_rarity = by_rarity.join(sizes, F.col("rep") == F.col("r"))
    left = F.col("prefix") - (F.col("held") - F.size("vs"))
    return by_rarity.where(left > 0).select("rep", "n", F.explode(F.slice("vs", F.lit(1), left.cast("int"))).alias("x")).select("x.value", "rep", "n")


def similar_sizes(a: str, b: str):
    """Whether the sizes ``a`` and ``b`` allow similarity 0.75."""
    return (F.col(a) * 4 >= F.col(b) * 3) & (F.col(b) * 4 >= F.col(a) * 3)


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, full array<long>): the sorted sets of the classes named in ``wanted`` (w), made again from the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches([frame], 500):
                yield pd.DataFrame({"doc": part["doc_id"].array, "full": shingle_sets(part["text"].tolist())})

    own = among(classes, "rep", wanted).select("rep", F.col("doc").alias("d"), F.col("n").alias("size"), F.col("sketch").alias("own"))
    texts = among(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", own.select(F.col("d").alias("w")).distinct())
    sets = texts.mapInPandas(run, "doc long, full array<long>")
    # rows of one id may differ: a class's own text is the one that gives its sketch
    sets = sets.join(own, F.col("doc") == F.col("d")).where((F.size("full") == F.col("size")) & (F.slice("full", 1, k) == F.col("own")))
    return sets.select("rep", "full").dropDuplicates(["rep"])


def similar_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, shared: int) -> DataFrame:
    """The ``pairs`` (a, b) whose similarity is at least 0.75: estimated by the union's sketch, confirmed on full sets."""
    either = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    sk = staged(among(classes.select("rep", "n", "sketch"), "rep", either), "compared")
    both = pairs.join(sk.toDF("a", "n_a", "s_a"), "a").join(sk.toDF("b", "n_b", "s_b"), "b")
    # the union's sketch is the k smallest of the two sketches; its shared part lies below its end
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.array_intersect("s_a", "s_b")
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    exact = 100 * F.size(common) >= 75 * F.size(F.array_union("s_a", "s_b"))
    estimate = F.size(F.array_intersect(union, common)) >= F.least(F.lit(shared), F.floor(F.size(union) * shared / F.lit(float(k))))
    near = staged(both.where(F.when(whole, exact).otherwise(estimate)).select("a", "b", whole.alias("sure")), "pairs")
    open_ = near.where("not sure").select("a", "b")
    wanted = open_.select(F.col("a").alias("w")).unionByName(open_.select(F.col("b").alias("w"))).distinct()
    sets = staged(full_sets(docs, classes, wanted, k), "sets")
    pairs = open_.join(sets.toDF("b", "f_b"), "b").join(sets.toDF("a", "f_a"), "a")
    meet = F.size(F.array_intersect("f_a", "f_b"))
    confirmed = pairs.where(100 * meet >= 75 * (F.size("f_a") + F.size("f_b") - meet)).select("a", "b")
    return near.where("sure").select("a", "b").unionByName(confirmed)


def overlaps(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray, columns: int = 4096) -> np.ndarray:
    """|sets[i] & sets[j]| for i in ``rows``, j in ``others``: 0-1 matrices over the values held at least twice, in strips."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    held = times[column] > 1
    owner, column = owner[held], number[column[held]]
    out = np.zeros((len(rows), len(others)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[rows] @ m[others].T
    return out


def _across(k: int, shared: int):
    """Links between the groups of one cell: (a, b) from each group to the smallest one it reaches within the cell."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        group, side = cell["g"].to_numpy(), cell["side"].to_numpy()
        sets = [np.asarray(s) for s in cell["full"]]
        size = np.array([len(s) for s in sets])
        names, member, held = np.unique(group, return_inverse=True, return_counts=True)
        # the members of the cell's largest group needn't be compared with each other
        rows, others = np.flatnonzero(member != held.argmax()), np.arange(len(sets))
        found = np.empty((0, 2), np.int64)
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            near = (member[part][:, None] != member) & (4 * size[part][:, None] >= 3 * size) & (4 * size >= 3 * size[part][:, None])
            if side.min() != side.max():
                near &= side[part][:, None] != side
            if near.any():
                whole = np.minimum(size[part][:, None], size) * 4 < 3 * k
                common = overlaps([s[:k] for s in sets], part, others)
                near &= whole | (common >= shared)
            i, j = np.nonzero(near)
            if len(i):
                left, right = np.unique(i), np.unique(j)
                used = np.union1d(part[left], right)
                meet = overlaps([sets[u] for u in used], np.searchsorted(used, part[left]), np.searchsorted(used, right))
                both = meet[np.searchsorted(left, i), np.searchsorted(right, j)]
                linked = 100 * both >= 75 * (size[part[i]] + size[j] - both)
                found = np.unique(np.concatenate([found, np.stack([member[part[i[linked]]], member[j[linked]]], 1)]), axis=0)
        root = np.arange(len(names))
        while len(found):
            low = np.minimum(root[found[:, 0]], root[found[:, 1]])
            new = root.copy()
            np.minimum.at(new, found[:, 0], low)
            np.minimum.at(new, found[:, 1], low)
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(names))
        return pd.DataFrame({"a": names[root[moved]], "b": names[moved]})

    return run


def links_across(lists: DataFrame, first: DataFrame, group: DataFrame, classes: DataFrame, docs: DataFrame, k: int, shared: int) -> DataFrame:
    """(a, b) between groups that a list holds together and whose members are similar, beyond the list's first member."""
    own = lists.join(group.select(F.col("node").alias("m"), "component"), F.col("rep") == F.col("m"), "left").select(
        "value", "rep", "n", F.coalesce("component", "rep").alias("g"))
    others = own.join(first.select("v", "a"), (F.col("value") == F.col("v")) & (F.col("rep") != F.col("a")))
    open_ = others.groupBy("value").agg(
        F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"),
        F.sum("n").alias("total")).where("low <> high")
    # lists with the same members are one
    open_ = open_.groupBy("members", "sum").agg(F.min("value").alias("v"), F.max("total").alias("total")).select(
        "v", F.ceil(F.col("total") / CELL).cast("int").alias("sides"))
    held = staged(others.drop("v").join(staged(open_, "open"), F.col("value") == F.col("v")).select("value", "rep", "g", "sides"), "held")
    sets = staged(full_sets(docs, classes, held.select(F.col("rep").alias("w")).distinct(), k), "sets")
    rows = held.join(sets.toDF("r", "full"), F.col("rep") == F.col("r")).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cells = rows.select("value", "g", "side", "full", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    return cells.groupBy("value", "low", "high").applyInPandas(_across(k, shared), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K, shared: int = SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A row's set: the distinct five-word shingles of its whole text, A-Z lower-cased, words being runs of other than ASCII
    white space; the whole sequence as one with fewer words. Rows are linked when 100 * |intersection| >= 75 * |union|;
    component_id is the smallest doc_id reachable. Null, empty and blank texts have an empty set and are linked with
    nothing. Rows sharing a doc_id are one document: what one is linked with, all are. Rows without doc_id are compared
    with nothing, get a null component and are kept. Other columns are not used.
    """
    rows = staged(sketches(docs, k), "sketches")  # tasks make it once; all later steps but the full sets start here
    ids = rows.where("doc_id is not null and same is not null")
    rep = ids.groupBy("same").agg(F.min("doc_id").alias("doc"))
    # a class is named by its smallest id; ids whose rows have different sets name none, and link the classes they lie in
    several = ids.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select(F.col("doc_id").alias("w"))
    several = staged(several, "several")
    torn = several.limit(1).count() > 0
    if torn:
        named = rep.join(several, F.col("doc") == F.col("w"), "left")
        rep = named.select("same", "doc", F.when(F.col("w").isNull(), F.col("doc")).otherwise(F.xxhash64("same")).alias("rep"))
    else:
        rep = rep.withColumn("rep", F.col("doc"))
    rep = staged(rep.select(F.col("same").alias("s"), "doc", "rep"), "names")
    # one row per class: the row of its smallest id
    classes = ids.join(rep, (F.col("same") == F.col("s")) & (F.col("doc_id") == F.col("doc")))
    classes = staged(classes.select("rep", "doc", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep"]), "classes")
    known = ids.join(several, F.col("doc_id") == F.col("w"), "left_semi").join(rep, F.col("same") == F.col("s")).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()

    lists = staged(inverted_lists(classes, k, shared), "lists")
    first = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("hub")).select(
        F.col("value").alias("v"), F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"))
    hubs = lists.join(first, F.col("value") == F.col("v")).where((F.col("a") < F.col("rep")) & similar_sizes("n_a", "n"))
    links = similar_pairs(hubs.select("a", F.col("rep").alias("b")).distinct(), classes, docs, k, shared)
    links = staged(links.unionByName(known), "links")
    group = staged(components(links), "groups")

    more = links_across(lists, first, group, classes, docs, k, shared)
    group = staged(components(links.unionByName(more)), "groups")

    # by id: a row's class leads to its group
    by_same = rep.join(group.select(F.col("node").alias("m"), "component"), F.col("rep") == F.col("m"), "left").select(
        "s", F.coalesce("component", "rep").alias("found"))
    done = rows.join(by_same, F.col("same") == F.col("s"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    if torn:  # groups may be named by a class without a name of its own, and a torn id may have an empty set as well
        lowest = done.where("doc_id is not null").groupBy(F.col("component_id").alias("c")).agg(F.min("doc_id").alias("lowest"))
        done = done.join(lowest, F.col("component_id") == F.col("c"), "left")
        done = done.withColumn("component_id", F.min("lowest").over(Window.partitionBy("doc_id"))).withColumn(
            "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).select("doc_id", "n_shingles", "component_id")
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its set size, component and whether it is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
