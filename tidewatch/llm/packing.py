"""Packing token sequences by non-negative least squares over the histogram of piece lengths.

1. Tokenize (one pass, staged): a document's ids and an end id are cut into full windows and one rest. Only lengths and
   checksums leave the tasks.
2. Lengths are counted in units of ``window`` / ``units`` tokens, rounded up. The histogram has ``units`` bins whatever
   the corpus, so the plan is made on the driver: all combinations of up to three lengths that fill a window are the
   columns of a matrix, non-negative least squares finds how often to use each, counts are rounded to what is there, and
   the residual bins are packed greedily, largest first, each gap filled with the largest that fits.
3. Pieces get a rank within their length (counted in hashed buckets, so one frequent length makes many tasks) and find
   their sequence by rank in the broadcast plan, whose size the units bound.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import byte_alphabet
from tidewatch.llm.common import staged

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
LONG_RUN = 5_000  # longer stretches without white space go to the library that handles them in linear time


class ByteIds:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, special tokens in the text included.

    The same vocabulary is run by ``tiktoken``, which is several times faster, when the file allows it: ids in merge
    order and the usual byte-level splitting."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if in_order and usual and plain and not model.get("ignore_merges"):
            import tiktoken

            byte = {c: b for b, c in byte_alphabet().items()}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
            # the byte-level splitting rule, a fixed value
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) > LONG_RUN and max(map(len, text.split() or [text])) > LONG_RUN:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@lru_cache(maxsize=2)
def load(path: str) -> ByteIds:
    return ByteIds(path)


def document_pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """One row per piece: full windows of the document's ids, then the rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = load(path)
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = ids_of(text or "").tobytes() + end
                n = len(data) // 4
                out += [(doc_id, s, min(window, n - s), zlib.crc32(data[4 * s:4 * (s + window)]), n) for s in range(0, n, window)]
            out = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECE)


def nnls(columns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """How often to use each column so that the squared distance of the lengths used to ``counts`` (by length, from 0) is
    least and no column is used less than 0 times: the active-set method, one column entering at a time. Columns have
    three entries at most, so gains are sums of three residuals; each solve is as large as the active set."""
    index = np.array([(*c, *[0] * (3 - len(c))) for c in columns])
    weight = (index > 0).astype(float)
    b = counts.astype(float)
    b[0] = 0
    x, active = np.zeros(len(columns)), np.zeros(len(columns), bool)
    tolerance = 1e-9 * max(1.0, float(b.max(initial=0)))
    for _ in range(3 * len(b)):
        residual = b - np.bincount(index.ravel(), (weight * x[:, None]).ravel(), len(b))
        gain = (residual[index] * weight).sum(1)
        gain[active] = -np.inf
        if gain.max() <= tolerance:
            break
        active[int(gain.argmax())] = True
        while True:
            on = np.flatnonzero(active)
            a = np.zeros((len(b), len(on)))
            np.add.at(a, (index[on], np.arange(len(on))[:, None]), weight[on])
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(on)), a.T @ b)  # the ridge keeps dependent columns solvable
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            bad = z <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - z[bad], 1e-300))
            x[on] += step * (z - x[on])
            x[on[(x[on] <= 1e-12) & bad]] = 0
            active[:] = x > 0
    return x


def combinations(lengths: list[int], total: int) -> list[tuple[int, ...]]:
    """All combinations of one to three of ``lengths`` (descending) that add up to ``total``."""
    there, out = set(lengths), []
    for i in sorted(there, reverse=True):
        if i == total:
            out.append((i,))
        for j in range(min(i, total - i), 0, -1):
            k = total - i - j
            if j in there and k == 0:
                out.append((i, j))
            elif j in there and 0 < k <= j and k in there:
                out.append((i, j, k))
    return out


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination of unit lengths, repeats) that use up the histogram exactly."""
    left = np.zeros(units + 1, np.int64)
    for u, n in histogram.items():
        left[u] = n
    columns = combinations([u for u in histogram if histogram[u]], units)
    used: list[tuple[tuple[int, ...], int]] = []
    if columns:
        x = nnls(columns, left)
        for c in np.argsort(-x, kind="stable"):
            need = np.bincount(columns[c], minlength=units + 1)
            have = int(min(left[u] // need[u] for u in set(columns[c])))
            n = min(int(round(x[c])), have)
            if n > 0:
                used.append((columns[c], n))
                left -= n * need
    while left.any():
        take, gap = {}, units
        while gap:
            fits = np.flatnonzero(left[:gap + 1])
            fits = [u for u in fits[::-1] if u not in take]
            if not fits:
                break
            u = int(fits[0])
            take[u] = int(min(gap // u, left[u]))
            gap -= take[u] * u
        n = int(min(left[u] // m for u, m in take.items()))
        used.append((tuple(u for u, m in take.items() for _ in range(m)), n))
        for u, m in take.items():
            left[u] -= n * m
    return used


def place(pieces: DataFrame, window: int, units: int, bucket_rows: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    unit = F.ceil(F.col("length") * units / F.lit(float(window))).cast("int")
    total = pieces.count()
    buckets = max(16, -(-total // bucket_rows))
    p = pieces.withColumn("unit", unit).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = p.groupBy("unit", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.unit: r.n for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}  # at most `units` rows
    slots, sequence, ranks = [], 0, dict.fromkeys(range(units + 1), 0)
    for combo, n in plan(histogram, units):
        for position, u in enumerate(combo):
            slots.append((u, ranks[u], ranks[u] + n, sequence, position))
            ranks[u] += n
        sequence += n
    slot = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "u int, low long, high long, first long, position int")
    before = F.sum("n").over(Window.partitionBy("unit").orderBy("bucket")) - F.col("n")
    start = counts.withColumn("before", before).select(F.col("unit").alias("u2"), F.col("bucket").alias("b2"), "before")
    own = F.row_number().over(Window.partitionBy("unit", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = p.withColumn("own", own).join(start, (F.col("unit") == F.col("u2")) & (F.col("bucket") == F.col("b2")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(F.broadcast(slot), (F.col("unit") == F.col("u")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
    # a sequence holds at most `units` pieces
    upto = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, units: int = 256, bucket_rows: int = 100_000
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens.

    doc_id, start, length, ids_crc32 (of the ids as little-endian 32-bit), doc_tokens, sequence_id, offset. A document is
    its ids by the tokenizer file at ``path`` followed by ``end_id``; it is cut only at multiples of ``window``. Every id
    lies in one piece; pieces of a sequence touch; the rest of a sequence is padding (none at a power of two).

    Null or empty text: the end id alone. Repeated rows and ids: each row is packed on its own. Rows without doc_id are
    packed, with a null id. No documents: no rows. Columns other than doc_id and text are not used.
    """
    return place(staged(document_pieces(docs, path, window, end_id), "pieces"), window, units, bucket_rows)


def sequences(docs: DataFrame, placed: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, without padding, for documents with distinct ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = load(path)
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(ids_of(text or ""), end_id).tolist()
                out += [(doc_id, s, ids[s:s + window]) for s in range(0, len(ids), window)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "ids"])

    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, start long, ids array<int>")
    parts = cut.join(placed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    gathered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return gathered.select("sequence_id", F.flatten("p.ids").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
