"""Line dedup: two Bloom filters, for hashes seen once and seen twice; only suspected repeats are shuffled.

1. Every task turns its lines into filter bits: ``once`` holds the bits that one line of the task sets,
   ``twice`` those that two lines set. Bits travel as sorted positions within segments of the filter, and one
   pass per segment folds them into a bit map: a bit is in the merged ``twice`` filter if a task has it twice
   or two tasks have it at all. A line that two documents hold sets all its bits twice, so it is never missed.
2. The merged twice-seen filter (``filter_bits`` / 8 bytes, a fixed bound) is broadcast. Lines it doesn't hold
   stay; the digests of the others, suspected repeats, are shuffled and counted exactly.
3. Confirmed digests keep the largest document id; the others get the list of digests to drop.

When the corpus outgrows ``filter_bits`` the filter suspects more lines and more digests move; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ASCII_SPACE, spare_name, staged, unclaimed

SEGMENT_BITS = 20  # positions of one segment of the filter


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer white space, A-Z lower-cased; None if it is shorter than ``min_chars`` code points."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for line in split_lines(text) if (k := line_key(line, min_chars)) is not None}


def _bits(keys: list[bytes], filter_bits: int) -> np.ndarray:
    """Two filter positions per key, shape (keys, 2)."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(filter_bits - 1), (h >> np.uint64(32)) & np.uint64(filter_bits - 1)], 1).astype(np.int64)


def _partial(min_chars: int, filter_bits: int):
    """Task side: positions that this task's lines set once and more than once, by segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.empty(0, np.int64), np.empty(0, np.int64)
        for frame in frames:
            keys = [k for text in frame["text"] for k in _keys(text, min_chars)]
            if not keys:
                continue
            # both positions of one key may be equal: such a key counts them once
            pos = _bits(keys, filter_bits)
            pos = np.concatenate([pos[:, 0], pos[pos[:, 0] != pos[:, 1], 1]])
            seen, n = np.unique(pos, return_counts=True)
            twice = np.union1d(twice, np.concatenate([seen[n > 1], np.intersect1d(seen, once, assume_unique=True)]))
            once = np.union1d(once, seen)
        segment = once >> SEGMENT_BITS
        for s in np.unique(segment):
            mask = np.int64((1 << SEGMENT_BITS) - 1)
            lo, hi = s << SEGMENT_BITS, (s + 1) << SEGMENT_BITS
            two = twice[np.searchsorted(twice, lo):np.searchsorted(twice, hi)] & mask
            one = np.setdiff1d(once[np.searchsorted(once, lo):np.searchsorted(once, hi)] & mask, two, assume_unique=True)
            yield pd.DataFrame({"segment": [int(s)], "once": [one.astype("<u4").tobytes()], "twice": [two.astype("<u4").tobytes()]})

    return run


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by segment; memory is one segment's two bit maps."""
    now, one, two = None, None, None

    def done():
        return pd.DataFrame({"segment": [now], "bits": [np.packbits(two, bitorder="little").tobytes()]})

    for frame in frames:
        for segment, a, b in zip(frame["segment"], frame["once"], frame["twice"], strict=True):
            if segment != now:
                if now is not None:
                    yield done()
                now, one, two = segment, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
            a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            two[b] = True
            two[a[one[a]]] = True
            one[a] = True
            one[b] = True
    if now is not None:
        yield done()


def twice_filter(docs: DataFrame, min_chars: int, filter_bits: int) -> np.ndarray:
    """The merged twice-seen filter as packed bits: ``filter_bits`` / 8 bytes whatever the corpus."""
    parts = docs.select("text").mapInPandas(_partial(min_chars, filter_bits), "segment long, once binary, twice binary")
    # segments are even by hashing: a range of them per task, bounded by their number
    n = min(64, filter_bits >> SEGMENT_BITS) or 1
    merged = parts.repartition(n, "segment").sortWithinPartitions("segment").mapInPandas(_merge, "segment long, bits binary")
    out = np.zeros(max(filter_bits, 1 << SEGMENT_BITS) // 8, np.uint8)
    width = (1 << SEGMENT_BITS) // 8
    for row in merged.toLocalIterator():
        out[row.segment * width:(row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return out


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, digests): the SHA-256 digests of the lines that each document loses."""
    if filter_bits & (filter_bits - 1) or not 1 << SEGMENT_BITS <= filter_bits <= 1 << 31:
        raise ValueError("filter_bits must be a power of two from 2^20 to 2^31")
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    seen = spark.sparkContext.broadcast(twice_filter(docs, min_chars, filter_bits))

    def suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = seen.value
        for frame in frames:
            ids, out = [], []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                keys = list(_keys(text, min_chars))
                if keys:
                    pos = _bits(keys, filter_bits)
                    held = ((bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(1)
                    out += [hashlib.sha256(keys[i]).digest() for i in np.flatnonzero(held)]
                    ids += [doc_id] * int(held.sum())
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "digest": pd.Series(out, dtype=object)})

    found = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(suspects, "doc_id long, digest binary"), "suspects")
    # a document id that several rows share counts once
    counted = found.distinct().groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that the join below is between plain exchanges: a line that a third of all documents hold is then split
    confirmed = staged(counted.select(F.col("digest").alias("d"), "keeper"), "confirmed")
    return (
        found.join(confirmed, found.digest == confirmed.d).where("doc_id <> keeper")
        .groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bits: int = 1 << 27, column: str = "line_dedup") -> DataFrame:
    """``docs`` with the repeated lines removed from ``text``, and ``column`` (n_lines, n_dropped).

    A line's key is the line without outer ASCII white space, A-Z lower-cased. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` document ids hold lose all their lines, except in the largest id holding them
    (where all its lines with that key stay). Other lines stay, joined by a newline.

    Null and empty text: one empty line (text stays null if it was null). Rows that share a doc_id count as one
    document and are cut alike; rows without doc_id count for nothing and keep all lines. A document all of whose
    lines go gets an empty text. Other columns pass through under their names; a column named
    ``column`` is an error.
    """
    unclaimed(docs, column)
    key, drop, found = spare_name(docs, "__id"), spare_name(docs, "__drop"), spare_name(docs, "__cut")
    drops = repeated_lines(docs, min_chars, min_docs, filter_bits).select(F.col("doc_id").alias(key), F.col("digests").alias(drop))

    @F.pandas_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def cut(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for text, digests in zip(texts, drop, strict=True):
            lines = split_lines(text)
            kept = lines
            if digests is not None and len(digests):
                gone = {bytes(x) for x in digests}
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or hashlib.sha256(k).digest() not in gone]
                text = b"\n".join(kept).decode()
            out.append((text, len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(drops, F.col("doc_id").cast("long") == F.col(key), "left").withColumn(found, cut("text", drop))
    rest = [F.col(f"{found}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*rest, F.struct(f"{found}.n_lines", f"{found}.n_dropped").alias(column))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("line_dedup.n_lines"), F.col("line_dedup.n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
rep AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, rep.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines l LEFT JOIN rep ON l.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
