"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against every training window.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``width`` consecutive words
of a benchmark item; a shorter item is one window as a whole. The set holds a 64-bit hash of every window, the place of its
words in the items' text, and the items that have it. Tasks hash the words and windows of whole texts on byte arrays; a
window whose hash is in the set is verified by its words. So nothing is shuffled, and a passage that a third of all
documents share is no hot key.

The set is built from at most ``part_bytes`` of item text at a time, checked by a count before anything is collected. A
larger benchmark is cut into parts; every part is scanned by the same code, and the parts' findings of equal texts are put
together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mix64, staged

BLOCK = 1 << 19  # bytes that are hashed at a time
BUCKETS = 4096  # benchmark rows are dealt into so many buckets, which parts are made of
BITS = 22  # size of the bit table in front of the hashes of one width

LEAKS = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<first: long, last: long, start: long, stop: long>>>"


def _byte_table() -> np.ndarray:
    """Each byte as it counts in a word (A-Z lower-cased), 0 for bytes between words."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A"):ord("Z") + 1] += 32
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[low:high + 1] = 0
    return out


TABLE = _byte_table()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 2 * BLOCK), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def split_words(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``low`` (bytes through TABLE); words also end where a row starts (``cuts``)."""
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    ends[before] = inside[before]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Words from one number up to another that begin within BLOCK bytes of each other."""
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + BLOCK))
        yield at, to
        at = to


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every word: its bytes as a polynomial, read from running sums, then scrambled."""
    base, out = (0x9E3779B97F4A7C15 + (2 * seed << 20)) | 1, np.empty(len(starts), np.uint64)
    for at, to in _pieces(starts):
        first = starts[at]
        piece, a, b = low[first:ends[to - 1]], starts[at:to] - first, ends[at:to] - first
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _powers(base, len(piece)), out=sums[1:])
        back = _powers(pow(base, -1, 1 << 64), len(piece) + 1)
        # the length keeps words apart whose bytes alone give equal sums
        out[at:to] = mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    out = words[:len(words) - width + 1].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k:len(words) - width + 1 + k]
    return mix64(out)


def joined_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by a space, and where each starts and ends."""
    size = ends - starts
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    text = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
    for at, to in _pieces(starts):
        n = size[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text[np.repeat(start[at:to], n) + inside] = low[np.repeat(starts[at:to], n) + inside]
    return text.tobytes(), start, stop


@dataclass
class Windows:
    """The windows of one width: sorted hashes, a bit table of them, where each one's words lie, and which items hold it."""

    hashes: np.ndarray
    bits: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first_item: np.ndarray
    items: np.ndarray

    def held(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the set, and their places in the set."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - BITS)])
        found = np.searchsorted(self.hashes, hashes[at])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == hashes[at]
        return at[same], found[same]


@dataclass
class NgramSet:
    """Windows by width, the items' words and ids, and the length of the longest word."""

    seed: int
    width: int
    longest: int
    text: bytes
    ids: list[str]
    windows: dict[int, Windows]


def build_set(items: list[tuple[str, str]], width: int) -> NgramSet:
    """The set of (id, text) ``items``. No two different windows share a hash: the seed is changed until that holds."""
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    data = [t.encode() for _, t in items]
    cuts = np.cumsum([0, *map(len, data)])
    low = TABLE[np.frombuffer(b"".join(data), np.uint8)]
    starts, ends = split_words(low, np.unique(cuts[:-1][np.diff(cuts) > 0]))
    item = np.searchsorted(cuts, starts, "right") - 1
    text, start, stop = joined_words(low, starts, ends)
    owner = np.array([number[i] for i, _ in items], np.int64)
    n_words = np.bincount(item, minlength=len(items))
    for seed in range(64):
        words, windows, clear = word_hashes(low, starts, ends, seed), {}, True
        for w in sorted({min(int(n), width) for n in n_words if n}):
            # windows of this width: all of longer items, and items of just so many words
            at = np.flatnonzero((item[:len(item) - w + 1] == item[w - 1:]) & ((n_words[item[:len(item) - w + 1]] == w) | (w == width)))
            h = window_hashes(words, w)[at]
            order = np.lexsort((owner[item[at]], h))
            at, h = at[order], h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            head = at[new][np.cumsum(new) - 1]
            clear &= all(text[start[a]:stop[a + w - 1]] == text[start[b]:stop[b + w - 1]] for a, b in zip(at[~new], head[~new], strict=True))
            own = owner[item[at]]
            keep = new | np.concatenate([[True], own[1:] != own[:-1]])
            bits = np.zeros(1 << BITS, bool)
            bits[h >> np.uint64(64 - BITS)] = True
            rest = (start[at[new]], stop[at[new] + w - 1], np.append(np.flatnonzero(new[keep]), keep.sum()), own[keep])
            windows[w] = Windows(h[new], bits, *(x.astype(np.int32) for x in rest))  # a part has less than 2 GB of text
        if clear:
            return NgramSet(seed, width, int((ends - starts).max(initial=0)), text, ids, windows)
    raise RuntimeError("no seed keeps the windows apart")


def _hits(held: NgramSet, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Verified windows: (place of the first word, width, place in the set) of each."""
    if not len(starts):
        return np.empty((0, 3), np.int64)
    if len(low) > 4 * BLOCK:
        # giant words: what is longer than every word of the set can be cut, as it equals none
        size = np.minimum(ends - starts, held.longest + 1)
        low = low[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.cumsum(size)
        starts = ends - size
    words, out, joined = word_hashes(low, starts, ends, held.seed), [], None
    for w, windows in held.windows.items():
        if len(words) < w:
            continue
        at, place = windows.held(window_hashes(words, w))
        same = row[at] == row[at + w - 1]
        at, place = at[same], place[same]
        if len(at):
            text, start, stop = joined = joined or joined_words(low, starts, ends)
            true = [held.text[a:b] == text[c:d] for a, b, c, d in zip(
                windows.start[place].tolist(), windows.stop[place].tolist(), start[at].tolist(), stop[at + w - 1].tolist(), strict=True)]
            out.append(np.stack([at, np.full(len(at), w), place], 1)[true])
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def _blocks(held: NgramSet, low: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row of the block, verified hits) of rows cut at ``cuts``. A hit is (row, first word, width,
    place in the set, first byte, last byte + 1), counted from its row's start. Rows over BLOCK bytes are read in pieces
    that share ``width`` - 1 words."""
    r, n = 0, len(cuts) - 1
    while r < n:
        to = max(r + 1, int(np.searchsorted(cuts, cuts[r] + BLOCK, "right")) - 1)
        if to > r + 1 or cuts[to] - cuts[r] <= BLOCK:
            piece, at = low[cuts[r]:cuts[to]], cuts[r:to + 1] - cuts[r]
            starts, ends = split_words(piece, np.unique(at[:-1][np.diff(at) > 0]))
            row = np.searchsorted(at, starts, "right") - 1
            counts = np.bincount(row, minlength=to - r)
            hits = _hits(held, piece, starts, ends, row)
            k, last = hits[:, 0], hits[:, 0] + hits[:, 1] - 1
            mine = row[k]
            yield r, counts, np.stack([mine + r, k - (np.cumsum(counts) - counts)[mine], hits[:, 1], hits[:, 2], starts[k] - at[mine], ends[last] - at[mine]], 1)
        else:
            text, pos, base, size = low[cuts[r]:cuts[to]], 0, 0, BLOCK
            while True:
                end = pos + size
                while end < len(text) and text[end]:
                    gap = np.flatnonzero(text[end:end + BLOCK] == 0)
                    end += int(gap[0]) if len(gap) else BLOCK
                starts, ends = split_words(text[pos:end], np.zeros(1, np.int64))
                last = end >= len(text)
                if not last and len(starts) < 2 * held.width:
                    size *= 2
                    continue
                hits = _hits(held, text[pos:end], starts, ends, np.zeros(len(starts), np.int64))
                k = hits[:, 0]
                found = np.stack([np.full(len(k), r), k + base, hits[:, 1], hits[:, 2], starts[k] + pos, ends[k + hits[:, 1] - 1] + pos], 1)
                step = len(starts) if last else len(starts) - held.width + 1
                yield r, np.array([step]), found
                if last:
                    break
                base, pos, size = base + step, pos + int(starts[step]), BLOCK
        r = to


def scan_texts(held: NgramSet, texts: pa.Array) -> pa.Array:
    """LEAKS of every text of an Arrow array."""
    texts = texts.fill_null("").cast(pa.large_string())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0]:cuts[-1]] if len(texts) else np.empty(0, np.uint8)
    cuts = cuts - cuts[0] if len(texts) else np.zeros(1, np.int64)
    low, n_words, hits = TABLE[data], np.zeros(len(texts), np.int64), []
    for r, counts, found in _blocks(held, low, cuts):
        n_words[r:r + len(counts)] += counts
        hits.append(found)
    hits = np.unique(np.concatenate(hits), axis=0) if hits else np.empty((0, 6), np.int64)  # by row, first word, width
    n_hit, items, spans = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    for r, part in zip(*_runs(hits[:, 0], hits), strict=True):
        raw = data[cuts[r]:cuts[r + 1]].tobytes()
        spans[r] = _spans(part, raw)
        n_hit[r] = sum(s["last"] - s["first"] for s in spans[r])
        seen = np.unique(part[:, 2:4], axis=0)
        w = [held.windows[width] for width in seen[:, 0]]
        ids = np.unique(np.concatenate([x.items[x.first_item[k]:x.first_item[k + 1]] for x, k in zip(w, seen[:, 1], strict=True)]))
        items[r] = [held.ids[k] for k in ids]
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], names=["n_words", "n_hit", "items", "spans"])


SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "stop")]))


def _runs(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows by their sorted keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at].tolist(), np.split(rows, at[1:]) if len(at) else []


def _spans(hits: np.ndarray, raw: bytes) -> list[dict]:
    """The merged spans of a row's hits, in words and in characters."""
    first, last, low, high = hits[:, 1], hits[:, 1] + hits[:, 2], hits[:, 4], hits[:, 5]
    reach, far = np.maximum.accumulate(last), np.maximum.accumulate(high)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)
    out, at, chars = [], 0, 0
    for a, b, lo, hi in zip(first[new].tolist(), reach[ends].tolist(), low[new].tolist(), far[ends].tolist(), strict=True):
        chars += len(raw[at:lo].decode())
        start, at = chars, lo
        chars += len(raw[at:hi].decode())
        at = hi
        out.append({"first": a, "last": b, "start": start, "stop": chars})
    return out


def merge_leaks(parts: list[dict]) -> dict:
    """What several parts of the set found in one text, put together."""
    spans: list[dict] = []
    for s in sorted((s for p in parts for s in p["spans"]), key=lambda s: (s["first"], s["last"])):
        if spans and s["first"] <= spans[-1]["last"]:
            if s["last"] > spans[-1]["last"]:
                spans[-1] |= {"last": s["last"], "stop": s["stop"]}
        else:
            spans.append(dict(s))
    return {"n_words": parts[0]["n_words"], "n_hit": sum(s["last"] - s["first"] for s in spans),
            "items": sorted({i for p in parts for i in p["items"]}), "spans": spans}


def benchmark_parts(benchmark: DataFrame, part_bytes: int) -> tuple[DataFrame, list[list[int]]]:
    """(item, text, bucket) rows, each once, and the buckets of every part: at most ``part_bytes`` of text, or one bucket."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null").distinct()
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(BUCKETS)).cast("int"))
    sizes = items.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("bucket").collect()  # BUCKETS rows at most
    parts, room = [], 0
    for row in sizes:
        if not parts or room < row.n:
            parts.append([])
            room = part_bytes
        parts[-1].append(row.bucket)
        room -= row.n
    return items, parts


def _scan(texts: Column, held) -> Column:
    @F.arrow_udf(LEAKS)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield scan_texts(held.value, part)

    return scan(texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_bytes: int = 1 << 24) -> DataFrame:
    """(document, leaks) for every row of ``docs``: ``document`` is the row as it came, so no name of it can clash, and
    ``leaks`` has n_words, n_hit (words inside an occurring window), items (ids with occurring windows, sorted as strings)
    and spans (hit words from ``first`` up to ``last``, characters from ``start`` up to ``stop``, both from 0).

    Null and empty texts have no words; so do texts of separators only. Items without words have no windows; rows that share
    an item_id are one item, and rows without one are one item whose id reads as the empty string. Repeated documents are
    judged alike, each on its own row. An empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    items, parts = benchmark_parts(benchmark, part_bytes)

    def held(buckets):
        rows = items.where(F.col("bucket").isin(buckets)).select("item", "text").collect() if buckets else []  # at most part_bytes of text
        return spark.sparkContext.broadcast(build_set([(r.item, r.text) for r in rows], width))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    text = F.coalesce(F.col("document.text"), F.lit(""))
    if len(parts) <= 1:
        return whole.withColumn("leaks", _scan(text, held(parts[0] if parts else [])))
    digest = F.sha2(text.cast("binary"), 256)
    found = None
    for buckets in parts:
        part = staged(whole.select(digest.alias("digest"), _scan(text, held(buckets)).alias("leaks")).groupBy("digest").agg(F.first("leaks").alias("leaks")), "leaks")
        found = part if found is None else found.unionByName(part)

    @F.udf(LEAKS)
    def merged(parts):  # one entry for each part of the benchmark
        return merge_leaks([p.asDict(recursive=True) for p in parts])

    found = staged(found.groupBy("digest").agg(F.collect_list("leaks").alias("parts")).select("digest", merged("parts").alias("leaks")), "merged")
    return whole.withColumn("digest", digest).join(found, "digest").select("document", "leaks")


def without_spans(found: DataFrame) -> DataFrame:
    """The documents of ``find_leaks`` with all hit spans cut out of ``text``; null text stays null."""
    spans, text = F.col("leaks.spans"), F.col("document.text")
    # the characters between the end of span i - 1 and the start of span i
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(
        text, F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0).cast("int") + 1,
        (F.coalesce(F.get(spans, i)["start"], F.length(text).cast("long")) - F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)).cast("int")))
    cut = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)
    return found.select(F.col("document").withField("text", cut).alias("document")).select("document.*")


def without_documents(found: DataFrame, share: float = 0.0) -> DataFrame:
    """The documents of ``find_leaks`` whose share of hit words is at most ``share``."""
    return found.where(F.col("leaks.n_hit") <= F.lit(share) * F.col("leaks.n_words")).select("document.*")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "document.doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lists AS (SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM doc),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
wins AS (SELECT DISTINCT item, len, array_to_string(words[i : i + len - 1], ' ') AS win
         FROM (SELECT item, words, least(len(words), 10) AS len, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
               FROM items WHERE len(words) > 0)),
tokens AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists),
ahead AS (SELECT r, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o,
                        lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o] AS ws
          FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
hits AS (SELECT r, i, len, item FROM (
           SELECT r, i, l.len, CASE WHEN ws[l.len] IS NOT NULL THEN array_to_string(ws[1 : l.len], ' ') END AS win
           FROM ahead, (SELECT DISTINCT len FROM wins) AS l) AS d JOIN wins USING (len, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT r, i, len FROM hits)) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lists LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
