"""Vector code compression: product codes on integer components, with equal-average search of the nearest entry.

A vector becomes integers and is cut into equal parts; each part position has a codebook, and a part's code is the index of
its nearest entry. Entries are searched in the order of their component sums. By Cauchy and Schwarz the squared distance of
a part from an entry is at least the squared gap of their sums over the part's dimension, so the search starts at the part's
own sum, goes outward on both sides, and ends on a side once that bound strictly exceeds the best distance; an entry at an
equal distance may still win by its lower index. Everything is exact in integers.

A round sends one row of sums for each codebook entry and task, so neither a hot label nor many copies of a vector are one
task's work. Codebooks have ``entries`` x dimension numbers, a bound set by parameters, and travel as a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import staged

ROWS = 4096  # rows of a batch that are searched at a time


def equal_average_search(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest of ``entries`` for each row of ``parts``, ties to the lower index, and its squared distance."""
    n, dim = parts.shape
    order = np.argsort(entries.sum(1), kind="stable")
    book, sums = entries[order], entries.sum(1)[order]
    mine = parts.sum(1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    middle = np.searchsorted(sums, mine)
    for start, step in ((middle, 1), (middle - 1, -1)):
        live, at = np.arange(n), start
        while True:
            inside = (at >= 0) & (at < len(book))
            live, at = live[inside], at[inside]
            # out of reach: gap^2 / dim > best, without a division
            gap = np.abs(sums[at] - mine[live])
            near = (best[live] == np.iinfo(np.int64).max) | (gap * gap <= best[live] * dim)
            live, at = live[near], at[near]
            if not len(live):
                break
            d = ((parts[live] - book[at]) ** 2).sum(1)
            better = (d < best[live]) | ((d == best[live]) & (order[at] < index[live]))
            best[live[better]], index[live[better]] = d[better], order[at][better]
            at = at + step
    return index, best


def limit_of(dim: int) -> int:
    """Components up to this magnitude keep all squares and their sums within 64 bits."""
    return int(np.sqrt(2**61 / dim / 4))


def integers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row for each vector of the Arrow list array."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() > limit_of(dim):
        raise ValueError(f"components over {limit_of(dim) / scale:.0f} don't keep distances within 64 bits")
    return out.astype(np.int64).reshape(len(vectors), dim)


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    value = vector.cast("array<double>")
    return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_entries(vectors: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The vectors of the ``entries`` smallest vec_ids as doubles, ascending; rows without vec_id come last, rows of one id
    go by their components. Their common length must be a multiple of ``parts``."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if rows and (len(rows[0].v) % parts or any(len(r.v) != len(rows[0].v) for r in rows)):
        raise ValueError(f"vectors must be equally long and can't be cut into {parts} equal parts otherwise")
    return np.array([r.v for r in rows], np.float64)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows by part; ``books`` is part by entry by component."""
    width = books.shape[2]
    found = [equal_average_search(x[:, p * width:(p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _batches(frames: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for frame in frames:
        for at in range(0, frame.num_rows, ROWS):
            part = frame.slice(at, ROWS)
            yield part, integers(part.column("embedding"), dim, scale)


def train_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks, part by entry by component, after ``rounds`` of assigning all vectors and averaging (rounded down)."""
    first = first_entries(vectors, entries, parts)
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    books = integers(pa.array(list(first), pa.list_(pa.float64())), first.shape[1], scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    dim, width = first.shape[1], books.shape[2]
    spark = vectors.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def sums(frames: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books = held.value
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for _, x in _batches(frames, dim, scale):
                codes, _ = assign(x, books)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                    np.add.at(total[p], codes[:, p], x[:, p * width:(p + 1) * width])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
                                             names=["part", "entry", "n", "total"])

        partial = vectors.select("embedding").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        # one row for each entry comes to the driver
        whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
        books = books.copy()
        for r in whole.collect():
            books[r.part, r.entry] = np.array(r.total, np.int64) // r.n  # rounds down, below zero too
        held.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """(vector, code, error): ``vector`` is the row as it came, ``code`` one byte a part, ``error`` the squared distance of
    the vector from what its code stands for. At most 256 entries."""
    if books.shape[1] > 256:
        raise ValueError("a code byte tells at most 256 entries apart")
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("vector"))
    held, dim = vectors.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2]

    @F.arrow_udf("struct<code: binary, error: long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            codes, errors = [pa.array([], pa.binary())], [np.empty(0, np.int64)]
            for at in range(0, len(batch), ROWS):
                code, error = assign(integers(batch[at:at + ROWS], dim, scale), held.value)
                codes.append(pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()))
                errors.append(error.sum(1))
            yield pa.StructArray.from_arrays([pa.concat_arrays(codes), pa.array(np.concatenate(errors))], names=["code", "error"])

    return rows.withColumn("found", run(F.col("vector.embedding").cast("array<double>"))).select("vector", "found.code", "found.error")


def decode(code: Column, books: np.ndarray, scale: int) -> Column:
    """The vector that a code stands for: its entries' middles, joined (array<double>)."""
    spans = (books + 0.5) / scale

    @F.pandas_udf("array<double>")
    def run(codes: pd.Series) -> pd.Series:
        part = np.arange(len(spans))
        return pd.Series([None if c is None else spans[part, np.frombuffer(c, np.uint8)].ravel() for c in codes])

    return run(code)


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): ``rows`` has vector (the input row, so no name of it can clash), code and error of every usable
    row of ``vectors`` (vec_id, embedding, any others).

    Rows whose vector is null, empty, or holds null or non-finite components are dropped. Codebooks start from the usable
    vectors with the ``entries`` smallest vec_ids (fewer if there are fewer; rows without vec_id come last, rows of one id go
    by their components); repeated rows count each. Vectors of another length than these, lengths that ``parts`` does not
    divide, and components whose squares leave 64 bits are errors. An empty table gives no rows and empty codebooks.
    """
    kept = vectors.where(usable(F.col("embedding")))
    plain = kept.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    books = train_codebooks(plain, parts, entries, rounds, scale)
    return encode(kept, books, scale), books


def query(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    found, books = compress(vectors)
    rows = staged(found.select("vector.vec_id", "vector.label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    # one row for each label, summed before it is shuffled
    labels = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "labels")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    sql = ["""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64)"""]
    best = """best{k} AS (SELECT r, p, min(struct_pack(d := d, e := e)) AS b FROM (
  SELECT r, parts.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} AS b ON b.p = parts.p)
  GROUP BY r, p)"""
    book = """sums{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST(floor(s / n) AS BIGINT) - CASE WHEN CAST(floor(s / n) AS BIGINT) * n > s THEN 1 ELSE 0 END AS m FROM (
    SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
      SELECT parts.p, b.e AS e, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM parts JOIN best{k} USING (r, p)) GROUP BY p, e, i)) GROUP BY p, e),
book{n} AS (SELECT p, e, coalesce(s.c, o.c) AS c FROM book{k} AS o LEFT JOIN sums{k} AS s USING (p, e))"""
    for k in range(2):
        sql += [best.format(k=k), book.format(k=k, n=k + 1)]
    sql.append(best.format(k=2))
    sql.append("""coded AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM best2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)""")
    return ",\n".join(sql) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


SQL = _sql()
