import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidewatch.llm import packing as K

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(PATH)


def check(rows, texts, library, window=2048):
    """Every id of every row in one piece, pieces gapless in their sequence; the padding share."""
    want = sorted((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in texts) if None not in [i for i, _ in texts] else None
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    if want is not None and len({i for i, _ in texts}) == len(texts):
        assert set(pieces) == {i for i, _ in texts}
        for i, data in want:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(data[4 * at:4 * (at + r.length)]) and r.doc_tokens == len(data) // 4
                at += r.length
            assert at == len(data) // 4
    total = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else window)
    return 1 - total / padded if padded else 0


def test_ids_equal_the_library(library):
    ids = K.ByteIds(PATH)
    assert ids.fast is not None
    for t in ["", "a" * 20_000, " " * 9000, "<|endoftext|>x  \n\n y", "é́🙂\x00 ' s", "　a" * 3000, words(1, 5000)]:
        assert ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_awkward_documents(spark, library):
    texts = [(0, None), (1, ""), (2, "x"), (3, words(1, 40_000)), (4, "a b"), (-1, "a" * 30_000)] + [(10 + i, words(i, 5 * i)) for i in range(150)]
    docs = documents(spark, texts).withColumn("length", F.lit("mine")).withColumn("rank", F.lit(0))
    rows = K.pack_documents(docs, PATH, bucket_rows=20).collect()
    assert check(rows, texts, library) < 0.05


def test_repeated_rows_null_ids_and_empty_table(spark, library):
    texts = [(1, "same text")] * 300 + [(None, "no id"), (2, None), (2, "other")]
    rows = K.pack_documents(documents(spark, texts), PATH).collect()
    check(rows, texts, library)
    assert len(rows) == 303 and sum(r.doc_id is None for r in rows) == 1
    assert K.pack_documents(documents(spark, []), PATH).collect() == []


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    for units in (8, 64, 256):
        histogram = {int(u): int(n) for u, n in zip(range(1, units + 1), rng.integers(0, 200, units), strict=True)}
        used, plan = dict.fromkeys(histogram, 0), K.plan(histogram, units)
        for combo, n in plan:
            assert sum(combo) <= units and n > 0
            for u in combo:
                used[u] += n
        assert used == histogram
        sequences = sum(n for _, n in plan)
        # two pieces over half a window can't share one
        least = max(sum(u * n for u, n in histogram.items()) / units, sum(n for u, n in histogram.items() if 2 * u > units))
        assert sequences <= 1.08 * least + 3


def test_least_squares_are_not_negative():
    columns = K.combinations(list(range(1, 17)), 16)
    counts = np.array([0, *([7] * 16)])
    x = K.nnls(columns, counts)
    residual = counts - np.bincount([u for c, v in zip(columns, x, strict=True) for u in c], [v for c, v in zip(columns, x, strict=True) for _ in c], 17)
    assert (x >= 0).all() and all(sum(residual[u] for u in c) < 1e-3 for c in columns)


def test_sequences_hold_the_ids(spark, library):
    texts = [(i, words(i, 400 * i)) for i in range(12)]
    docs = documents(spark, texts)
    placed = K.pack_documents(docs, PATH)
    made = {r.sequence_id: r.ids for r in K.sequences(docs, placed, PATH).collect()}
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    for r in placed.collect():
        assert made[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id][r.start:r.start + r.length]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(K.query(spark, sf).collect(), texts, library) < 0.03
