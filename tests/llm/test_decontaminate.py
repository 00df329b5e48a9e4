"""Benchmark decontamination against a plain scan."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tidewatch.llm.decontaminate as D
from tests.llm.helpers import documents, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, width=10):
    """(words, hit places, ids of the items found)."""
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        n = min(width, len(own))
        windows = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add("" if item is None else str(item))
    return words, hit, sorted(found)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [
    (1, "The quick Brown fox jumps over the lazy dog, and then it sleeps for a while."), (2, "three short words"), (3, "É É"), (4, "..."), (5, None),
    (6, "the quick brown fox jumps over the lazy dog and then it wakes again"), (6, "three short words"), (None, "single"), (10, "x" * 3000 + " y"),
]


def texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma7", "ünï", "fox"]) for _ in range(n))
    long_item = ITEMS[0][1]
    return [
        None, "", " .,; ", "three short", "Three... SHORT\nwords", long_item, long_item.replace(" ", "\x00"), filler(30) + " " + long_item.upper() + " " + filler(5),
        "the quick brown fox jumps over the lazy dog and", "quick brown fox jumps over the lazy dog and then it wakes", "É é", "É É É", "x" * 3000 + " y", "x" * 2999 + " y",
        "single" * 2, "a single one", filler(400) + " three short words " + filler(400), "K three short words", "kK three short words",
    ]


def test_against_plain_scan(spark):
    docs = documents(spark, list(enumerate(texts())) + [(None, "three short words"), (7, texts()[7])])
    found = {(r.document.doc_id, r.document.text): r.leaks for r in D.find_leaks(docs, benchmark(spark, ITEMS)).collect()}
    for (doc_id, text), leaks in found.items():
        words, hit, ids = plain(text, ITEMS)
        assert (leaks.n_words, leaks.n_hit, list(leaks.items)) == (len(words), len(hit), ids), (doc_id, text)
        assert {k for s in leaks.spans for k in range(s.first, s.last)} == hit
        for s in leaks.spans:  # characters
            assert split(text[s.start:s.stop]) == words[s.first:s.last]
    assert len(found) == len(texts()) + 1 and D.find_leaks(docs, benchmark(spark, ITEMS)).count() == len(texts()) + 2


def test_parts_find_the_same(spark):
    """A benchmark over the bound is scanned in parts, and what they find is put together."""
    docs = documents(spark, list(enumerate(texts() * 2)))
    bench = benchmark(spark, ITEMS)
    assert len(D.benchmark_parts(bench, 60)[1]) > 2
    assert rows(D.find_leaks(docs, bench, part_bytes=60)) == rows(D.find_leaks(docs, bench))


@pytest.mark.parametrize("block", [16, 64, 1 << 19])
def test_blocks_and_giant_words(block, monkeypatch):
    """Rows are read in pieces; words longer than every item's are cut."""
    monkeypatch.setattr(D, "BLOCK", block)
    items = [(str(i), t) for i, t in ITEMS if t is not None]
    held = D.build_set(items, 10)
    all_texts = [t for t in texts()] + ["z" * 5000 + " three short words " + "q" * 700]
    for text, got in zip(all_texts, D.scan_texts(held, pa.array(all_texts)).to_pylist(), strict=True):
        words, hit, ids = plain(text, items)
        assert (got["n_words"], got["n_hit"], got["items"]) == (len(words), len(hit), ids), text


def test_random_overlaps():
    rng = random.Random(11)
    for _ in range(40):
        vocabulary = ["a", "b", "c", "ä"]
        items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 14)))) for i in range(6)]
        some = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(8)]
        held = D.build_set(items, 5)
        for text, got in zip(some, D.scan_texts(held, pa.array(some)).to_pylist(), strict=True):
            words, hit, ids = plain(text, items, 5)
            assert (got["n_words"], got["n_hit"], got["items"]) == (len(words), len(hit), ids)


def test_removal(spark):
    docs = documents(spark, [(0, "Before. THE quick brown fox jumps over the lazy dog, and then after"), (1, "clean"), (2, None), (3, "three short words"), (4, "é three short words é")])
    found = D.find_leaks(docs, benchmark(spark, ITEMS))
    cut = {r.doc_id: r.text for r in D.without_spans(found).collect()}
    assert cut == {0: "Before.  after", 1: "clean", 2: None, 3: "", 4: "é  é"}
    assert {r.doc_id for r in D.without_documents(found).collect()} == {1, 2}
    assert {r.doc_id for r in D.without_documents(found, 0.7).collect()} == {1, 2, 4}
    assert D.without_spans(found).columns == docs.columns


def test_empty_tables_and_clashing_names(spark):
    docs = documents(spark, [(0, "three short words")]).withColumn("leaks", F.lit(1)).withColumn("document", F.lit("d")).withColumn("digest", F.lit(2)).withColumn("parts", F.lit(3))
    empty = benchmark(spark, [])
    assert [(r.document.leaks, r.leaks.n_words, r.leaks.n_hit) for r in D.find_leaks(docs, empty).collect()] == [(1, 3, 0)]
    for part_bytes in (1, 1 << 25):
        found = D.find_leaks(docs, benchmark(spark, ITEMS), part_bytes=part_bytes)
        assert [(r.document.parts, r.leaks.n_hit, list(r.leaks.items)) for r in found.collect()] == [(3, 3, ["2", "6"])]
        assert D.without_spans(found).columns == docs.columns
        assert D.find_leaks(docs.limit(0), benchmark(spark, ITEMS), part_bytes=part_bytes).count() == 0


def test_query(spark, tmp_path):
    documents(spark, list(enumerate(texts()))).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in D.query(spark, str(tmp_path)).collect():
        words, hit, ids = plain(texts()[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
