import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidewatch.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "Hello  World's ΣΑΣ", "<|startoftext|>abc<|endoftext|> <|startoftext |>", "é ́a ﬁ İ ǅ", "a" * 5000, "\x00\x1c\u0085 ​", "🙂👍🏽 ½² 中文字",
       words(3, 30_000), "'s't're've'm'll'd'S", "x" * 40 + "," * 300]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(PATH)


def fuzz(n):
    rng = random.Random(1)
    alphabet = [*"aAbBeE'stlldmvré́ÉßΣσς  ​ \n\t\x1c\u0085.,!?|09²½İıǅ中文字🙂\x00", "<|startoftext|>", "<|endoftext|>", "'ll", "é"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_equals_the_library(library):
    bpe = B.WordBpe(PATH, memo=50)  # the memo overflows all the time
    for t in ODD + fuzz(3000):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert bpe.encode(t) == want
        ids, decoded, n = bpe.spelled(t or "")
        assert (ids, decoded, n) == (" ".join(map(str, want)), library.decode(want, skip_special_tokens=False), len(want))


def test_queue_merges_by_rank_then_position():
    # a=0 b=1; (a,a) before (a,b); aa=2, ab=3
    ranks, made = {0: 0, 1: 1}, [2, 3]
    assert B.merge_word([0, 0, 0, 1], ranks, made) == [2, 3]
    assert B.merge_word([0, 1, 0, 1], ranks, made) == [3, 3]
    assert B.merge_word([], ranks, made) == [] and B.merge_word([1], ranks, made) == [1]


def test_documents(spark, library):
    docs = documents(spark, list(enumerate(ODD)) + [(0, "again"), (None, "no id")]).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(0))
    got = B.encode_documents(docs, PATH).collect()
    assert len(got) == len(ODD) + 2 and all(r.ids == "mine" for r in got)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens.ids == want and r.tokens.decoded == library.decode(want, skip_special_tokens=False)
    for r in B.token_digests(docs, PATH).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.digests.n_tokens == len(want) and r.digests.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert B.encode_documents(documents(spark, []), PATH).collect() == []


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for r in B.query(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
