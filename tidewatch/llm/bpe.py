"""Byte-pair encoding and decoding with a vocabulary file of the word-end kind.

A word's symbols form a doubly linked list; a priority queue holds the merge ranks of neighbouring symbols. The lowest
rank is popped first (leftmost among equals); entries whose symbols have changed since are stale and skipped. Decoding
looks the ids up in the vocabulary and joins their strings, as a tokenizer file without a decoder says.

Tasks encode whole texts. No token spans white space, so a text is cut at ASCII white space and each different chunk is
encoded once as long as the worker remembers it. What a worker remembers is bounded, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import unclaimed

MEMO = 250_000  # entries of a generation of what a worker remembers, about 80 MB


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is a printable Latin-1 character, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = (chr(0x100 + i) for i in range(256))
    out.update({b: next(spare) for b in range(256) if b not in out})
    return out


def merge_word(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols left when the queue is empty. ``ranks`` has the merge rank of a pair (a << 20 | b), ``made`` the symbol
    that each rank makes."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    rank = [ranks.get(ids[i] << 20 | ids[i + 1], -1) for i in range(n - 1)]  # of each symbol and its right neighbour now
    rank.append(-1)
    queue = [r * n + i for i, r in enumerate(rank) if r >= 0]  # lowest rank first, then leftmost
    heapify(queue)
    while queue:
        r, i = divmod(heappop(queue), n)
        if rank[i] != r:
            continue  # stale: one of the two has been merged since
        j = right[i]
        ids[i], ids[j], rank[j] = made[r], -1, -1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            rank[i] = r = ranks.get(ids[i] << 20 | ids[k], -1)
            if r >= 0:
                heappush(queue, r * n + i)
        else:
            rank[i] = -1
        h = left[i]
        if h >= 0:
            rank[h] = r = ranks.get(ids[h] << 20 | ids[i], -1)
            if r >= 0:
                heappush(queue, r * n + h)
    return [x for x in ids if x >= 0]


class Memo:
    """The last ``limit`` to twice as many entries: a full generation becomes the old one, whose entries that are used
    again move on, so frequent entries stay."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordBpe:
    """The encoder that a tokenizer file describes: normalisation, splitting, merge ranks, vocabulary."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a BPE file of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        prefix = len(model.get("continuing_subword_prefix") or "")
        self.made = [self.vocab[a + b[prefix:]] for a, b in merges]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.alphabet = byte_alphabet()
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # symbols that the vocabulary lacks are left out
        self.inner = [self.vocab.get(self.alphabet[b]) for b in range(256)]
        self.last = [self.vocab.get(self.alphabet[b] + self.end) for b in range(256)]
        self.memo, self.words = Memo(memo), Memo(memo)  # chunk -> what spelled() needs; word -> ids

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            data = word.encode()
            symbols = [x for b in data[:-1] if (x := self.inner[b]) is not None]
            if (x := self.last[data[-1]]) is not None:
                symbols.append(x)
            ids = merge_word(symbols, self.ranks, self.made)
            self.words.put(word, ids)
        return ids

    def _ids(self, text: str) -> list[int]:
        # lower-casing is by character: a final sigma is no exception
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return [i for word in self.split.findall(text) for i in self._word(word)]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text without special handling of white space; strings of special tokens become their ids."""
        if self.specials is None or not self.specials.search(chunk):
            return self._ids(chunk)
        return [i for part in self.specials.split(chunk) for i in ([self.special[part]] if part in self.special else self._ids(part))]

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in (text or "").encode().split() for i in self.chunk_ids(chunk.decode())]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def spelled(self, text: str) -> tuple[str, str, int]:
        """Decimal ids joined by a space, the decoded text, and the number of ids."""
        memo, recent, out = self.memo, self.memo.new, []
        for chunk in text.encode().split():
            got = recent.get(chunk)
            if got is None and (got := memo.get(chunk)) is None:
                ids = self.chunk_ids(chunk.decode())
                got = (" ".join(map(str, ids)), self.decode(ids), len(ids))
                memo.put(chunk, got)
            if got[2]:
                out.append(got)
        if not out:
            return "", "", 0
        ids, words, n = zip(*out, strict=True)
        return " ".join(ids), " ".join(words), sum(n)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, column: str = "tokens") -> DataFrame:
    """``docs`` with ``column`` (ids array<int>, decoded string) of the whole ``text``.

    Null and empty text: no ids and an empty string. Text of white space only: the same. Other columns pass through,
    and a column named ``column`` is an error; every row is encoded on its own, so repeated rows and ids make no difference.
    """

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for part in texts:
            ids = [bpe.encode(t) for t in part]
            yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    return docs.withColumn(unclaimed(docs, column), run("text"))


def token_digests(docs: DataFrame, path: str, column: str = "digests") -> DataFrame:
    """``docs`` with ``column`` (n_tokens, ids_sha256, decoded_sha256): the outcome of encoding and decoding without
    its bulk. Same cases as ``encode_documents``."""

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for part in texts:
            out = []
            for t in part:
                ids, words, n = bpe.spelled(t or "")
                out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(words.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(unclaimed(docs, column), run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "digests.*")
