"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from how its characters are made up and how
often its words repeat; a gated attention (tanh times sigmoid) learned from the document labels alone weighs the passages,
and the weighted passage representation is scored. The network is trained in numpy on a bounded sample of labelled rows,
its weights (a few thousand numbers) travel with the tasks, and every passage of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Adam, held_out, labelled, sigmoid, trained, unclaimed

PASSAGE = 64
# kinds of bytes: 0 white space, 1 newline, 2 a-z, 3 A-Z, 4 digits, 5 sentence marks, 6 brackets and quotes, 7 other signs,
# 8 control characters, 9 bytes of characters beyond ASCII
KIND = np.full(256, 9, np.int64)
KIND[:128] = 7
KIND[:32] = 8
for _kind, _chars in ((0, b" \t\r\x0b\x0c"), (1, b"\n"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))), (4, b"0123456789"), (5, b".,;:!?-"), (6, b"()[]{}\"'<>/")):
    KIND[list(_chars)] = _kind
KINDS = 10
WIDTH = KINDS * KINDS + 5


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text); a text without words has one passage of zeros."""
    split = [(t or "").encode() for t in texts]
    words = [t.split() for t in split]
    n_words = np.array([len(w) for w in words], np.int64)
    per = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(per) - per
    total = int(per.sum())
    x = np.zeros((total, WIDTH), np.float32)
    if not total:
        return x, first
    # each byte belongs to the passage of the last word that began at or before it
    data = np.frombuffer(b"\n".join(split) + b"\n", np.uint8)
    kind = KIND[data]
    length = np.array([len(t) + 1 for t in split], np.int64)
    doc = np.repeat(np.arange(len(split)), length)
    space = (kind <= 1)
    starts = ~space & np.concatenate([[True], space[:-1]])
    before = np.cumsum(n_words) - n_words
    number = np.cumsum(starts) - 1 - before[doc]  # -1 before the first word
    at = first[doc] + np.clip(number, 0, None) // PASSAGE
    pair = at[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
    same = (doc[1:] == doc[:-1])
    counts = np.bincount(pair[same], minlength=total * KINDS * KINDS).reshape(total, KINDS * KINDS)
    size = np.maximum(1, counts.sum(1))
    x[:, :KINDS * KINDS] = np.sqrt(counts / size[:, None])
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    if len(flat):
        h = pd.util.hash_array(flat, categorize=False)
        lengths = np.fromiter(map(len, flat), np.float64, len(flat))
        position = np.arange(len(flat)) - np.repeat(before, n_words)
        mine = np.repeat(first, n_words) + position // PASSAGE
        held = np.bincount(mine, minlength=total)
        distinct = np.unique(mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h, return_index=True)[1]
        mean = np.bincount(mine, lengths, total) / np.maximum(held, 1)
        square = np.bincount(mine, lengths**2, total) / np.maximum(held, 1)
        x[:, -5] = np.bincount(mine[distinct], minlength=total) / np.maximum(held, 1)
        x[:, -4] = np.log1p(mean)
        x[:, -3] = np.log1p(np.sqrt(np.maximum(0, square - mean**2)))
        x[:, -2] = np.log1p(held)
        x[:, -1] = np.log1p(np.repeat(n_words, per) / 10)
    return x, first


def forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    n = np.diff(np.append(first, len(x)))
    x = np.clip((x - w["mean"]) / w["std"], -4, 4)
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    raw = (t * g) @ w["attend"]
    e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), n))
    a = e / np.repeat(np.add.reduceat(e, first), n)
    bag = np.add.reduceat(a[:, None] * h, first)
    return {"n": n, "x": x, "h": h, "t": t, "g": g, "a": a, "bag": bag, "logit": bag @ w["score"] + w["score_b"]}


def train(texts: list[str], labels: list[int], width: int = 24, gates: int = 12, steps: int = 150, seed: int = 4) -> dict[str, np.ndarray]:
    """Weights of the network. With labels of one kind only, a network that scores every text with that share."""
    rng = np.random.default_rng(seed)
    parts = [passages(texts[i:i + 200]) for i in range(0, len(texts), 200)] or [passages([])]
    offset = np.cumsum([0, *(len(p) for p, _ in parts)])
    x, first = np.concatenate([p for p, _ in parts]), np.concatenate([f + o for (_, f), o in zip(parts, offset, strict=False)])
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    learned = {
        "encode": rng.normal(0, WIDTH**-0.5, (WIDTH, width)), "encode_b": np.zeros(width), "tanh": rng.normal(0, width**-0.5, (width, gates)),
        "gate": rng.normal(0, width**-0.5, (width, gates)), "attend": rng.normal(0, gates**-0.5, gates), "score": np.zeros(width), "score_b": np.array([np.log(share / (1 - share))]),
    }
    w = {k: v.astype(np.float32) for k, v in learned.items()}
    w["mean"] = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
    w["std"] = (x.std(0) if len(x) else np.zeros(WIDTH, np.float32)) + np.float32(0.02)
    if len(set(labels)) < 2:
        return w
    adam = Adam({k: w[k] for k in learned}, rate=0.01, decay=1e-4)
    for _ in range(steps):
        f = forward(w, x, first)
        n = f["n"]
        d = ((sigmoid(f["logit"]) - y) / len(y)).astype(np.float32)
        d_bag = np.repeat(d[:, None] * w["score"], n, 0)
        d_a = (d_bag * f["h"]).sum(1)
        d_raw = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, first), n))
        d_tg = d_raw[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_bag + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_e = d_h * (1 - f["h"] ** 2)
        adam.step({
            "encode": f["x"].T @ d_e, "encode_b": d_e.sum(0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_raw, "score": f["bag"].T @ d, "score_b": d.sum(keepdims=True),
        })
    return w


def score_texts(w: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    if not len(texts):
        return np.empty(0)
    x, first = passages(texts)
    return sigmoid(forward(w, x, first)["logit"].astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 4000, train_chars: int = 100_000,
                  column: str = "quality_score") -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier.

    The network learns from at most ``train_rows`` rows of ``labels`` (doc_id, quality) that are not held out and whose text
    has at most ``train_chars`` characters; without labels of both kinds every text gets their share (0.5 without any).
    Null, empty and blank texts are scored as one empty passage. Only the text counts: equal texts get equal scores. Other
    columns pass through; a column named ``column`` is an error.
    """
    unclaimed(docs, column)
    weights = docs.sparkSession.sparkContext.broadcast(trained(labelled(docs, labels, "quality", train_rows, train_chars), train))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            yield pd.Series(np.concatenate([score_texts(weights.value, texts[i:i + 200]) for i in range(0, len(texts), 200)] or [np.empty(0)]))

    return docs.withColumn(column, run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
