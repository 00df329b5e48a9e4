"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input is the embedding of its hash bucket next to the mean embedding of its character trigrams. Windows of
``WINDOW`` words, each overlapping the next by half, run through a forward and a backward gated recurrent layer; an
attention pools the states and the pooled state is scored. A document scores as its worst window, so one abusive passage
in a long clean text is seen. Everything is numpy.

Training needs window labels, but only documents are labelled. Word and trigram embeddings start with the log-odds of
their documents' labels; the windows of a toxic document that the inputs (later the network) find worst count as toxic,
those of clean documents as clean, the worst-scored ones among them above all. A last logistic fit turns a document's worst
window into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Adam, held_out, labelled, mix64, sigmoid, trained, unclaimed

WINDOW, STRIDE = 24, 12
WORDS, GRAMS = 1 << 15, 1 << 14  # hash buckets
DIM, HIDDEN = 4, 8
PART = 50_000  # words that are counted, or whose inputs are made, at a time
EDGE = b" .,;:!?\"'()[]{}<>*#$%&|~^_=+-/\\`"
Weights = dict[str, np.ndarray]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of the different word per word, words per text, the different words): lower-cased, outer signs stripped
    where anything is left."""
    split = [(t or "").encode().lower().split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for ws in split for w in ws]
    del split
    if not len(flat):
        return np.empty(0, np.int64), n, []
    code, _ = pd.factorize(pd.util.hash_array(flat, categorize=False).view(np.int64))
    firsts = np.empty(code.max() + 1, np.int64)
    firsts[code[::-1]] = np.arange(len(code))[::-1]
    return code, n, [w.strip(EDGE) or w for w in flat[firsts]]


def encode_in_parts(texts: list[str], rows: int = 250) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``encode`` of many texts without holding all their words at once."""
    index: dict[bytes, int] = {}
    codes, counts = [], []
    for i in range(0, len(texts), rows):
        code, n, words = encode(texts[i:i + rows])
        number = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
        codes.append(number[code])
        counts.append(n)
    return np.concatenate(codes), np.concatenate(counts), list(index)


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all character trigrams, first trigram of each word); a word's ends count as characters."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) & np.uint64(WORDS - 1)).astype(np.int64)
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03\x02\x03", np.uint8).astype(np.uint64)
    gram = (mix64(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) & np.uint64(GRAMS - 1)).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(length) - length
    # a word of n characters has n trigrams; the two after them span the gap to the next word
    keep = np.ones(int(length.sum()), bool)
    keep[first + length - 1] = keep[first + length - 2] = False
    return bucket, gram[:len(keep)][keep], np.cumsum(length - 2) - (length - 2)


def inputs(w: Weights, bucket: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The input of each different word: word part and character part."""
    if not len(bucket):
        return np.empty((0, 2 * DIM), np.float32)
    out, ends = np.empty((len(bucket), 2 * DIM), np.float32), np.append(first, len(gram))
    out[:, :DIM] = w["words"][bucket]
    for i in range(0, len(bucket), PART):
        at = ends[i:i + PART + 1]
        out[i:i + PART, DIM:] = np.add.reduceat(w["grams"][gram[at[0]:at[-1]]], at[:-1] - at[0]) / np.diff(at)[:, None]
    return out


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, text of each window), counting words over all texts. The last window of a text ends
    with it; a text of up to ``WINDOW`` words has one window."""
    per = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STRIDE, np.maximum(0, n[doc] - WINDOW))
    return start + (np.cumsum(n) - n)[doc], doc


def window_words(code: np.ndarray, stop: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """(windows, WINDOW) numbers of words for windows that begin at ``at``; ``stop`` is the end of each one's text and
    ``none`` stands beyond it."""
    if not len(code):
        return np.full((len(at), WINDOW), none, np.int32)
    grid = at[:, None] + np.arange(WINDOW)
    return np.where(grid < stop[:, None], code[np.minimum(grid, len(code) - 1)], none).astype(np.int32)


def run_layer(x: np.ndarray, grid: np.ndarray, w: Weights, side: str) -> list[tuple]:
    """States of one direction. ``x`` has the layer's input (update, reset, candidate) per different word; a missing
    word has an update gate of 1, which keeps the state."""
    u, un = w[f"{side}_u"], w[f"{side}_un"]
    h, out = np.zeros((len(grid), HIDDEN), np.float32), []
    order = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    for t in order:
        i = x[grid[:, t]]
        zr = sigmoid(i[:, :2 * HIDDEN] + h @ u)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(i[:, 2 * HIDDEN:] + (r * h) @ un)
        new = z * h + (1 - z) * c
        out.append((t, h, z, r, c, new))
        h = new
    return out


def forward(w: Weights, x: np.ndarray, grid: np.ndarray, keep: bool = False) -> dict:
    """Logits of windows; ``x`` the inputs of the different words, the row after the last stands for a missing word."""
    pre = {s: np.concatenate([x @ w[f"{s}_w"] + w[f"{s}_b"], np.repeat(np.float32([[30, 0, 0]]), HIDDEN, 1)]) for s in "fb"}
    layers = {s: run_layer(pre[s], grid, w, s) for s in "fb"}
    states = np.empty((WINDOW, len(grid), 2 * HIDDEN), np.float32)
    for k, s in enumerate("fb"):
        for t, *_, new in layers[s]:
            states[t, :, k * HIDDEN:(k + 1) * HIDDEN] = new
    m = np.tanh(states @ w["att"] + w["att_b"])
    raw = np.where((grid == len(x)).T, np.float32(-1e9), m @ w["att_v"])
    e = np.exp(raw - raw.max(0))
    a = e / e.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    out = {"logit": pooled @ w["out"] + w["out_b"]}
    return out | {"layers": layers, "states": states, "m": m, "a": a, "pooled": pooled} if keep else out


def backward(w: Weights, x: np.ndarray, order: np.ndarray, first: np.ndarray, f: dict, d: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the weights and of the inputs, from those of the logits. ``order`` sorts the words of the windows
    (position by position) by their number, ``first`` is where each number begins."""
    g = {"out": f["pooled"].T @ d, "out_b": d.sum(keepdims=True)}
    d_pooled = d[:, None] * w["out"]
    d_a = (f["states"] * d_pooled).sum(2)
    d_raw = f["a"] * (d_a - (f["a"] * d_a).sum(0))
    d_m = d_raw[:, :, None] * w["att_v"] * (1 - f["m"] ** 2)
    g |= {"att_v": np.einsum("twk,tw->k", f["m"], d_raw), "att": np.einsum("twh,twk->hk", f["states"], d_m), "att_b": d_m.sum((0, 1))}
    d_states = f["a"][:, :, None] * d_pooled + d_m @ w["att"].T
    d_x = np.zeros_like(x)
    for k, s in enumerate("fb"):
        d_cells = np.empty((WINDOW, len(d), 3 * HIDDEN), np.float32)
        g_u, g_un = np.zeros_like(w[f"{s}_u"]), np.zeros_like(w[f"{s}_un"])
        d_h = np.zeros((len(d), HIDDEN), np.float32)
        for t, h, z, r, c, _ in reversed(f["layers"][s]):
            d_new = d_h + d_states[t, :, k * HIDDEN:(k + 1) * HIDDEN]
            d_c = d_new * (1 - z) * (1 - c**2)
            d_rh = d_c @ w[f"{s}_un"].T
            d_zr = np.concatenate([d_new * (h - c) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            g_un += (r * h).T @ d_c
            g_u += h.T @ d_zr
            d_h = d_new * z + d_rh * r + d_zr @ w[f"{s}_u"].T
            d_cells[t] = np.concatenate([d_zr, d_c], 1)
        d_pre = np.add.reduceat(d_cells.reshape(-1, 3 * HIDDEN)[order], first)[:len(x)]
        g |= {f"{s}_u": g_u, f"{s}_un": g_un, f"{s}_w": x.T @ d_pre, f"{s}_b": d_pre.sum(0)}
        d_x += d_pre @ w[f"{s}_w"].T
    return g, d_x


def held_by(column: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """How many clean and toxic documents hold each bucket, each document counting once."""
    pair = np.unique(doc.astype(np.int64) * size + column)
    return np.stack([np.bincount(pair % size, 1 - y[pair // size], size), np.bincount(pair % size, y[pair // size], size)])


def log_odds(held: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of a toxic document per bucket, shrunk where few documents hold it."""
    good, bad = held
    share = (bad + 0.5) / (y.sum() + 1) / ((good + 0.5) / ((1 - y).sum() + 1))
    return np.log(share) * (bad + good) / (bad + good + 5.0)


def train(texts: list[str], labels: list[int], rounds: int = 4, steps: int = 20, clean: int = 4000, seed: int = 5) -> Weights:
    """Weights of the network. With labels of one kind only, one that scores every text with that share.

    Each of ``rounds`` picks windows: the worst of every toxic text, and ``clean`` windows of clean texts, half of them the
    worst-scored and half evenly spread; then ``steps`` full steps are made."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    new = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    w = {"words": rng.normal(0, 0.1, (WORDS, DIM)).astype(np.float32), "grams": rng.normal(0, 0.1, (GRAMS, DIM)).astype(np.float32), "att": new(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, np.float32),
         "att_v": new(HIDDEN), "out": new(2 * HIDDEN), "out_b": np.zeros(1, np.float32), "scale": np.float32([0]), "shift": np.float32([np.log(share / (1 - share))])}
    for s in "fb":
        w |= {f"{s}_w": new(2 * DIM, 3 * HIDDEN), f"{s}_b": np.zeros(3 * HIDDEN, np.float32), f"{s}_u": new(HIDDEN, 2 * HIDDEN), f"{s}_un": new(HIDDEN, HIDDEN)}
    if len(set(labels)) < 2:
        return w
    code, n, words = encode_in_parts(texts)
    bucket, gram, first = word_inputs(words)
    span, stop = np.diff(np.append(first, len(gram))), np.cumsum(n)
    held, held_grams = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
    for docs in np.split(np.arange(len(n)), np.searchsorted(stop, np.arange(4 * PART, int(stop[-1]), 4 * PART))):
        mine = code[stop[docs[0]] - n[docs[0]]:stop[docs[-1]]] if len(docs) else code[:0]
        pair = np.unique(np.repeat(docs, n[docs]) * max(1, len(words)) + mine)
        doc, word = pair // max(1, len(words)), pair % max(1, len(words))
        held += held_by(bucket[word], doc, y, WORDS)
        spot = np.repeat(first[word] - (np.cumsum(span[word]) - span[word]), span[word]) + np.arange(span[word].sum())
        held_grams += held_by(gram[spot], np.repeat(doc, span[word]), y, GRAMS)
    w["words"][:, 0], w["grams"][:, 0] = log_odds(held, y), log_odds(held_grams, y)
    at, owner = windows(n)
    # windows that say next to nothing are clean: no words at all, or one word of a clean text throughout
    spoken = code[np.repeat(y == 0, n)]
    dull = np.repeat(spoken[rng.integers(0, len(spoken), clean // 10)] if len(spoken) else np.empty(0, np.int32), WINDOW).reshape(-1, WINDOW)
    extra = np.concatenate([np.full((clean // 40, WINDOW), len(words), np.int32), dull])
    total = len(at) + len(extra)

    def grid_of(index: np.ndarray) -> np.ndarray:
        """The words of windows by number: those of the texts, then the dull ones. Only what is asked for is held."""
        text = index < len(at)
        k = index[text]
        return np.concatenate([window_words(code, stop[owner[k]], at[k], len(words)), extra[index[~text] - len(at)]])

    toxic = np.concatenate([y[owner] == 1, np.zeros(len(extra), bool)])
    bad_windows, rest = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    x = inputs(w, bucket, gram, first)
    start = np.append(x[:, 0] + x[:, DIM], -1e9)  # before the network knows anything
    worst = np.concatenate([start[grid_of(k)].max(1) for k in chunks(total)])
    net = [k for k in w if k not in ("words", "grams", "scale", "shift")]
    adam = Adam({k: w[k] for k in net}, rate=0.02, decay=1e-5)
    for r in range(rounds):
        if r:
            worst = window_logits(w, inputs(w, bucket, gram, first), grid_of, total)
        bad = bad_windows[pd.Series(worst[bad_windows]).groupby(owner[bad_windows]).idxmax().to_numpy()]
        hard = rest[np.argsort(-worst[rest], kind="stable")[:clean // 2]]
        even = rest[np.linspace(0, len(rest) - 1, min(len(rest), clean // 2)).astype(int)] if len(rest) else rest
        pick = np.concatenate([bad, hard, even, np.arange(len(at), total)])
        goal = np.concatenate([np.ones(len(bad)), np.zeros(len(pick) - len(bad))]).astype(np.float32)
        weight = np.where(goal == 1, 0.5 / max(1, len(bad)), 0.5 / max(1, len(pick) - len(bad))).astype(np.float32)
        # picked windows in order, the dull ones last as grid_of returns them
        pick = pick[np.argsort(pick >= len(at), kind="stable")]
        used, small = np.unique(grid_of(pick), return_inverse=True)
        small = small.reshape(-1, WINDOW)
        known = used < len(words)
        mine = word_inputs([words[i] for i in used[known]])  # of the windows' different words only
        order = np.argsort(small.T.ravel(), kind="stable")
        begin = np.searchsorted(small.T.ravel()[order], np.arange(len(used)))
        for _ in range(steps):
            x = inputs(w, *mine)
            f = forward(w, x, small, keep=True)
            d = weight * (sigmoid(f["logit"]) - goal)
            grads, d_x = backward(w, x, order, begin, f, d)
            adam.step({k: grads[k] for k in net})
            # embeddings beyond their log-odds are learned too, with plain steps
            np.add.at(w["words"][:, 1:], mine[0], -2.0 * d_x[:, 1:DIM])
    worst = window_logits(w, inputs(w, bucket, gram, first), grid_of, len(at))
    z, scale, shift = pd.Series(worst).groupby(owner).max().to_numpy(), 1.0, 0.0
    for _ in range(2000):  # the logistic fit of the documents' worst windows
        e = (sigmoid(scale * z + shift) - y) / len(y)
        scale, shift = scale - 1.0 * ((e * z).sum() + 1e-3 * scale), shift - 1.0 * e.sum()
    w["scale"], w["shift"] = np.float32([scale]), np.float32([shift])
    return w


def chunks(total: int, rows: int = 4096) -> list[np.ndarray]:
    return [np.arange(i, min(total, i + rows)) for i in range(0, total, rows)]


def window_logits(w: Weights, x: np.ndarray, grid_of: Callable[[np.ndarray], np.ndarray], total: int) -> np.ndarray:
    """Logits of ``total`` windows, whose words ``grid_of`` gives a chunk at a time. The layers' inputs are made for a chunk's
    own words only."""
    out = [np.empty(0, np.float32)]
    for k in chunks(total):
        grid = grid_of(k)
        held = np.zeros(len(x) + 1, bool)
        held[grid] = True
        held[len(x)] = False
        number = np.append(np.cumsum(held[:-1]) - 1, held.sum())  # the missing word stays the one after the last
        out.append(forward(w, x[held[:-1]], number[grid])["logit"])
    return np.concatenate(out)


def score_texts(w: Weights, texts: list[str | None]) -> np.ndarray:
    """The probability that each text is toxic, from its worst window."""
    if not len(texts):
        return np.empty(0)
    code, n, words = encode(texts)
    at, owner = windows(n)
    stop = np.cumsum(n)
    logit = window_logits(w, inputs(w, *word_inputs(words)), lambda k: window_words(code, stop[owner[k]], at[k], len(words)), len(at))
    first = np.searchsorted(owner, np.arange(len(texts)))
    return sigmoid(w["scale"].astype(np.float64) * np.maximum.reduceat(logit.astype(np.float64), first) + w["shift"])


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, train_chars: int = 100_000,
                   column: str = "toxicity_score") -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier.

    The network learns from at most ``train_rows`` rows of ``labels`` (doc_id, toxic) that are not held out and whose text
    has at most ``train_chars`` characters; without labels of both kinds every text gets their share (0.5 without any).
    Null, empty and blank texts are scored as a window without words. Only the text counts: equal texts get equal scores.
    Other columns pass through; a column named ``column`` is an error.
    """
    unclaimed(docs, column)
    weights = docs.sparkSession.sparkContext.broadcast(trained(labelled(docs, labels, "toxic", train_rows, train_chars), train))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            yield pd.Series(np.concatenate([score_texts(weights.value, texts[i:i + 200]) for i in range(0, len(texts), 200)] or [np.empty(0)]))

    return docs.withColumn(column, run("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
