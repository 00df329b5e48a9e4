import inspect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidewatch.llm import quality as Q
from tidewatch.llm import toxicity as X
from tidewatch.llm.common import held_out, labelled

INSULTS = ["idiot", "moron", "scum"]


def text(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "re", "in", "st", "o"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus(n=500, seed=1):
    """(texts, quality, toxic): clean prose; junk of three kinds; prose with insults in one place."""
    rng = random.Random(seed)
    texts, quality, toxic = [], [], []
    for i in range(n):
        t, kind = text(rng, rng.randint(5, 300)), i % 8
        if kind == 1:
            t = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split())
        elif kind == 2:
            t = "!! ".join(t.upper().split())
        elif kind == 3:
            w = t.split()
            at = rng.randrange(len(w))
            t = " ".join([*w[:at], *[rng.choice(INSULTS) + rng.choice(["", ",", "!"]) for _ in range(3)], *w[at:]])
        texts.append(t)
        quality.append(int(kind not in (1, 2)))
        toxic.append(int(kind == 3))
    return texts, quality, toxic


@pytest.fixture(scope="module")
def data():
    return corpus()


@pytest.fixture(scope="module")
def weights(data):
    texts, quality, toxic = data
    return Q.train(texts[:400], quality[:400]), X.train(texts[:400], toxic[:400], clean=800)


def test_held_out_accuracy(data, weights):
    texts, quality, toxic = data
    assert ((Q.score_texts(weights[0], texts[400:]) >= 0.3) == np.array(quality[400:])).mean() >= 0.97
    assert ((X.score_texts(weights[1], texts[400:]) >= 0.5) == np.array(toxic[400:])).mean() >= 0.95


def test_training_sees_every_window(data, monkeypatch):
    """Each later round picks among all windows, and the last fit looks at all documents, with the full sizes by default."""
    defaults = {k: p.default for k, p in inspect.signature(X.train).parameters.items()}
    assert (defaults["rounds"], defaults["steps"], defaults["clean"]) == (4, 20, 4000)
    assert inspect.signature(X.score_toxicity).parameters["train_rows"].default == 6000
    texts, _, toxic = data
    seen, real = [], X.window_logits
    monkeypatch.setattr(X, "window_logits", lambda w, x, grid_of, total: seen.append(total) or real(w, x, grid_of, total))
    X.train(texts[:60], toxic[:60], rounds=3, steps=1, clean=40)
    n = sum(len(X.windows(X.encode([t])[1])[0]) for t in texts[:60])
    assert len(seen) == 3 and min(seen) >= n


def test_an_insult_deep_in_a_long_text_is_seen(data, weights):
    rng = random.Random(3)
    long = text(rng, 5000).split()
    clean, bad = " ".join(long), " ".join([*long[:3777], "idiot", "scum,", "moron", *long[3777:]])
    low, high = X.score_texts(weights[1], [clean, bad])
    assert low < 0.5 <= high


def test_scores_depend_on_the_text_alone(weights):
    odd = ["", None, " \n\t", "a", "\x00\x01", "é" * 50, "🙂 " * 30, "x" * 100_000, "a " * 30_000, "|", "..."]
    for module, w in zip((Q, X), weights, strict=True):
        together = module.score_texts(w, odd)
        alone = [module.score_texts(w, [t])[0] for t in odd]
        assert np.allclose(together, alone, atol=1e-5) and (0 <= together).all() and (together <= 1).all()
        assert together[0] == together[1] and np.isclose(together[0], together[2], atol=1e-6)
        assert len(module.score_texts(w, [])) == 0


def test_passages_cover_every_word():
    x, first = Q.passages(["a " * 200, "", "b " * 64, "c " * 65])
    assert first.tolist() == [0, 4, 5, 6] and len(x) == 8
    assert np.allclose(np.expm1(x[:, -2]), [64, 64, 64, 8, 0, 64, 64, 1], atol=1e-3)


def test_windows_cover_every_word_and_overlap():
    n = np.array([0, 1, 24, 25, 100])
    at, doc = X.windows(n)
    begin = np.cumsum(n) - n
    for d, k in enumerate(n):
        starts = at[doc == d] - begin[d]
        covered = {w for s in starts for w in range(s, min(s + X.WINDOW, k))}
        assert covered == set(range(k)) and (np.diff(starts) <= X.STRIDE).all() and (np.diff(starts) > 0).all()


def test_gradients_match_differences():
    """Backward pass of the recurrent network against central differences."""
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in X.train(["x"], [0]).items()}
    w |= {k: rng.normal(0, 0.4, v.shape) for k, v in w.items() if k not in ("words", "grams", "scale", "shift")}
    x = rng.normal(0, 1, (5, 2 * X.DIM))
    grid = rng.integers(0, 6, (3, X.WINDOW))
    goal = np.array([1.0, 0.0, 1.0])

    def loss():
        z = X.forward(w, x, grid)["logit"].astype(float)
        return float((np.logaddexp(0, z) - goal * z).sum())

    flat = grid.T.ravel()
    order = np.argsort(flat, kind="stable")
    f = X.forward(w, x, grid, keep=True)
    grads, d_x = X.backward(w, x, order, np.searchsorted(flat[order], np.arange(6)), f, 1 / (1 + np.exp(-f["logit"].astype(float))) - goal)
    for values, got in [(w[k], grads[k]) for k in ("f_w", "b_u", "f_un", "b_b", "att", "att_v", "out", "out_b")] + [(x, d_x)]:
        spot = tuple(rng.integers(0, s) for s in values.shape)
        eps, kept = 1e-3, values[spot]
        values[spot] = kept + eps
        up = loss()
        values[spot] = kept - eps
        down = loss()
        values[spot] = kept
        assert got[spot] == pytest.approx((up - down) / (2 * eps), abs=2e-2, rel=5e-2)


@pytest.mark.parametrize("module", [Q, X])
def test_tables_without_both_labels(spark, module):
    score, column, out = (module.score_quality, "quality", "quality_score") if module is Q else (module.score_toxicity, "toxic", "toxicity_score")
    docs = documents(spark, [(1, "some words"), (2, None), (None, ""), (1, "some words")]).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    rows = score(docs, none).collect()
    assert len(rows) == 4 and {r[out] for r in rows} == {0.5} and {r.score for r in rows} == {"mine"}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 1)], f"doc_id long, {column} int")
    assert {round(r[out], 2) for r in score(docs, one).collect()} == {0.99}
    assert score(documents(spark, []), one).collect() == []


def test_labels_come_from_rows_that_are_not_held_out(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled(docs, labels, "quality", 1000, 1000).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert labelled(docs, labels, "quality", 30, 1000).count() == 30
    marks = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert marks == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}
