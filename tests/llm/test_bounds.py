"""Scoring against a slow direct pass, bounds of what is held, and columns with the names that operators use."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import curriculum, exact_stream, neardup, toxicity
from ledgerwright.llm.common import first_by_hash


def states(vectors, inputs, layer):
    """One direction over one window, a word at a time, from the definition of the layer."""
    n, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for v in vectors:
        x, through = v @ inputs, h @ layer["u"]
        z, r = sigmoid(x[:n] + through[:n]), sigmoid(x[n:2 * n] + through[n:2 * n])
        candidate = np.tanh(x[2 * n:] + r * (through[2 * n:] + layer["c"]))
        h = z * h + (1 - z) * candidate
        out.append(h)
    return np.array(out)


def slow_score(model, text):
    words, logits = toxicity.words_of(text), []
    for start in range(0, max(len(words), 1), toxicity.STRIDE):
        if start and start >= len(words) - (toxicity.WINDOW - toxicity.STRIDE):
            break
        vectors = [toxicity.Words([w]).vectors(model)[0] for w in words[start:start + toxicity.WINDOW] or [""]]
        both = np.concatenate([states(vectors, model["fi"], model["f"]), states(vectors[::-1], model["bi"], model["b"])[::-1]], 1)
        weight = np.exp(np.tanh(both @ model["a"]) @ model["av"])
        logits.append(weight @ both @ model["o"] / weight.sum() + model["ob"][0])
    return 1 / (1 + np.exp(-max(logits)))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    shaken = lambda v: {k: shaken(x) for k, x in v.items()} if isinstance(v, dict) else (v + 0.3 * rng.standard_normal(v.shape)).astype(v.dtype)
    return shaken(toxicity.new_model())


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    sizes = (0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 200, 333)
    return [" ".join(word() for _ in range(n)) for n in sizes] + [None, " .. ", "x" * 150 + " y_" + "z" * 80]


def test_scores_are_those_of_each_window_by_itself(model):
    got = toxicity.Scorer(model).score(texts())
    assert np.allclose(got, [slow_score(model, t) for t in texts()], atol=2e-5) and got.std() > 0.01


@pytest.mark.parametrize("piece", [16, 32, 64])
def test_pieces_have_the_windows_of_the_whole(model, monkeypatch, piece):
    whole = toxicity.Scorer(model).score(texts())
    monkeypatch.setattr(toxicity, "PIECE_WORDS", piece)
    monkeypatch.setattr(toxicity, "GROUP", 100)
    windows = lambda words: [tuple(words[a:a + n]) for a, n in toxicity.windows_of(len(words))]
    for text in texts():
        cut = [w for part in toxicity.pieces_of(text) for w in windows(part)]
        assert cut == windows(toxicity.words_of(text))
    assert np.allclose(toxicity.Scorer(model).score(texts()), whole, atol=1e-6)


def test_no_more_than_one_group_is_held_as_words(model, monkeypatch):
    alive = most = 0

    class Held(list):
        def __init__(self, words):
            nonlocal alive, most
            super().__init__(words)
            self.size = len(self)
            alive += self.size
            most = max(most, alive)

        def __del__(self):
            nonlocal alive
            alive -= self.size

    plain = toxicity.words_of
    monkeypatch.setattr(toxicity, "words_of", lambda t: Held(plain(t)))
    monkeypatch.setattr(toxicity, "GROUP", 2_000)
    scorer = toxicity.Scorer(model)
    scorer.score(["some words of a text " * 6] * 20_000)
    assert 1_000 < most < 6_000


def test_samples_are_the_first_in_the_order_of_the_hash(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 100 = 0, 'few', if(id % 7 = 0, null, 'many')) AS kind")
    got = first_by_hash(rows, "kind", "id", F.when(F.col("kind") == "few", 50).otherwise(700)).collect()
    hashed = {r.id: r.h for r in rows.select("id", F.xxhash64("id").alias("h")).collect()}
    for kind, most in (("few", 50), ("many", 700), (None, 700)):
        ids = [r.id for r in rows.where(F.col("kind").eqNullSafe(F.lit(kind))).collect()]
        want = sorted(ids, key=lambda i: (hashed[i], i))[:most]
        assert [r.id for r in sorted((r for r in got if r.kind == kind), key=lambda r: r.rank)] == want


NAMES = [
    "digest", "__digest", "mark", "__mark", "key_0", "key_1", "key", "KEY_0_", "__id", "__key", "__v", "visits", "visit", "row", "doc", "a.b", "b`c", "size", "rank",
    "text_hash", "kept", "position", "keeper", "taken",
]


@pytest.mark.parametrize("stage", [exact_stream.keep_one, neardup.keep_one, curriculum.training_documents])
def test_columns_of_the_caller_stay_as_they_are(spark, stage):
    base = [(1, "some words here to be read twice", "s"), (2, "some words here to be read  twice", "s"), (3, None, None), (4, "other words", "t"), (4, "other words", "t")]
    rows = [(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(base)]
    names = ["doc_id", "text", "source", *NAMES]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    got = stage(docs)
    assert got.columns == names
    out = [tuple(r) for r in got.collect()]
    assert out and set(out) <= set(rows) and {r[0] for r in out} >= {4}


def test_labels_of_one_kind_are_said_to_teach_nothing(spark, documents):
    docs, labels = documents([(1, "a b"), (2, "c d")]), spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    with pytest.warns(UserWarning, match="both kinds"):
        toxicity.learn(docs, labels, modulus=None)
    long = "zorkan " * 4_000
    docs = documents([(i, long if i % 2 else f"fine words {i} " * 9) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    score = toxicity.Scorer(toxicity.learn(docs, labels, modulus=None)).score(["zorkan", "fine words 3"])
    assert score[0] > 0.5 > score[1]
