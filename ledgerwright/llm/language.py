"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text gets a probability for each language from what stands before and after
it in its window; a document's probabilities are the mean over all its bytes. Windows tile
the whole text. The network is trained in numpy by backpropagation through time on a bounded
sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.llm import gru
from ledgerwright.llm.common import keep_keys, map_columns, remainder

HIDDEN = 8
WINDOW = 256  # bytes scored together
SAMPLE = 400  # labelled documents a language that are learned from
STRETCH = 2_048  # characters of each of them
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, RATE = 48, 128, 260, 0.015
AT_ONCE = 1_024  # windows in one run of the network
SEED = 11


def new_model(languages: list[str], hidden: int = HIDDEN) -> dict:
    rng = np.random.default_rng(SEED)
    k = len(languages)
    return {
        "fx": (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(gru.F32), "bx": (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(gru.F32),
        "f": gru.init_layer(rng, hidden), "b": gru.init_layer(rng, hidden),
        "fo": (rng.standard_normal((hidden, k)) * 0.1).astype(gru.F32), "bo": (rng.standard_normal((hidden, k)) * 0.1).astype(gru.F32),
        "o": np.zeros(k, gru.F32),
    }


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def loss_and_grads(model: dict, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
    """Mean cross entropy over all positions of (time, batch) bytes, and the gradients."""
    steps, _ = ids.shape
    live = gru.running(lengths, steps)
    turn = gru.backwards(ids, lengths)
    back_ids = np.take_along_axis(ids, turn, 0)
    hf, kf = gru.run_layer(model["fx"][ids], live, model["f"], keep=True)
    hb, kb = gru.run_layer(model["bx"][back_ids], live, model["b"], keep=True)
    hb_at = np.take_along_axis(hb, turn[:, :, None], 0)
    prob = _softmax(hf @ model["fo"] + hb_at @ model["bo"] + model["o"])
    mask = np.arange(steps)[:, None] < lengths[None, :]
    count = mask.sum()
    loss = -(np.log(np.take_along_axis(prob, labels[None, :, None], 2)[:, :, 0] + 1e-9) * mask).sum() / count
    d = prob.copy()
    np.put_along_axis(d, np.broadcast_to(labels[None, :, None], (steps, len(labels), 1)), np.take_along_axis(d, labels[None, :, None], 2) - 1, 2)
    d *= mask[:, :, None] / count
    flat = lambda a: a.reshape(-1, a.shape[-1])
    grads = {"fo": flat(hf).T @ flat(d), "bo": flat(hb_at).T @ flat(d), "o": flat(d).sum(0)}
    dxf, grads["f"] = gru.grad_layer(d @ model["fo"].T, kf, live, model["f"])
    dxb, grads["b"] = gru.grad_layer(np.take_along_axis(d @ model["bo"].T, turn[:, :, None], 0), kb, live, model["b"])
    for name, used, dx in (("fx", ids, dxf), ("bx", back_ids, dxb)):
        grads[name] = np.zeros_like(model[name])
        np.add.at(grads[name], used.reshape(-1), flat(dx))
    return float(loss), grads


def train(texts: list[str], languages: list[str], labels: list[int]) -> dict:
    """Fit the network to texts and the numbers of their languages."""
    rng = np.random.default_rng(SEED)
    model, adam = new_model(languages), gru.Adam(RATE)
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    by_label = [[i for i, y in enumerate(labels) if y == k and len(data[i])] for k in range(len(languages))]
    by_label = [(k, rows) for k, rows in enumerate(by_label) if rows]
    for step in range(TRAIN_STEPS if by_label else 0):
        picks = [(k, rows[rng.integers(len(rows))]) for k, rows in (by_label[rng.integers(len(by_label))] for _ in range(TRAIN_BATCH))]
        parts = []
        for k, i in picks:
            at = rng.integers(max(len(data[i]) - TRAIN_WINDOW, 0) + 1)
            parts.append((data[i][at:at + TRAIN_WINDOW], k))
        parts.sort(key=lambda p: -len(p[0]))
        lengths = np.array([len(p) for p, _ in parts])
        ids = np.zeros((lengths[0], len(parts)), np.int64)
        for j, (p, _) in enumerate(parts):
            ids[:len(p), j] = p
        _, grads = loss_and_grads(model, ids, lengths, np.array([k for _, k in parts]))
        adam.step(model, grads, 1.0 if step < TRAIN_STEPS // 2 else 0.3)
    return model


def _windows(model: dict, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the position probabilities of each window; `ids` (time, batch), sorted by falling length."""
    live = gru.running(lengths, len(ids))
    turn = gru.backwards(ids, lengths)
    prob = gru.scan_layer(model["fx"], ids, live, model["f"], model["fo"])
    back = gru.scan_layer(model["bx"], np.take_along_axis(ids, turn, 0), live, model["b"], model["bo"])
    for k, logits in enumerate(prob):
        logits += np.take_along_axis(back[k], turn, 0)
        logits += model["o"][k]
    prob -= prob.max(axis=0)
    np.exp(prob, out=prob)
    prob *= (np.arange(len(ids))[:, None] < lengths[None, :]) / prob.sum(axis=0)
    return prob.sum(axis=1, dtype=np.float64).T


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """Mean probability of each language over all bytes of each whole text."""
    sums = np.zeros((len(texts), len(model["o"])))
    sizes = np.zeros(len(texts))
    pieces: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        pieces.sort(key=lambda p: -len(p[1]))
        lengths = np.array([len(p) for _, p in pieces])
        ids = np.zeros((lengths[0], len(pieces)), np.uint8)
        for j, (_, p) in enumerate(pieces):
            ids[:len(p), j] = p
        np.add.at(sums, [i for i, _ in pieces], _windows(model, ids, lengths))
        pieces.clear()

    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        sizes[i] = len(data)
        for at in range(0, len(data), WINDOW):
            pieces.append((i, data[at:at + WINDOW]))
            if len(pieces) == AT_ONCE:
                flush()
    if pieces:
        flush()
    return sums / np.maximum(sizes, 1)[:, None]


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> tuple[list[str], dict]:
    """Languages and network from at most `sample` labelled documents a language.

    They are the first in the order of a hash of their id; of each one a stretch of
    `STRETCH` characters at a place fixed by that hash is learned from.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull()).where(
        remainder(F.col("doc_id"), modulus) != held
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    length = F.length("text")
    start = F.when(length > STRETCH, F.pmod(F.xxhash64("doc_id"), length - STRETCH)).otherwise(0)
    rows = keep_keys(known.select("doc_id", "lang", "text"), picked.select("doc_id").distinct(), "doc_id").select(
        "doc_id", "lang", F.substring(F.col("text"), (start + 1).cast("int"), F.lit(STRETCH)).alias("text")
    ).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    languages = sorted({r["lang"] for r in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    return languages, train([r["text"] for r in rows], languages, [number[r["lang"]] for r in rows])


def identify(docs: DataFrame, languages: list[str], model: dict, modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score.

    Null text or text without a letter: `und` with score 0; so is every text if nothing was
    learned. Null doc_id: held_out is false. Ties go to the first language by name. Further
    columns are not read; an empty table gives an empty result.
    """

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            lettered = [i for i, yes in enumerate(columns["lettered"]) if yes] if languages else []
            predicted, score = ["und"] * len(columns["text"]), np.zeros(len(columns["text"]))
            if lettered:
                pooled = score_texts(model, [columns["text"][i] for i in lettered])
                for i, k in zip(lettered, pooled.argmax(axis=1)):
                    predicted[i] = languages[k]
                score[lettered] = np.clip(pooled.max(axis=1), 0.0, 1.0)
            yield columns | {"lang_pred": predicted, "score": score}

    rows = docs.select(
        "doc_id", "text", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return map_columns(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double")
