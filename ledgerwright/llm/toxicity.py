"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network twice: as a word, by an embedding of its own, and as characters,
by the mean embedding of its character n-grams, so that unseen forms are read too. The
network runs both ways over a window of words; attention weighs the words of the window and
gives its logit. Overlapping windows cover the whole text, and the window with the largest
logit decides. The network is trained in numpy on a bounded sample of labelled documents,
each as a bag of windows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm import gru
from ledgerwright.llm.common import first_by_hash, give_back, keep_keys, map_columns, remainder, stored

HIDDEN = 8
WORD_DIM, CHAR_DIM = 4, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 13, 1 << 15
LETTERS = 64  # of an input word at most; longer words are read as several
PIECE, STEP = 8, 2  # letters of their pieces, and between the starts of pieces
PREFIXES, INNER = (1, 2, 3, 4, 5, 6), 3  # characters of the n-grams at a word's start, and within it
WINDOW, STRIDE = 32, 16  # words in a window, and between window starts
SAMPLE = {1: 1_000, 0: 2_000}  # labelled documents learned from, by label
TRAIN_WORDS = 1_200  # documents of more words are not learned from
EPOCHS, BATCH, RATE = 7, 48, 0.02
MIN_STEPS = 320  # small samples are gone through more often
TOP, EXPLORE = {1: 1, 0: 5}, 3  # windows of a document learned from, by label; others tried at first
POSITIVE, DECAY = 2.0, 2e-3  # weight of toxic documents, and shrinking of the embeddings at each step
KNOWN = 150_000  # words whose inputs a worker remembers
GROUP, PIECE_WORDS = 100_000, 49_152  # words scored together, and words of one text among them (whole strides)
LEARN_AT_ONCE = 8_192  # words whose inputs are made together
AT_ONCE = 2_048  # windows in one run of the network
ROWS_AT_ONCE = 1_024  # rows of a batch whose texts are Python strings at one time
SEED = 5
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The input words of a text: its words, those beyond `LETTERS` in parts that leave out no letter.

    Such a word is cut at underscores; a part that is still beyond `LETTERS`, as a line of a
    script without blanks, is given as overlapping pieces of about a word's length.
    """
    words = _WORD.findall(text.lower()) if text else []
    if max(map(len, words), default=0) <= LETTERS:
        return words
    return [part for word in words for part in ([word] if len(word) <= LETTERS else _parts(word))]


def _parts(word: str) -> Iterator[str]:
    for part in list(filter(None, word.split("_"))) or [word]:
        if len(part) <= LETTERS:
            yield part
        else:
            yield from (part[at:at + PIECE] for at in range(0, len(part) - PIECE + STEP, STEP))


def _stir(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a character string from that of all but its last character."""
    h = (h ^ code) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each word, number of its character n-grams, and their slots one after another.

    The n-grams are the word's prefixes and its trigrams, the first with a mark for its
    start, the last with one for its end; `words_of` gives no word beyond `LETTERS`. The
    empty word has slot 0 and the n-gram 0 for padding.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    width = int(min(max(sizes.max(), 1), LETTERS))
    codes = np.zeros((len(words), width + INNER), np.uint32)
    codes[:, :width] = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    sizes_in = np.minimum(sizes, width)
    codes[np.arange(len(words)), sizes_in] = ord(">")
    h = np.full(len(words), 7, np.uint32)
    whole, grams, there = h, [], []
    for k in range(width + 1):
        h = _stir(h, codes[:, k])
        whole = np.where(k < sizes_in, h, whole)
        if k + 1 in PREFIXES:
            grams.append(h)
            there.append(k <= sizes_in)
    for k in range(1, width - INNER + 2):
        g = np.full(len(words), 77, np.uint32)
        for i in range(INNER):
            g = _stir(g, codes[:, k + i])
        grams.append(g)
        there.append(k + INNER <= sizes_in + 1)
    there = np.stack(there, 1) if there else np.zeros((len(words), 0), bool)
    table = (np.stack(grams, 1) % np.uint32(CHAR_SLOTS - 1) + 1).astype(np.int64) if grams else np.zeros((len(words), 0), np.int64)
    own = (_stir(whole, sizes.astype(np.uint32)) % np.uint32(WORD_SLOTS - 1) + 1).astype(np.int64)
    own[sizes == 0] = 0
    there[sizes == 0] = False
    none = ~there.any(axis=1)
    there, table = np.concatenate([none[:, None], there], 1), np.concatenate([np.zeros((len(words), 1), np.int64), table], 1)
    return own, there.sum(axis=1), table[there]


def new_model() -> dict:
    rng = np.random.default_rng(SEED)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(gru.F32)
    d = WORD_DIM + CHAR_DIM
    word, char = small(WORD_SLOTS, WORD_DIM), small(CHAR_SLOTS, CHAR_DIM)
    word[0], char[0] = 0, 0
    return {
        "word": word, "char": char, "fi": small(d, 3 * HIDDEN) * 3, "bi": small(d, 3 * HIDDEN) * 3,
        "f": gru.init_layer(rng, HIDDEN), "b": gru.init_layer(rng, HIDDEN),
        "a": small(2 * HIDDEN, HIDDEN) * 3, "av": small(HIDDEN) * 3, "o": small(2 * HIDDEN) * 3, "ob": np.full(1, -1.0, gru.F32),
    }


class Words:
    """The slots that the inputs of words come from, as flat arrays."""

    def __init__(self, words: list[str]):
        self.slots, self.sizes, self.flat = slots_of(words)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)

    def take(self, which: np.ndarray) -> Words:
        """Those of some of the words."""
        part = object.__new__(Words)
        part.slots, part.sizes = self.slots[which], self.sizes[which]
        part.starts = np.concatenate(([0], np.cumsum(part.sizes)[:-1])).astype(np.int64)
        part.flat = self.flat[np.repeat(self.starts[which] - part.starts, part.sizes) + np.arange(part.sizes.sum())]
        return part

    def vectors(self, model: dict, known: np.ndarray | None = None) -> np.ndarray:
        """Input vectors: a word's own embedding beside the scaled sum of its n-grams'."""
        chars = np.add.reduceat(model["char"][self.flat], self.starts, axis=0)
        chars *= (1 / np.sqrt(self.sizes)).astype(gru.F32)[:, None]
        own = model["word"][self.slots]
        return np.concatenate([own if known is None else own * known[:, None], chars], 1)


def windows_of(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Start and length of the overlapping windows over n words; one empty window for none."""
    if n <= size:
        return [(0, n)]
    return [(at, min(size, n - at)) for at in range(0, n - size + stride, stride)]


def _pooled(states: np.ndarray, mask: np.ndarray, model: dict):
    """Attention-pooled logit of (time, batch, 2 * hidden) states, with what the gradient needs."""
    key = np.tanh(states @ model["a"])
    weight = np.where(mask, key @ model["av"], -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight *= mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    context = (weight[:, :, None] * states).sum(axis=0)
    return context @ model["o"] + model["ob"][0], (key, weight, context)


def _layout(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (at least one word each, 0 standing for none) as (time, batch), sorted by falling length."""
    lengths = np.array([max(len(w), 1) for w in ids])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    grid = np.zeros((lengths[0], len(ids)), np.int64)
    for j, i in enumerate(order):
        grid[:len(ids[i]), j] = ids[i]
    return grid, lengths, order


def window_logits(model: dict, vectors_f: np.ndarray, vectors_b: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Logits of windows of word numbers; `vectors_*` are the projected inputs by word number."""
    grid, lengths, order = _layout(windows)
    live, turn = gru.running(lengths, len(grid)), gru.backwards(grid, lengths)
    eye = np.eye(HIDDEN, dtype=gru.F32)
    hf = gru.scan_layer(vectors_f, grid, live, model["f"], eye)
    hb = gru.scan_layer(vectors_b, np.take_along_axis(grid, turn, 0), live, model["b"], eye)
    states = np.concatenate([hf, np.take_along_axis(hb, turn[None], 1)])
    key = np.tanh(np.tensordot(model["a"].T, states, 1))
    weight = np.tensordot(model["av"], key, 1)
    mask = np.arange(len(grid))[:, None] < lengths[None, :]
    weight = np.where(mask, np.exp(weight - np.abs(model["av"]).sum()), 0.0)
    weight /= weight.sum(axis=0)
    logits = np.empty(len(windows))
    logits[order] = (weight * np.tensordot(model["o"], states, 1)).sum(axis=0) + model["ob"][0]
    return logits


def _learn_windows(model: dict, vocabulary: Words, windows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rng) -> tuple[float, dict]:
    """Cross entropy of the windows' labels and the gradients of all parameters."""
    grid, lengths, order = _layout(windows)
    labels, weights = labels[order], weights[order]
    used, place = np.unique(grid, return_inverse=True)
    place = place.reshape(grid.shape)
    part = vocabulary.take(used)
    known = (rng.random(len(used)) > 0.5).astype(gru.F32)  # unseen words are to be expected
    x = part.vectors(model, known)
    live, turn = gru.running(lengths, len(grid)), gru.backwards(grid, lengths)
    back = np.take_along_axis(place, turn, 0)
    hf, kf = gru.run_layer((x @ model["fi"])[place], live, model["f"], keep=True)
    hb, kb = gru.run_layer((x @ model["bi"])[back], live, model["b"], keep=True)
    states = np.concatenate([hf, np.take_along_axis(hb, turn[:, :, None], 0)], 2)
    mask = np.arange(len(grid))[:, None] < lengths[None, :]
    logits, (key, weight, context) = _pooled(states, mask, model)
    prob = gru.sigmoid(logits)
    loss = -(weights * np.log(np.where(labels == 1, prob, 1 - prob) + 1e-7)).sum()
    d = weights * (prob - labels)
    grads = {"o": context.T @ d, "ob": np.array([d.sum()])}
    dcontext = d[:, None] * model["o"]
    dweight = (states * dcontext).sum(axis=2)
    dstates = weight[:, :, None] * dcontext
    dscore = weight * (dweight - (weight * dweight).sum(axis=0))
    grads["av"] = np.tensordot(dscore, key, ([0, 1], [0, 1]))
    dkey = dscore[:, :, None] * model["av"] * (1 - key * key)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    grads["a"] = flat(states).T @ flat(dkey)
    dstates += dkey @ model["a"].T
    dxf, grads["f"] = gru.grad_layer(dstates[:, :, :HIDDEN].astype(gru.F32), kf, live, model["f"])
    dxb, grads["b"] = gru.grad_layer(np.take_along_axis(dstates[:, :, HIDDEN:], turn[:, :, None], 0).astype(gru.F32), kb, live, model["b"])
    dx = np.zeros_like(x)
    for name, dpre, at in (("fi", dxf, place), ("bi", dxb, back)):
        per_word = np.zeros((len(used), dpre.shape[2]), gru.F32)
        np.add.at(per_word, at.reshape(-1), flat(dpre))
        grads[name] = x.T @ per_word
        dx += per_word @ model[name].T
    grads["word"] = np.zeros_like(model["word"])
    np.add.at(grads["word"], part.slots, dx[:, :WORD_DIM] * known[:, None])
    grads["char"] = np.zeros_like(model["char"])
    np.add.at(grads["char"], part.flat, np.repeat(dx[:, WORD_DIM:] / np.sqrt(part.sizes)[:, None], part.sizes, axis=0))
    grads["word"][0], grads["char"][0] = 0, 0
    return float(loss), grads


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> dict:
    """Fit the network: a document is toxic if its most toxic window is."""
    rng, model, number = np.random.default_rng(SEED), new_model(), {"": 0}
    bags = []
    for text in texts:
        ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)
        bags.append([ids[at:at + n] for at, n in windows_of(len(ids), stride=WINDOW)])
    vocabulary = Words(list(number))
    labels = np.array(labels)
    if len(set(labels.tolist())) < 2:
        model["ob"][0] = 3.0 if labels.sum() else -3.0
        return model
    adam = gru.Adam(RATE)
    epochs = max(epochs, -(-MIN_STEPS // -(-len(bags) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            picks = order[at:at + BATCH]
            flat = [(w, k) for k, i in enumerate(picks) for w in bags[i]]
            used = np.unique(np.concatenate([[0], *[w for w, _ in flat]]))
            x = vocabulary.take(used).vectors(model)
            logits = window_logits(model, x @ model["fi"], x @ model["bi"], [np.searchsorted(used, w) for w, _ in flat])
            # The windows that decide, or come near to it.
            chosen, owner = [], []
            for k, i in enumerate(picks):
                own = [j for j, (_, o) in enumerate(flat) if o == k]
                ranked = sorted(own, key=lambda j: -logits[j])
                # At first also windows that do not stand out yet: what marks them is to be found.
                best = ranked[:TOP[int(labels[i])]]
                if epoch < epochs // 2:
                    best = best + [ranked[j] for j in rng.integers(len(ranked), size=EXPLORE)]
                chosen += [flat[j][0] for j in best]
                owner += [(i, (POSITIVE if labels[i] else 1.0) / len(best))] * len(best)
            y = np.array([labels[i] for i, _ in owner])
            w = np.array([share for _, share in owner]) / BATCH
            _, grads = _learn_windows(model, vocabulary, chosen, y, w, rng)
            adam.step(model, grads, 1.0 if epoch < 0.7 * epochs else 0.3)
            for name in ("word", "char"):
                model[name] *= 1 - DECAY
    return model


class Scorer:
    """Scores whole texts; remembers the projected inputs of words it has met."""

    def __init__(self, model: dict):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        if not hasattr(self, "f"):
            self.f, self.b = (np.zeros((KNOWN, 3 * HIDDEN), gru.F32) for _ in range(2))
        self._learn([""])

    def _learn(self, words: list[str]) -> None:
        """The projected inputs of new words; there is room for `KNOWN` in all."""
        for at in range(0, len(words), LEARN_AT_ONCE):
            part, first = words[at:at + LEARN_AT_ONCE], len(self.number)
            x = Words(part).vectors(self.model)
            self.f[first:first + len(part)], self.b[first:first + len(part)] = x @ self.model["fi"], x @ self.model["bi"]
            self.number.update(zip(part, range(first, first + len(part))))

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        number = self.number
        new = list(dict.fromkeys(w for words in texts for w in words if w not in number))
        if len(number) + len(new) > KNOWN and len(number) > 1:
            self._forget()
            number = self.number
            new = list(dict.fromkeys(w for words in texts for w in words))
        if new:
            self._learn(new)
        return [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability that each whole text is toxic: that of its most toxic window."""
        best = np.full(len(texts), -np.inf)
        for group in _by_words(texts, GROUP):
            ids = self.ids([w for _, w in group])
            used, local = np.unique(np.concatenate([[0], *ids]), return_inverse=True)
            xf, xb, start, pieces = self.f[used], self.b[used], 1, []
            for (i, _), own in zip(group, ids):
                pieces += [(i, local[start + at:start + at + n]) for at, n in windows_of(len(own))]
                start += len(own)
            for at in range(0, len(pieces), AT_ONCE):
                part = pieces[at:at + AT_ONCE]
                np.maximum.at(best, [i for i, _ in part], window_logits(self.model, xf, xb, [w for _, w in part]))
        return gru.sigmoid(best)


def pieces_of(text: str | None) -> Iterator[list[str]]:
    """The input words of a text in pieces whose windows are together those of the whole.

    A piece goes on for as many words as its last window needs; what lies behind is a piece
    of its own if a window begins there.
    """
    if text is None or len(text) <= PIECE_WORDS:  # cannot have more words
        yield words_of(text)
        return
    more, first = WINDOW - STRIDE, True
    held: list[str] = []
    for word in _WORD.finditer(text.lower()):
        held += words_of(word[0])
        while len(held) > PIECE_WORDS + more:
            yield held[:PIECE_WORDS + more]
            held, first = held[PIECE_WORDS:], False
    if first or len(held) > more:
        yield held


def _by_words(texts: Iterable[str | None], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Numbered texts' pieces in groups of about `most` words; no more than one group is held as words."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for words in pieces_of(text):
            if group and size + len(words) > most:
                yield group
                group, size = [], 0
            group.append((i, words))
            size += len(words)
    if group:
        yield group


def learn(docs: DataFrame, labels: DataFrame, modulus: int | None = 5, held: int = 0) -> dict:
    """The network, from a bounded sample of labelled documents outside the held-out ones.

    At most `SAMPLE` documents of each label, the first in the order of a hash of their id,
    of at most 8 * `TRAIN_WORDS` characters; a label that has none of these is learned from
    longer ones. `modulus` None holds nothing out. Where a label has no document at all, there
    is nothing to learn: a warning says so, and all texts get one score.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if modulus:
        marks = marks.where(remainder(F.col("doc_id"), modulus) != held)
    sized = docs.where(F.col("text") != "").groupBy("doc_id").agg(F.min(F.length("text") > 8 * TRAIN_WORDS).alias("long"))
    known = stored(marks.join(sized, "doc_id"), "labelled")
    short = {r["toxic"] for r in known.where("NOT long").select("toxic").distinct().collect()}
    fit = known.where(~F.col("long") | ~F.col("toxic").isin(*short) if short else F.lit(True))
    picked = first_by_hash(fit, "toxic", "doc_id", F.when(F.col("toxic") == 1, SAMPLE[1]).otherwise(SAMPLE[0])).select("doc_id", "toxic")
    label = {r["doc_id"]: r["toxic"] for r in picked.collect()}
    if len(set(label.values())) < 2:
        warnings.warn("toxicity: labelled documents of both kinds are needed to learn anything", stacklevel=2)
    longest = F.lit(True) if short != {0, 1} else F.length("text") <= 8 * TRAIN_WORDS
    texts = keep_keys(docs.where(longest), picked, "doc_id").select("doc_id", "text").where("text <> ''").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in texts if r["doc_id"] in label)
    return train([t for _, t in rows], [label[i] for i, _ in rows])


def score_documents(docs: DataFrame, model: dict, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of each row of `docs`.

    Null or empty text, or text without a word, is scored as a window without words. Null
    doc_id: held_out is false. Rows that repeat a doc_id are scored each by itself. Further
    columns are not read; an empty table gives an empty result.
    """

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(model)
        for columns in batches:
            score = scorer.score(columns["text"])
            yield columns | {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    held_out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return map_columns(
        docs.select("doc_id", "text", held_out.alias("held_out")), make,
        "doc_id bigint, held_out boolean, score double, predicted int",
    )


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below `threshold`."""

    def run(batches):
        try:
            yield from _clean_rows(batches, Scorer(model), threshold)
        finally:
            give_back()

    return docs.mapInArrow(run, docs.schema)


def _clean_rows(batches: Iterable[pa.RecordBatch], scorer: Scorer, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            score = scorer.score(part.column("text").to_pylist())
            yield part.filter(pa.array(score < threshold))
