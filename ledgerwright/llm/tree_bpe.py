"""Byte-level BPE of whole texts by tree concatenation, and decoding.

A text beyond a bound is halved until its parts are within it; the parts, cut anywhere, are
encoded in parallel and joined again pair by pair up the tree. Each node's ids are exactly
those of its own text. At a join only a window around the cut is encoded anew; it grows
until both sides agree:

- Before white space that follows other characters a text can always be cut without a
  change of ids: no token of the vocabulary's rule goes across. Between the last such place
  on the left and the first on the right the text is encoded anew.
- Where a single unsplit stretch (a long word, number or run) goes across the cut, tokens
  next to the cut are merged anew, twice as many each time, until the window's first token
  is the left side's and its last one the right side's. Ids are those of BPE if each pair of
  neighbours is, and then all pairs are ones that BPE made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.common import map_columns, stored
from ledgerwright.llm.tokens import SPACES, Encoder, encoder

LEAF = 16_384  # characters of a part at most
WINDOW = 8  # tokens on either side that a window starts with
AT_ONCE = 4_000_000  # characters of parts handed on together
UNSPLIT = 1_024  # characters from which a stretch across a cut is joined token by token

_CUT = regex.compile(f"(?<=[^{SPACES}])[{SPACES}]")
_CUT_BACK = regex.compile(f"(?r)(?<=[^{SPACES}])[{SPACES}]")


class TreeEncoder:
    """Joins ids of neighbouring parts of a text; `leaf` encodes a part by itself."""

    def __init__(self, base: Encoder):
        self.base = base
        self.rule = regex.compile(base.pattern)

    def leaf(self, text: str) -> np.ndarray:
        return self.base.ids(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.base.decode(ids)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the concatenated texts of two sequences, each that of a text by itself."""
        if not len(left) or not len(right):
            return right if not len(left) else left
        a, tail = self._tail(left)
        b, head = self._head(right)
        middle = self._middle(tail, head, left[a:], right[:b])
        return np.concatenate([left[:a], middle, right[b:]])

    def _tail(self, left: np.ndarray) -> tuple[int, str]:
        """The place of the last safe cut of the left side, and the text behind it; all of it if there is none."""
        k = WINDOW
        while k < len(left):
            found = self._last_cut(left, len(left) - k)
            if found:
                return found
            k *= 2
        return self._last_cut(left, 0) or (0, self.decode(left).decode())

    def _last_cut(self, left: np.ndarray, at: int) -> tuple[int, str] | None:
        raw = self.decode(left[at:])
        skip = _continuation(raw)
        text = raw[skip:].decode()
        cut = _CUT_BACK.search(text)
        if not cut:
            return None
        rest = text[cut.start():]
        return self._token_at(left, len(rest.encode()), from_end=True), rest

    def _head(self, right: np.ndarray) -> tuple[int, str]:
        """The place of the first safe cut of the right side, and the text before it; all of it if there is none."""
        k = WINDOW
        while k < len(right):
            raw = self.decode(right[:k])
            text = raw.decode(errors="ignore")  # the last character may be cut
            cut = _CUT.search(text)
            if cut:
                rest = text[:cut.start()]
                return self._token_at(right, len(rest.encode())), rest
            k *= 2
        text = self.decode(right).decode()
        cut = _CUT.search(text)
        if cut:
            rest = text[:cut.start()]
            return self._token_at(right, len(rest.encode())), rest
        return len(right), text

    def _token_at(self, ids: np.ndarray, size: int, from_end: bool = False) -> int:
        """The index of the token that starts `size` bytes from the start, or from the end."""
        seen, i = 0, len(ids) if from_end else 0
        while seen < size:
            i += -1 if from_end else 1
            seen += len(self.base.tokens[ids[i if from_end else i - 1]])
        if seen != size:
            raise AssertionError("a token goes across a place where texts can be cut")
        return i

    def _middle(self, tail: str, head: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of tail + head, whose own ids are `left` and `right`."""
        text, cut = tail + head, len(tail)
        if len(text) < UNSPLIT or any(t in text for t in self.base.added):
            return self.leaf(text)
        for m in self.rule.finditer(text):
            if m.end() >= cut:
                break
        x, y = m.span()
        if y == cut or y - x < UNSPLIT:
            return self.leaf(text)
        # One stretch goes across. What lies before it is as it was; is it cut off alike on the right?
        own = self.rule.match(head)
        if own.end() != y - cut:
            return self.leaf(text)
        a = self._token_at(left, len(text[x:cut].encode()), from_end=True)
        b = self._token_at(right, len(text[cut:y].encode()))
        return np.concatenate([left[:a], self._stretch(left[a:], right[:b]), right[b:]])

    def _stretch(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of one unsplit stretch from those of its two parts."""
        k = WINDOW
        while True:
            lk, rk = min(k, len(left)), min(k, len(right))
            window = self.base.piece(self.decode(left[len(left) - lk:]) + self.decode(right[:rk]))
            agrees_left = lk == len(left) or window[0] == left[len(left) - lk]
            agrees_right = rk == len(right) or window[-1] == right[rk - 1]
            if agrees_left and agrees_right:
                return np.concatenate([left[:len(left) - lk], window, right[rk:]])
            k *= 2


def _continuation(raw: bytes) -> int:
    """Bytes at the start that end a character begun before."""
    skip = 0
    while skip < len(raw) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    return skip


@lru_cache(maxsize=2)
def tree_encoder(ranks_path: str | None = None) -> TreeEncoder:
    """One a worker process."""
    return TreeEncoder(encoder(ranks_path))


def depth_of(n: int, leaf: int = LEAF) -> int:
    """Halvings after which no part has more than `leaf` characters."""
    return max(-(-n // leaf) - 1, 0).bit_length()


def encode_whole(text: str, leaf: int = LEAF, own: TreeEncoder | None = None) -> np.ndarray:
    """The tree in one place: what `encode_long` does over the cluster."""
    own, depth = own or tree_encoder(), depth_of(len(text), leaf)
    cuts = [len(text) * i >> depth for i in range((1 << depth) + 1)]
    nodes = [own.leaf(text[a:b]) for a, b in zip(cuts, cuts[1:])]
    while len(nodes) > 1:
        nodes = [own.join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
    return nodes[0]


def encode_long(texts: DataFrame, ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """`texts` (row, text and columns to keep) with ids (binary, unsigned 32 bits) instead of text, by the tree.

    Parts are dealt over the cluster before they are encoded, so one text is no single
    task; each level of the tree is a shuffle of ids, written before the next begins.
    """
    kept = [c for c in texts.columns if c != "text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text") + ", depth int, node bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def made(pieces: list[tuple]) -> pa.RecordBatch:
                of, depths, nodes, parts = zip(*pieces) if pieces else ((),) * 4
                rows = pa.Table.from_batches([batch.select(kept)]).take(pa.array(of, pa.int64()))
                own = [pa.array(depths, pa.int32()), pa.array(nodes, pa.int64()), pa.array(parts, pa.string())]
                return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), *own], names=[*kept, "depth", "node", "part"])

            pieces, size = [], 0
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                depth = depth_of(len(text), leaf)
                for node in range(1 << depth):
                    pieces.append((i, depth, node, text[len(text) * node >> depth:len(text) * (node + 1) >> depth]))
                    size += len(pieces[-1][-1])
                    if size > AT_ONCE:
                        yield made(pieces)
                        pieces, size = [], 0
            yield made(pieces)

    parts = texts.select(*kept, "text").mapInArrow(cut, f"{shape}, part string").repartition("row", "node")

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        own = tree_encoder(ranks_path)
        for columns in batches:
            yield columns | {"ids": [own.leaf(t).tobytes() for t in columns["part"]]}

    shape = f"{shape}, ids binary"
    leaves = stored(map_columns(parts, encode, shape), "tree-leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0

    def join(batches: Iterator[dict]) -> Iterator[dict]:
        own = tree_encoder(ranks_path)
        as_ids = lambda b: np.frombuffer(b, np.uint32)
        for columns in batches:
            yield columns | {"ids": [own.join(as_ids(a), as_ids(b)).tobytes() for a, b in zip(columns["left"], columns["right"])]}

    nodes = leaves.where(F.col("depth") == deepest)
    for level in range(deepest, 0, -1):
        # Of each row one of the two is null, so its ids are shuffled once.
        pairs = nodes.groupBy(*kept, (F.col("depth") - 1).alias("depth"), F.shiftright("node", 1).alias("node")).agg(
            F.max(F.when(F.col("node") % 2 == 0, F.col("ids"))).alias("left"), F.max(F.when(F.col("node") % 2 == 1, F.col("ids"))).alias("right")
        )
        joined = stored(map_columns(pairs, join, shape), f"tree-{level}")
        nodes = joined.unionByName(leaves.where(F.col("depth") == level - 1))
    return nodes.select(*kept, "ids")


def _digests(own: TreeEncoder, ids: np.ndarray) -> tuple[int, str, str]:
    decoded = own.decode(ids).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _report(make_ids: Callable[[TreeEncoder, dict], Iterator[np.ndarray]], ranks_path: str | None):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = tree_encoder(ranks_path)
        for columns in batches:
            made = [_digests(own, ids) for ids in make_ids(own, columns)]
            n, ids, decoded = zip(*made) if made else ((), (), ())
            yield {"doc_id": columns["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return run


REPORT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (binary, unsigned 32 bits, little-endian) of each row of `docs`.

    The ids are those that the `tokenizers` file of the vocabulary gives, without added
    special tokens; its added tokens are found inside texts. Null text counts as empty and
    has no ids. Null and repeated doc_ids: each row is a text by itself. Further columns are
    not read. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"))

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        tree = tree_encoder(ranks_path)
        for columns in batches:
            yield {"doc_id": columns["doc_id"], "ids": [tree.leaf(t).tobytes() for t in columns["text"]]}

    short = map_columns(own.where(F.length("text") <= leaf), encode, "doc_id bigint, ids binary")
    return short.unionByName(encode_long(_long(own, leaf), ranks_path, leaf).drop("row"))


def _long(own: DataFrame, leaf: int) -> DataFrame:
    return own.where(F.length("text") > leaf).withColumn("row", F.monotonically_increasing_id())


def encode_report(docs: DataFrame, ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs`; as `encode_documents` otherwise.

    Texts within `leaf` are encoded and decoded where they are read; nothing of them is shuffled or written.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = _report(lambda tree, columns: (tree.leaf(t) for t in columns["text"]), ranks_path)
    long = _report(lambda tree, columns: (np.frombuffer(b, np.uint32) for b in columns["ids"]), ranks_path)
    joined = encode_long(_long(own, leaf), ranks_path, leaf)
    return map_columns(own.where(F.length("text") <= leaf), short, REPORT).unionByName(map_columns(joined.drop("row"), long, REPORT))


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and text of each row of `encoded` (doc_id, ids as `encode_documents` gives them).

    Special tokens are kept. Bytes that are no UTF-8 become the replacement character. Null
    ids give null text.
    """

    def decode(batches: Iterator[dict]) -> Iterator[dict]:
        tree = tree_encoder(ranks_path)
        for columns in batches:
            texts = [None if b is None else tree.decode(np.frombuffer(b, np.uint32)).decode("utf-8", "replace") for b in columns["ids"]]
            yield {"doc_id": columns["doc_id"], "text": texts}

    return map_columns(encoded.select("doc_id", "ids"), decode, "doc_id bigint, text string")
