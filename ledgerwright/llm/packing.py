"""Vector bin packing of examples into training sequences.

An example takes three resources of a sequence: tokens, segments (one each) and loss-bearing
tokens. A sequence is filled greedily by the dot-product heuristic: of the waiting examples
that fit all three limits, the one whose demand has the largest dot product with what is
left, both scaled by the limits. Where examples may be cut, one that no longer fits is cut
to fill the sequence, so that padding comes only from sequences whose segments or
loss-bearing tokens run out and from the last sequence of a group, whose tail is laid out in
pieces of a power of two.

Rows are packed where Spark reads them, a bounded group at a time: nothing is shuffled, no
task holds more than one group, and a lost task is simply run again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerwright.llm.common import map_columns
from ledgerwright.llm.tokens import encoder

GROUP_TOKENS = 4_000_000  # a group's ids take 16 MB
GROUP_EXAMPLES = 4_000


@dataclass(frozen=True)
class Limits:
    """What one sequence holds."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def pack_group(sizes: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length).

    `sizes` and `loss` give each example's tokens and how many of its last tokens bear loss.
    With `cut`, an example may lie in several pieces; a piece's loss-bearing tokens are those
    of its range. Without, an example beyond a limit raises ValueError.
    """
    sizes, loss = np.asarray(sizes, np.int64), np.asarray(loss, np.int64)
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    sequences: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(sizes), np.int64)
    if cut:
        for i in np.flatnonzero(sizes >= limits.tokens):
            while sizes[i] - start[i] >= limits.tokens:
                n = _fitting(start[i], sizes[i], loss[i], limits.tokens, limits.loss_tokens)
                if n < limits.tokens:
                    break  # loss-bearing tokens run out first: left to the heuristic
                sequences.append([(int(i), int(start[i]), n)])
                start[i] += n
    elif ((sizes > limits.tokens) | (loss > limits.loss_tokens)).any():
        raise ValueError("an example is larger than a sequence")
    left = sizes - start
    demand = np.stack([left, np.ones_like(left), np.minimum(loss, left)], 1).astype(np.float64)
    waiting = left > 0
    while waiting.any():
        room = cap.copy()
        sequence: list[tuple[int, int, int]] = []
        live = np.flatnonzero(waiting)
        need = demand[live]
        while True:
            fits = (need <= room).all(1)
            if not fits.any():
                break
            score = np.where(fits, need @ (room / cap**2), -1.0)
            k = int(score.argmax())
            i = live[k]
            sequence.append((int(i), int(start[i]), int(demand[i, 0])))
            room -= need[k]
            waiting[i] = False
            need[k] = 1e18
            if room[0] <= 0 or room[1] <= 0:
                break
        if cut and room[0] >= 1 and room[1] >= 1 and waiting.any():
            # The largest that waits gives what is still free.
            i = int(np.flatnonzero(waiting)[demand[waiting, 0].argmax()])
            n = _fitting(start[i], sizes[i], loss[i], int(room[0]), int(room[2]))
            n = min(n, int(demand[i, 0]))
            if n > 0:
                sequence.append((i, int(start[i]), n))
                start[i] += n
                rest = sizes[i] - start[i]
                demand[i, 0], demand[i, 2] = rest, min(loss[i], rest)
                waiting[i] = rest > 0
        if not sequence:
            raise ValueError("an example cannot be placed under these limits")
        sequences.append(sequence)
    if cut and sequences:
        sequences[-1:] = powers_of_two(sequences[-1], limits.tokens)
    return sequences


def _fitting(start: int, size: int, loss: int, tokens: int, loss_tokens: int) -> int:
    """How many tokens from `start` on keep to both limits; the last `loss` of `size` bear loss."""
    silent = max(size - loss - start, 0)
    return int(min(tokens, silent + loss_tokens, size - start))


def powers_of_two(sequence: list[tuple[int, int, int]], full: int) -> list[list[tuple[int, int, int]]]:
    """A sequence that is not full, laid out again in sequences of a power of two each."""
    total = sum(n for _, _, n in sequence)
    if total == full or is_power(total):
        return [sequence]
    out, room, pieces = [], 0, list(reversed(sequence))
    while pieces:
        if room == 0:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out.append([])
        i, start, n = pieces.pop()
        take = min(n, room)
        out[-1].append((i, start, take))
        room -= take
        if take < n:
            pieces.append((i, start + take, n - take))
    return out


def file_ranges(docs: DataFrame) -> dict[tuple[str, int], int]:
    """Numbers of the file blocks that Spark reads `docs` from, in the order in which their rows were written."""
    blocks = docs.select("_metadata.file_path", "_metadata.file_block_start").distinct().collect()

    def place(block: tuple[str, int]) -> tuple[int, str, int]:
        name = block[0].rpartition("/")[2]
        part = re.match(r"part-(\d+)", name)
        return int(part[1]) if part else -1, name, block[1]

    return {block: i for i, block in enumerate(sorted(map(tuple, blocks), key=place))}


SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"
)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), end_id: int = 1, ranks_path: str | None = None, ids: bool = False, ordered: bool = False, release: bool = False) -> DataFrame:
    """Pieces of all documents, packed: `SCHEMA`, and the piece's ids if `ids` is set.

    A document's ids are those of its whole text and `end_id`; each id lies in exactly one
    piece. Every token bears loss but the first of a document, which nothing predicts. Null
    or empty text: `end_id` alone. Null doc_id stays null. Rows that repeat a doc_id are
    packed each by itself. Further columns are not read; an empty table gives no pieces. A
    text longer than a group is a group of its own.

    `sequence_id` is the partition's number and a count inside it; offsets in a sequence run
    gapless from 0. Spark reads files in an order of its own. With `ordered`, for `docs` read
    from files whose order means something, the number of the file's block in name order
    takes the place of the partition's, and no sequence holds rows of two blocks: ids rise
    along the files from group to group, in any order inside a group. With `release`, a task
    gives its memory back when it is done, that of the encoder included.
    """
    ranges = file_ranges(docs) if ordered else {}
    schema = SCHEMA + (", ids array<int>" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        encode = encoder(ranks_path)
        base = TaskContext.get().partitionId() << 36
        block, made, keys, rows = None, 0, [], []

        def packed() -> dict:
            nonlocal made, keys, rows
            sizes = np.array([len(r) for r in rows], np.int64)
            out = []
            for sequence in pack_group(sizes, sizes - 1, limits, cut=True):
                offset = 0
                for i, start, n in sequence:
                    piece = rows[i][start:start + n]
                    row = (keys[i], start, n, zlib.crc32(piece.tobytes()), len(rows[i]), base + made, offset, n - (start == 0))
                    out.append((*row, piece.astype(np.int32)) if ids else row)
                    offset += n
                made += 1
            keys, rows = [], []
            return dict(zip(names, map(list, zip(*out))))

        tokens = 0
        for columns in batches:
            blocks = zip(columns["file_path"], columns["file_block_start"]) if ordered else repeat(None)
            for key, text, own in zip(columns["doc_id"], columns["text"], blocks):
                if own != block:
                    if rows:
                        yield packed()
                        tokens = 0
                    block, base, made = own, ranges[own] << 36, 0
                got = np.append(encode.ids(text), np.uint32(end_id)).astype("<u4")
                if rows and (tokens + len(got) > GROUP_TOKENS or len(rows) >= GROUP_EXAMPLES):
                    yield packed()
                    tokens = 0
                keys.append(key)
                rows.append(got)
                tokens += len(got)
        if rows:
            yield packed()
        if release:
            encoder.cache_clear()

    place = ["_metadata.file_path", "_metadata.file_block_start"] if ordered else []
    return map_columns(docs.select("doc_id", "text", *place), make, schema, release)


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Instruction data: rows of (example_id bigint, tokens bigint, loss_tokens bigint), never cut.

    Gives example_id, sequence_id, offset. Nulls count as 0, and an example of 0 tokens
    still takes a segment; loss beyond an example's tokens counts up to them. An example
    beyond a limit ends the job with an error, as no sequence can hold it.
    """

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        base, made = TaskContext.get().partitionId() << 36, 0
        for columns in batches:
            for at in range(0, len(columns["tokens"]), GROUP_EXAMPLES):
                names, *counts = (columns[c][at:at + GROUP_EXAMPLES] for c in ("example_id", "tokens", "loss_tokens"))
                sizes, loss = (np.array([n or 0 for n in c], np.int64) for c in counts)
                sequences = pack_group(sizes, np.minimum(loss, sizes), limits, cut=False)
                empty = np.flatnonzero(sizes == 0)
                sequences += [[(i, 0, 0) for i in empty[k:k + limits.segments]] for k in range(0, len(empty), limits.segments)]
                out: dict[str, list] = {"example_id": [], "sequence_id": [], "offset": []}
                for sequence in sequences:
                    offset = 0
                    for i, _, n in sequence:
                        for column, value in zip(out.values(), (names[i], base + made, offset)):
                            column.append(value)
                        offset += n
                    made += 1
                yield out

    return map_columns(examples.select("example_id", "tokens", "loss_tokens"), make, "example_id bigint, sequence_id bigint, offset bigint")
