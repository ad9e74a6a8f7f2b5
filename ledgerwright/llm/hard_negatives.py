"""Hard negatives by exact integer scores, computed with the method of the Four Russians.

Components are floored to integers. A candidate is kept as bit planes: of each plane eight
dimensions are one byte. For an anchor and a group of eight dimensions a table holds the sum
of the anchor's components over each of the 256 subsets, so a byte of a plane is looked up
instead of multiplied out; the planes' sums are shifted and added to the full score (the
highest plane counts negative: two's complement).

Anchors, a stated hundredth of the rows, meet all rows in blocks: a cell is a block of
anchors and a block of candidates, and gives out the best of each anchor alone. The first
pass over the cells finds positives among rows of the anchor's label, the second one
negatives within each positive's range of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ledgerwright.llm.common import stored

SCALE = 256
EVERY = 100  # rows whose id it divides are anchors
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score between which negatives lie
ANCHOR_BLOCK, CANDIDATE_BLOCK = 8_192, 8_192
ANCHORS_AT_ONCE, CANDIDATES_AT_ONCE = 128, 2_048  # whose tables and scores are held together
GROUP = 8  # dimensions of one table
ROWS_AT_ONCE = 1_024  # packed together
POSITIVE_ROWS = pa.schema([("row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE_ROWS = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and q (floored components) of the rows that take part."""
    x = lambda v: v.cast("double")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda v: F.floor(SCALE * x(v)).cast("bigint")).alias("q"),
    )


def plane_count(least: int, most: int) -> int:
    """Bit planes that hold all integers from `least` to `most` in two's complement."""
    return max(most.bit_length(), (~least).bit_length(), 0) + 1


def packed(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of (rows, dimensions) integers; dimensions are filled up with zeros."""
    rows, dims = values.shape
    bits = np.zeros((rows, planes, -(-dims // GROUP) * GROUP), np.uint8)
    for j in range(planes):
        bits[:, j, :dims] = (values >> j) & 1
    return np.packbits(bits, axis=2, bitorder="little")


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The integers of `packed`."""
    total = np.zeros((len(planes), planes.shape[2] * GROUP), np.int64)
    for j in range(planes.shape[1]):
        plane = np.unpackbits(planes[:, j], axis=1, bitorder="little").astype(np.int64) << j
        total += -plane if j == planes.shape[1] - 1 else plane
    return total


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """(groups, 256, anchors): the sum of each anchor's components over each subset of each eight dimensions."""
    count, dims = anchors.shape
    grouped = anchors.T.reshape(dims // GROUP, GROUP, count).astype(kind)
    table = np.zeros((dims // GROUP, 1 << GROUP, count), kind)
    for k in range(GROUP):
        table[:, 1 << k:2 << k] = table[:, :1 << k] + grouped[:, k, None, :]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) inner products from the anchors' tables and the candidates' planes."""
    total = np.zeros((len(planes), table.shape[2]), table.dtype)
    for j in range(planes.shape[1]):
        plane = np.zeros_like(total)
        for g in range(planes.shape[2]):
            plane += table[g][planes[:, j, g]]
        plane <<= j
        total = total - plane if j == planes.shape[1] - 1 else total + plane
    return np.ascontiguousarray(total.T)


def best(score: np.ndarray, there: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `most` largest entries of each row where `there`, ties by column; best first."""
    low = np.iinfo(score.dtype).min
    masked = np.where(there, score, low)
    if score.shape[1] > most:
        least = np.partition(masked, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
        there = there & (masked >= least[:, None])
    row, column = np.nonzero(there)
    order = np.lexsort((column, -score[row, column].astype(np.int64), row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], column[place < most]


class Cell:
    """A block of anchors and a block of candidates; candidates in the order of vec_id, null last."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, planes: int):
        def block(rows: pa.Table):
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8)
            return bits.reshape(rows.num_rows, planes, -1), np.array(rows.column("label")), np.array(rows.column("row"))

        candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.anchor_bits, self.anchor_label, self.anchor_row = block(anchors)
        self.bits, self.label, self.row = block(candidates)
        self.ids = candidates.column("vec_id")

    def blocks(self, asked: np.ndarray, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of the anchors `asked`, of the candidates `needed`, and their scores, a block of both at a time."""
        values = unpacked(self.anchor_bits[asked])
        widest = max(np.abs(values).astype(float).sum(axis=1).max(initial=0.0), 1.0) * 2.0 ** self.bits.shape[1]
        if widest >= 2.0**62:
            raise ValueError("scores of these vectors may not fit 64 bits")
        kind = np.int32 if widest < 2.0**31 else np.int64
        for at in range(0, len(asked), ANCHORS_AT_ONCE):
            table = subset_sums(values[at:at + ANCHORS_AT_ONCE], kind)
            for start in range(0, len(needed), CANDIDATES_AT_ONCE):
                some = needed[start:start + CANDIDATES_AT_ONCE]
                yield asked[at:at + ANCHORS_AT_ONCE], some, scores(table, self.bits[some])


def _joined(found: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, np.int64), *(part[k] for part in found)]) for k in range(width)]


def _positives(anchors: pa.Table, candidates: pa.Table, planes: int, most: int) -> pa.Table:
    """The best other rows of each anchor's label in one cell."""
    found: list[tuple[np.ndarray, ...]] = []
    if not anchors.num_rows or not candidates.num_rows:
        return pa.table({"row": [], "positive_id": [], "positive_score": []}, schema=POSITIVE_ROWS)
    cell = Cell(anchors, candidates, planes)
    for label in np.unique(cell.anchor_label):
        own = np.flatnonzero(cell.label == label)
        for chosen, some, score in cell.blocks(np.flatnonzero(cell.anchor_label == label), own):
            r, c = best(score, cell.anchor_row[chosen][:, None] != cell.row[some][None, :], most)
            found.append((cell.anchor_row[chosen][r], some[c], score[r, c].astype(np.int64)))
    row, number, score = _joined(found, 3)
    return pa.table({"row": row, "positive_id": cell.ids.take(pa.array(number)), "positive_score": score}, schema=POSITIVE_ROWS)


def _negatives(anchors: pa.Table, candidates: pa.Table, planes: int, most: int, low: int, high: int) -> pa.Table:
    """The best rows of other labels within each positive's range in one cell."""
    found: list[tuple[np.ndarray, ...]] = []
    if not anchors.num_rows or not candidates.num_rows:
        return pa.table({"row": [], "slot": [], "negative_id": [], "negative_score": []}, schema=NEGATIVE_ROWS)
    cell = Cell(anchors, candidates, planes)
    positives = anchors.column("positives").to_pylist()
    slots = max(map(len, positives))
    bound = np.zeros((len(positives), slots), np.int64)
    given = np.zeros((len(positives), slots), bool)
    for i, own in enumerate(positives):
        bound[i, :len(own)] = [p["positive_score"] for p in own]
        given[i, :len(own)] = True
    # Whole scores between low and high per cent of the positive's; bounds beyond the scores' type are met by none or all.
    floor, ceiling = -(-low * bound // 100), high * bound // 100
    for chosen, some, score in cell.blocks(np.arange(len(positives)), np.arange(len(cell.bits))):
        other = cell.anchor_label[chosen][:, None] != cell.label[some][None, :]
        for slot in range(slots):
            there = other & given[chosen, slot, None] & (score >= floor[chosen, slot, None]) & (score <= ceiling[chosen, slot, None])
            r, c = best(score, there, most)
            found.append((chosen[r], np.full(len(r), slot), some[c], score[r, c].astype(np.int64)))
    anchor, slot, number, score = _joined(found, 4)
    return pa.table({
        "row": cell.anchor_row[anchor], "slot": slot, "negative_id": cell.ids.take(pa.array(number)), "negative_score": score,
    }, schema=NEGATIVE_ROWS)


def _first(df: DataFrame, keys: list[str], score: str, tie: str, most: int) -> DataFrame:
    """The `most` rows of each key with the largest scores; Spark keeps no more a task before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def packed_rows(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """row, vec_id, label, is_anchor and bits of the rows that take part, written once; and the number of planes."""
    usable = usable_rows(embeddings)
    size = usable.agg(F.max(F.size("q")).alias("dims"), F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).first()
    dims, planes = max(size["dims"] or 0, 1), plane_count(size["least"] or 0, size["most"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                q = part.column("q")
                values = np.zeros((part.num_rows, dims), np.int64)
                values[np.arange(dims) < np.asarray(q.value_lengths())[:, None]] = q.flatten().to_numpy()
                bits = pa.array([b.tobytes() for b in packed(values, planes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), bits], names=["vec_id", "label", "bits"])

    made = usable.mapInArrow(run, "vec_id bigint, label bigint, bits binary")
    is_anchor = F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False))
    return stored(made.withColumns({"row": F.monotonically_increasing_id(), "is_anchor": is_anchor}), "packed-rows"), planes


def _block(row: str, count: int, size: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(max(-(-count // size), 1))).cast("int")


def _every_block(count: int, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(max(-(-count // size), 1) - 1)))


def mine(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each anchor and each of its first `positives` other rows of its label, the first
    `negatives` rows of other labels whose score lies between `low` and `high` per cent of
    the positive's. Rows with a null label, vector or component, or one that is not finite,
    take no part. A null vec_id is no anchor, keeps its label and comes last among equal
    scores. Rows that repeat a vec_id are rows of their own: each is an anchor, and each may
    be the other's positive. Shorter vectors count as filled up with zeros. A positive with
    a negative score has no such range and gives no rows. Further columns are not read; an
    empty table gives an empty result. Vectors so large that a score may not fit 64 bits are
    refused.
    """
    rows, planes = packed_rows(embeddings)
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors")).first()
    candidates = rows.select("row", "vec_id", "label", "bits", _block("row", sizes["rows"], candidate_block).alias("j"))
    candidates = candidates.withColumn("i", _every_block(sizes["anchors"], anchor_block)).groupBy("i", "j")
    anchors = rows.where("is_anchor").select("row", F.col("vec_id").alias("anchor_id"), "label", "bits")

    def cells(own: DataFrame):
        placed = own.withColumn("i", _block("row", sizes["anchors"], anchor_block)).withColumn("j", _every_block(sizes["rows"], candidate_block))
        return placed.groupBy("i", "j").cogroup(candidates)

    near = cells(anchors).applyInArrow(
        lambda a, c: _positives(a, c, planes, positives), from_arrow_schema(POSITIVE_ROWS)
    )
    ranked = _first(near, ["row"], "positive_score", "positive_id", positives)
    # No more than `positives` a row.
    chosen = stored(ranked.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")
    ), "positives")
    asking = stored(anchors.join(chosen, "row"), "asking")
    far = cells(asking).applyInArrow(
        lambda a, c: _negatives(a, c, planes, negatives, low, high), from_arrow_schema(NEGATIVE_ROWS)
    )
    kept = _first(far, ["row", "slot"], "negative_score", "negative_id", negatives)
    return kept.join(asking.select("row", "anchor_id", "positives"), "row").withColumn("positive", F.get("positives", F.col("slot"))).select(
        "anchor_id", "positive.positive_id", "rank", "negative_id", "positive.positive_score", "negative_score"
    )


def oracle() -> str:
    """SQL of `mine` with the standing parameters."""
    return r"""WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, c.row AS other, c.vec_id, a.label = c.label AS same,
  list_sum(list_transform(list_zip(a.q, c.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM e a, e c WHERE a.vec_id % 100 = 0),
p AS (SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS slot
  FROM s WHERE same AND row <> other QUALIFY slot <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.row, slot ORDER BY score DESC, s.vec_id NULLS LAST))::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON p.row = s.row
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
