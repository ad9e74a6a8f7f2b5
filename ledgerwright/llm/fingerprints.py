"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each distinct shingle is hashed once. The leading bits of the hash name a bin, and a bin
keeps its smallest hash. An empty bin takes the value of the first filled bin on its own
fixed random walk over the bins, which depends on the bin alone (optimal densification):
two documents agree on a bin with a probability that is their Jaccard similarity. Of each
bin the lowest bits are kept, packed; likeness takes out the share of bins that agree by
chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.llm.common import map_columns, mix, shingle_hashes, stored, word_hashes

SHINGLE = 5
BINS = 1024  # a power of two
BITS = 4
SEED = 20_240_501


@lru_cache(maxsize=4)
def walks(bins: int) -> np.ndarray:
    """For each bin the order in which it visits the bins: a random permutation of its own."""
    rng = np.random.default_rng(SEED)
    return np.argsort(rng.random((bins, bins), dtype=np.float32), axis=1).astype(np.uint16)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The value of each bin after densification; None without shingles."""
    if not len(shingles):
        return None
    h = np.sort(mix(shingles ^ np.uint64(SEED)))
    width = np.uint64(64 - (bins.bit_length() - 1))
    bin_of = (h >> width).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    values = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    values[bin_of[first]] = h[first]
    filled[bin_of[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        walk, at, step = walks(bins), 0, max(8, 2 * bins // max(len(first), 1))
        source = np.empty(bins, np.int64)
        while len(empty):
            seen = filled[walk[empty, at:at + step]]
            hit = seen.any(axis=1)
            found = empty[hit]
            source[found] = walk[found, at + seen[hit].argmax(axis=1)]
            empty, at, step = empty[~hit], at + step, step * 2
        holes = np.flatnonzero(~filled)
        values[holes] = values[source[holes]]
    # Hashed with the bin's number: what a short text repeats over many bins then agrees by chance bin by bin.
    return mix(values + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def packed(sig: np.ndarray | None, bits: int = BITS) -> bytes:
    """Lowest bits of every bin, packed; nothing for a document without shingles."""
    if sig is None:
        return b""
    low = (sig & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two packed fingerprints, without the bias of chance.

    Two documents without shingles are alike (1), one of them alone is not (0).
    """
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(bins, bits).any(axis=1)
    agree = 1.0 - differ.mean()
    chance = 2.0 ** -bits
    return float(min(max((agree - chance) / (1.0 - chance), 0.0), 1.0))


def fingerprint(text: str | None, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed fingerprint of a whole text by its `size`-word shingles; empty without words."""
    return packed(signature(shingle_hashes(word_hashes(text), size), bins), bits)


def as_text(print_: bytes) -> str:
    return base64.b64encode(print_).decode()


def fingerprint_documents(docs: DataFrame, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint (binary) of each row of `docs`; null text counts as empty."""

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            yield {"doc_id": columns["doc_id"], "fingerprint": [fingerprint(t, size, bins, bits) for t in columns["text"]]}

    return map_columns(docs.select("doc_id", "text"), make, "doc_id bigint, fingerprint binary")


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_sequence(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt into ranges of doc_id, each with the row that follows its last one.

    Columns bucket, doc_id, text, guest. Sorted by bucket, then doc_id descending, a bucket
    holds its own rows and, as guest, the first row of the next one (the first of all after
    the last), so that each row meets its successor. Whole texts are shuffled once.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    if partitions < 2:
        cuts = []
    else:
        # Borders of about equal ranges; any borders give the same result.
        shares = [i / partitions for i in range(1, partitions)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10_000).alias("c")).first()["c"] or []))
    bucket = _borders_above(F.col("doc_id"), cuts)
    rows = docs.select(bucket.alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The first row of each bucket, by id and, where ids repeat, a digest of the text: one row a bucket.
    mark = F.xxhash64("text")
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").alias("id"), mark.alias("mark"))).alias("head"))
    # A head follows the last row of the bucket before it; that of the first bucket the last of all.
    everything, order = Window.partitionBy(), Window.orderBy("bucket")
    homes = stored(heads.select(
        "bucket", "head", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(everything)).alias("home")
    ), "range-heads")
    met = rows.withColumn("mark", mark).join(F.broadcast(homes), "bucket")
    place = lambda b, guest: F.struct(F.col(b).alias("bucket"), F.lit(guest).alias("guest"))
    is_head = F.struct(F.col("doc_id").alias("id"), F.col("mark")).eqNullSafe(F.col("head"))
    places = F.when(is_head, F.array(place("bucket", False), place("home", True))).otherwise(F.array(place("bucket", False)))
    return met.select("doc_id", "text", "mark", F.inline(places)).repartitionById(len(cuts) + 2, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("mark").desc()
    )


def _borders_above(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted borders lie above the id; one more than there are for null.

    Looked up in two steps, first among every k-th border, so that a row meets about twice
    the root of their number.
    """
    if not cuts:
        return F.when(doc_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    coarse, fine = F.array(*[F.lit(c) for c in cuts[::step]]), F.array(*[F.lit(c) for c in cuts])
    below = F.size(F.filter(coarse, lambda c: c <= doc_id))  # the id lies in the stretch that the last of these opens
    start = F.greatest(below - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(fine, start + 1, step), lambda c: c <= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - start - inside)


REPORT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edit_report(docs: DataFrame, partitions: int | None = None, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The next document is that of the next smaller doc_id, after the smallest the largest.
    Rows that repeat a doc_id follow each other in the order of a digest of their text;
    null ids come last. Null text counts as empty. A table of one row follows itself. An
    empty table gives an empty result. Further columns are not read.
    """

    names = [c.split()[0] for c in REPORT.split(", ")]

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        waiting = None  # the last row that has not met its successor: bucket, id, text, fingerprint
        for columns in batches:
            out: list[tuple] = []
            for bucket, doc_id, text, guest in zip(*(columns[c] for c in ("bucket", "doc_id", "text", "guest"))):
                own = fingerprint(text, size, bins, bits)
                if waiting is not None and waiting[0] == bucket:
                    _, last_id, last_text, last = waiting
                    changed = edited_text(last_text, text)
                    edited = fingerprint(changed, size, bins, bits)
                    out.append((
                        last_id, len(last_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(last), as_text(edited), likeness(last, edited, bins, bits), likeness(last, own, bins, bits),
                    ))
                waiting = None if guest else (bucket, doc_id, text, own)
            yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    return map_columns(in_sequence(docs, partitions).select("bucket", "doc_id", "text", "guest"), make, REPORT)
