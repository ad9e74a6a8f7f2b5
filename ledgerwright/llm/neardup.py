"""MinHash near-duplicates with sequential Bayesian verification.

1. Each distinct shingle set gets min-hashes: bands of them name buckets, others are kept as
   a signature. Two sets at the threshold share a bucket but for a stated miss probability.
2. A candidate pair's signatures are compared batch by batch. After each batch the posterior
   probability that the pair reaches the threshold, given its matches so far, is bounded;
   below the miss probability the pair is dropped.
3. What is left is verified exactly on the full shingle sets.

Copies count once. In a bucket not all pairs are tried: each round compares every set with
its bucket's leader, and buckets whose sets are all connected are done. After these rounds
the sets of one bucket that are still apart are compared with all others, so no link between
groups is lost to the shortcut: in small buckets as pairs, in large ones a block of sets at
a time inside a task, which gives out links alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.common import keep_keys, map_columns, mix, shingle_hashes, stored, word_hashes
from ledgerwright.llm.components import merge

ROWS = 7  # min-hashes in a band
MISS = 1e-6  # chance to miss a pair at the threshold, in banding and again in pruning
BATCH, BATCHES = 32, 6  # signature values per comparison, and comparisons
STAR_ROUNDS = 2
SMALL = 16  # sets of a bucket whose pairs are rows of their own; larger buckets are cut into blocks
BLOCK, BLOCK_BYTES = 2_048, 16 << 20  # sets in a block, and bytes of their shingles
SEED = 7_919


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at `threshold` shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold ** rows)))


def needed_matches(threshold: float, miss: float = MISS, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """Least matches after each batch for which a pair is kept.

    Values are compared by 8 bits, so a pair of similarity s matches with p = s + (1 - s)/256.
    With a uniform prior the posterior of p after m of n matches is Beta(m+1, n-m+1), and its
    mass above the threshold is P(Binomial(n+1, p) <= m).
    """
    p = threshold + (1 - threshold) / 256
    need = []
    for n in range(batch, batch * batches + 1, batch):
        mass, m = 0.0, -1
        while mass < miss / batches:
            m += 1
            mass += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        need.append(m)
    return need


def surviving(a: np.ndarray, b: np.ndarray, need: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows are kept, and the matches of those; batch by batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(need):
        part = slice(k * batch, (k + 1) * batch)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def min_hashes(shingles: np.ndarray, factors: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Smallest value of each of the hash functions factor * x (odd factors, 32 bits) over the shingles.

    `buffer` has a row for each factor; the shingles go through it a width at a time.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), 2**32 - 1, np.uint32)
    for at in range(0, len(x), buffer.shape[1]):
        part = x[None, at:at + buffer.shape[1]]
        made = np.multiply(factors[:, None], part, out=buffer[:, :part.shape[1]])
        np.minimum(low, made.min(axis=1), out=low)
    return low


def _describe(docs: DataFrame, size: int, bands: int, rows: int, kept: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and signature of each row."""

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        rng = np.random.default_rng(SEED)
        total = bands * rows + kept
        factors = rng.integers(0, 2**31, total, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        buffer = np.empty((total, 256), np.uint32)
        number = np.arange(bands, dtype=np.uint64)
        for columns in batches:
            out: dict[str, list] = {"n_shingles": [], "set_key": [], "bands": [], "signature": []}
            for text in columns["text"]:
                shingles = shingle_hashes(word_hashes(text), size)
                made = (0, None, None, None)
                if len(shingles):
                    low = min_hashes(shingles, factors, buffer)
                    key = mix(number + np.uint64(1))
                    for column in low[:bands * rows].reshape(bands, rows).T:
                        key = mix(key + column)
                    signature = low[bands * rows:].astype(np.uint8).tobytes()
                    made = (len(shingles), hashlib.md5(shingles.tobytes()).hexdigest(), key.view(np.int64), signature)
                for name, value in zip(out, made):
                    out[name].append(value)
            yield {"doc_id": columns["doc_id"], **out}

    return map_columns(
        docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>, signature binary",
        release=True,
    )


def _shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its shingle hashes, for the nodes of `wanted` (node, set_key, doc_id)."""

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            sets = [shingle_hashes(word_hashes(t), size).tobytes() for t in columns["text"]]
            yield {"set_key": [hashlib.md5(s).hexdigest() for s in sets], "shingles": sets}

    rows = keep_keys(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id")
    sets = map_columns(rows.select("text"), make, "set_key string, shingles binary", release=True)
    # Rows that share an id, or a set, may bring a set twice.
    return wanted.select("node", "set_key").join(sets, "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(*(columns[c] for c in ("a", "b", "sa", "sb"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return map_columns(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), make, "a bigint, b bigint", release=True)


def _plausible(pairs: DataFrame, signatures: DataFrame, need: list[int]) -> DataFrame:
    """The pairs that sequential comparison keeps, with their matches."""

    def make(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            if columns["a"]:
                ga, gb = (np.frombuffer(b"".join(columns[c]), np.uint8).reshape(len(columns["a"]), -1) for c in ("ga", "gb"))
                alive, matches = surviving(ga, gb, need)
                yield {"a": np.array(columns["a"])[alive], "b": np.array(columns["b"])[alive], "matches": matches}

    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("ga"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("gb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    return map_columns(joined, make, "a bigint, b bigint, matches bigint")


def _linked_inside(group: pa.Table, need: list[int], percent: int) -> pa.Table:
    """Links between sets of different roots in one block of a bucket.

    A pair is looked at in the first of the bands that it shares, and no more once links
    found here connect its roots.
    """
    node, label, own = (np.array(group.column(c)) for c in ("node", "root", "own"))
    i_block, j_block, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
    signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
    keys = np.array(group.column("bands").to_pylist(), np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    found = []
    for k in range(len(node)):
        others = label != label[k]
        others[:k + 1] = False
        if i_block != j_block:
            others &= own != own[k]
        others &= 100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k])
        rest = np.flatnonzero(others)
        rest = rest[(keys[rest] == keys[k]).argmax(axis=1) == band]
        alive, matches = surviving(np.broadcast_to(signature[k], (len(rest), signature.shape[1])), signature[rest], need)
        for m in rest[alive[np.argsort(-matches, kind="stable")]]:
            if label[m] != label[k]:
                both = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                if 100 * both >= percent * (sizes[k] + sizes[m] - both):
                    found.append((node[k], node[m]))
                    label = np.where(label == label[m], label[k], label)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links_of_large(rows: DataFrame, bodies: DataFrame, need: list[int], percent: int) -> DataFrame:
    """Links in buckets of many sets; `rows` has key, band, node, root and the bucket's sets n and shingles.

    A task holds two blocks; long texts make blocks of fewer sets.
    """
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, 8 * F.col("shingles") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # A row goes to the blocks of its part with every part, its own included.
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
        F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")
    ))
    placed = rows.withColumn("parts", parts).withColumn("own", own).select("key", "band", "node", "root", "own", F.inline(blocks))
    return placed.join(bodies, "node").groupBy("key", "i", "j").applyInArrow(
        lambda group: _linked_inside(group, need, percent), "a bigint, b bigint"
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    miss: float = MISS,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are those of the lower-cased (A-Z) whole text; two documents are linked if their
    sets of `size`-word shingles have a Jaccard similarity of `percent` or more, and a
    component is what links connect. Its id is its smallest doc_id; that document is kept.

    Null, empty and blank texts have no shingles and are linked with nothing. Fewer words
    than `size` make one shingle. Null doc_id: never the id of a component with another
    document; a component of such rows alone has a null id and keeps them. Rows that
    repeat a doc_id are documents of their own that share the id. Further columns are not
    read; an empty table gives an empty result.
    """
    threshold = percent / 100
    bands = bands_for(threshold, rows, miss)
    need = needed_matches(threshold, miss)
    described = stored(_describe(docs, size, bands, rows, BATCH * BATCHES), "minhash")
    nodes = stored(
        described.where("n_shingles > 0").groupBy("set_key").agg(
            F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    entries = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    buckets = stored(entries.drop("n_shingles").join(shared, "key"), "buckets")
    hot = stored(buckets.select("node").distinct(), "hot-nodes")
    wanted = stored(nodes.join(hot, "node"), "candidates")
    sets = stored(_shingle_sets(docs, wanted.select("node", "set_key", "doc_id"), size), "sets")
    signatures = wanted.select("node", "signature")

    def still_open(roots: DataFrame) -> DataFrame:
        """Rows of the buckets whose sets are not all connected."""
        placed = buckets.join(roots, "node")
        apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return stored(placed.join(apart, "key"), "open-buckets")

    roots = hot.withColumn("root", F.col("node"))
    rows_open = still_open(roots)
    for turn in range(star_rounds):
        rank = F.xxhash64(F.col("node"), F.lit(turn))
        leaders = rows_open.groupBy("key").agg(F.min(F.struct(rank.alias("h"), F.col("node").alias("b"), F.col("root").alias("r"))).alias("l"))
        pairs = rows_open.join(leaders.select("key", "l.b", F.col("l.r").alias("other")), "key").where("root <> other").select(
            F.col("node").alias("a"), "b"
        ).distinct()
        # The likeliest of a set's leaders is verified now; the others wait for the next round.
        chosen = _plausible(pairs, signatures, need).groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
        roots = merge(roots, stored(_verified(stored(chosen, "chosen"), sets, percent), "links"))
        rows_open = still_open(roots)
    few = rows_open.where(F.col("n") <= SMALL)
    ends = [few.select("key", F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    pairs = ends[0].join(ends[1], "key").where("ra <> rb AND a < b").select("a", "b").distinct()
    links = _verified(stored(_plausible(pairs, signatures, need), "chosen"), sets, percent)
    bodies = wanted.select("node", "signature", "bands").join(sets, "node")
    links = links.unionAll(_links_of_large(rows_open.where(F.col("n") > SMALL), bodies, need, percent))
    roots = merge(roots, stored(links, "links"))
    labelled = nodes.select("node", "set_key", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = stored(labelled.join(least, "root").select("set_key", "component_id"), "classes")
    return described.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that near-copies connect to a smaller doc_id; all columns as they are.

    Rows that share a doc_id stay if one of them does, and so do rows without one.
    """
    verdicts = near_duplicates(docs, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return keep_keys(docs, verdicts.where("NOT kept"), "doc_id", how="left_anti")
