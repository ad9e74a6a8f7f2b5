"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold a conversation again and again, each time with more turns. A rolling
hash is kept over the turns: the hash of a prefix is the sum, in four 32-bit lanes, of
position-tagged digests of its turns, so it is a running total and a conversation of any
length is no single task. A conversation whose hash is that of a proper prefix of another
is dropped by an anti-join; of equal conversations the smallest id stays. What remains is
rendered. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.common import stored
from ledgerwright.operators.ordered import running_totals

# The chat markup.
START, END = "<|im_start|>", "<|im_end|>"
PART = 64  # turns rendered into one row
LANES = 4


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; null role or text count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per distinct turn of a conversation: rank from 0, hash of the turns before it and up to it.

    Turns are ordered by `turn` (null first), then digest; rows alike in all of conv_id,
    turn, role and text are one turn.
    """
    keyed = turns.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn_key"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
    ).distinct()
    keys, order = ["no_id", "key"], ["turn_key", "digest"]
    buckets = [F.floor(F.col("turn_key") / 4096), F.floor(F.col("turn_key") / 64)]
    ranked = stored(running_totals(keyed, keys, buckets, order, {"rank": F.lit(1).cast("long")}), "turn-ranks")
    tagged = F.sha2(F.concat_ws(":", F.col("rank").cast("string"), "digest").cast("binary"), 256)
    lanes = {f"h{i}": lane for i, lane in enumerate(_lanes(F.col("tag")))}
    rolled = running_totals(ranked.withColumn("tag", tagged), keys, buckets, order, lanes)
    before = [F.col(f"h{i}").cast("string") for i in range(LANES)]
    upto = [(F.col(f"h{i}") + lane).cast("string") for i, lane in enumerate(_lanes(F.col("tag")))]
    return stored(rolled.select(
        *keys, *order, "rank",
        F.when(F.col("rank") > 0, F.concat_ws(":", F.col("rank").cast("string"), *before)).alias("before"),
        F.concat_ws(":", (F.col("rank") + 1).cast("string"), *upto).alias("upto"),
    ), "turn-hashes")


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """no_id, key, n_turns and copies of the conversations that no other one continues."""
    ends = hashes.groupBy("no_id", "key").agg(
        F.count("*").alias("n_turns"), F.max_by("upto", "rank").alias("whole")
    )
    unique = ends.groupBy("whole").agg(
        F.min(F.struct("no_id", "key")).alias("c"), F.count("*").alias("copies"), F.first("n_turns").alias("n_turns")
    )
    continued = hashes.where("before IS NOT NULL").select(F.col("before").alias("whole")).distinct()
    return unique.join(continued, "whole", "left_anti").select("c.no_id", "c.key", "n_turns", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in chat markup; markup inside a text is broken up so that it cannot open a turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), safe(role), F.lit("\n"), safe(text), F.lit(END + "\n"))


def render_conversations(turns: DataFrame, part: int = PART) -> DataFrame:
    """The maximal conversations in chat markup: conv_id, part, n_turns, copies, text.

    A row holds up to `part` turns, so a conversation of any length is no single row; parts
    are numbered from 0. Null conv_id: those rows are one conversation. Null role or text
    count as empty. Further columns are not read; an empty table gives no rows.
    """
    hashes = prefix_hashes(turns)
    kept = hashes.join(maximal_conversations(hashes), ["no_id", "key"]).select(
        "no_id", "key", "turn_key", "digest", "rank", "n_turns", "copies"
    )
    rows = turns.select(
        "conv_id", F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn_key"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"), rendered_turn(F.col("role"), F.col("text")).alias("markup"),
    )
    placed = rows.join(kept, ["no_id", "key", "turn_key", "digest"])
    return placed.groupBy("conv_id", F.floor(F.col("rank") / part).cast("long").alias("part"), "n_turns", "copies").agg(
        F.array_sort(F.collect_set(F.struct("rank", "markup"))).alias("turns")
    ).select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("turns.markup"), "").alias("text"))


def oracle(part: int = PART) -> str:
    return rf"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS rank FROM t),
c AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY rank) AS turns FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(turns[1:n], ',') AS h FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM c)),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, len(any_value(turns)) AS n_turns FROM c
  WHERE array_to_string(turns, ',') NOT IN (SELECT h FROM p) GROUP BY array_to_string(turns, ','))
SELECT r.conv_id, (rank // {part})::BIGINT AS part, n_turns, copies,
  string_agg('{START}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10), '' ORDER BY rank) AS text
FROM r JOIN k ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY r.conv_id, rank // {part}, n_turns, copies"""
