"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target amount of words and a schedule of its weight over training time
(0 to 1). The integral of the schedule is the source's cumulative demand; the words of a
source, laid end to end in an order fixed by a hash and repeated as often as the target
needs, meet that demand. A document's training position is the time at which demand
reaches its first word: the inverse of the cumulative demand, a root of a quadratic per
piece of the schedule. Documents are range-sorted by that position.

Only DataFrame functions are used. The words before a document in its source are a running
total over hash buckets, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright.llm.common import WORD, keep_keys, stored, unpacked, whole
from ledgerwright.operators.ordered import running_totals

WEIGHTS = (3, 1, 2)
#: Schedules as (time, weight) knots, joined by straight lines; sources take them in turn.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)),
)
SHARE = (3, 2)  # the mix takes 3/2 of all words
MOST = 2  # times a source's own words


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """source, rank, weight, source_size and target of each source; one row a source.

    Sources are ranked by code point, null last, and weigh `weights` in turn. Targets are
    `weight * rate`, stopped at `most * source_size`, where the rate makes them add up to
    `share` of all words: the limit of sharing the excess again by weight until none is
    above. It is found in one pass over the sources by the ratio at which each one stops.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = one.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight.cast("long"))
    stop = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")), "rank")
    upto = stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    # The rate if exactly the sources that stop earlier are stopped.
    rated = ranked.select(
        "*",
        (F.lit(share[0]) * F.sum("source_size").over(everything) - F.lit(share[1] * most) * before("source_size")).alias("rest"),
        (F.sum("weight").over(everything) - before("weight")).alias("open_weight"),
        (F.lit(most) * F.col("source_size") / F.col("weight")).alias("stops_at"),
    ).withColumn("rate", F.col("rest") / (F.lit(float(share[1])) * F.col("open_weight")))
    # It holds for the first source that does not stop at it.
    good = F.min(F.when(F.col("rate") <= F.col("stops_at"), F.struct("stops_at", "rank", "rate"))).over(everything)
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("weight") * F.coalesce(good["rate"], F.lit(float("inf"))))
    return rated.select("source", "rank", "weight", "source_size", target.cast("double").alias("target"))


def position_at(share_done: Column, knots) -> Column:
    """The time at which a schedule's cumulative demand reaches `share_done` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, found = sum(areas), 0.0, None
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        left = F.greatest(share_done * F.lit(whole) - F.lit(done), F.lit(0.0))
        slope = (b[1] - a[1]) / (b[0] - a[0])
        if slope == 0:
            into = left / F.lit(a[1]) if a[1] else F.lit(0.0)
        else:
            # The root of a1*x + slope*x^2/2 = left, in the form that does not cancel.
            root = F.sqrt(F.greatest(F.lit(a[1] ** 2) + F.lit(2 * slope) * left, F.lit(0.0)))
            into = F.when(left == 0, F.lit(0.0)).otherwise(F.lit(2.0) * left / (F.lit(a[1]) + root))
        at = F.least(F.lit(a[0]) + into, F.lit(b[0]))
        done += area
        found = F.when(share_done * F.lit(whole) <= F.lit(done), at) if found is None else found.when(share_done * F.lit(whole) <= F.lit(done), at)
    return found.otherwise(F.lit(knots[-1][0]))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, schedules=SCHEDULES, keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken and `visits`.

    A visit is struct<pass, taken, position>: the words that pass takes of the document and
    its place in training (0 to 1). Passes repeat the source in the same order. All but the
    last document of a source's last pass are taken whole, so a source's taken words are
    its target rounded down; no document is taken more than `most` times.

    Null text: size 0, never visited. Null source: a source of its own, ranked last. Null
    doc_id: ordered first among its source. Rows that repeat a doc_id are rows of their
    own; equal ones are interchangeable. An empty table gives an empty result. `keep`
    names columns of `docs` to carry along.
    """
    spark_cols = ["doc_id", "source", *(keep or [])]
    sized = stored(docs.select(*dict.fromkeys(spark_cols), word_count(F.col("text")).alias("size")), "sizes")
    sources = stored(source_targets(sized, weights, share, most), "targets")
    joined = sized.withColumnRenamed("source", "own_source").join(
        sources, F.col("own_source").eqNullSafe(F.col("source")), "inner"
    ).drop("source").withColumnRenamed("own_source", "source")
    # The order in a source is that of a hash of the id; buckets are its leading digits.
    placed = joined.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    counted = running_totals(
        placed, ["rank"], [F.substring("mark", 1, 2), F.substring("mark", 1, 4)], ["mark", "size", "doc_id"],
        {"before": F.col("size")},
    )
    whole = F.floor("target").cast("long")
    passes = F.when((F.col("source_size") > 0) & (F.col("size") > 0) & (whole > 0), F.ceil(whole / F.col("source_size")).cast("int"))

    def visit(p: Column) -> Column:
        start = p.cast("long") * F.col("source_size") + F.col("before")
        taken = F.greatest(F.least(whole - start, F.col("size")), F.lit(0))
        done = start.cast("double") / whole.cast("double")
        position = None
        for i, knots in enumerate(schedules):
            at = position_at(done, knots)
            position = F.when(F.col("rank") % len(schedules) == i, at) if position is None else position.when(F.col("rank") % len(schedules) == i, at)
        return F.struct(p.alias("pass"), taken.cast("long").alias("taken"), position.alias("position"))

    visits = F.when(passes > 0, F.filter(F.transform(F.sequence(F.lit(0), passes - 1), visit), lambda v: v["taken"] > 0))
    return counted.withColumn("visits", F.coalesce(visits, F.array().cast("array<struct<pass:int,taken:bigint,position:double>>"))).select(
        *dict.fromkeys(spark_cols), "size", "source_size", "target",
        F.aggregate("visits", F.lit(0).cast("long"), lambda acc, v: acc + v["taken"]).alias("taken"), "visits",
    )


def in_training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per visit, range-partitioned and sorted by training position."""
    rest = [c for c in mixed.columns if c not in ("visits", "taken")]
    rows = mixed.select(*rest, F.explode("visits").alias("v")).select(*rest, "v.*")
    order = ["position", "pass", "doc_id"]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def training_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` as often as the mix takes each row, range-sorted by training position; all columns as they are.

    A pass that takes less than half of a document leaves it out, so that each source's
    words differ from its target by half a document. Documents without words are left out.
    Positions are computed on ids and sizes alone; texts are shuffled to meet them and to be
    sorted, no more. Rows that repeat both doc_id and text share their visits.
    """
    marked = whole(docs, "doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text"))
    mixed = mix(marked, keep=["text_hash"], **options)
    half = F.filter("visits", lambda v: 2 * v["taken"] >= F.col("size"))
    visits = stored(
        mixed.where("size > 0").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(half)).alias("visits")).where(F.size("visits") > 0)
        .select(F.col("doc_id").alias("visited_id"), F.col("text_hash").alias("visited_hash"), "visits"),
        "visits",
    )
    # Rows that repeat a key carry the visits of all of them: one of them is enough.
    repeated = stored(marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    marked = marked.select("row", "doc_id", "text_hash")
    if not repeated.isEmpty():
        single = keep_keys(marked, repeated, "doc_id", "text_hash").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
        marked = keep_keys(marked, repeated, "doc_id", "text_hash", how="left_anti").unionByName(single)
    rows = marked.join(visits, F.col("doc_id").eqNullSafe(F.col("visited_id")) & (F.col("text_hash") == F.col("visited_hash"))).select(
        "row", "doc_id", F.explode("visits").alias("visit")
    )
    order = [F.col("visit.position"), F.col("visit.pass"), F.col("doc_id")]
    return unpacked(rows.repartitionByRange(*order).sortWithinPartitions(*order), docs)


def mix_report(mixed: DataFrame) -> DataFrame:
    """Digest of `mix`: the columns of the contract, the number of visits and the positions of the first and the last
    one (0 to 1, nine places; null where there is none), one row per row of documents, in training order.

    Rows are range-partitioned and sorted by the first position; those never visited come last.
    """
    first, last = F.get("visits", F.lit(0))["position"], F.try_element_at("visits", F.lit(-1))["position"]
    placed = mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("visits").alias("visits"), first.alias("at"),
        F.round(first, 9).alias("first_position"), F.round(last, 9).alias("last_position"),
    )
    order = [F.col("at").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")


def _position_sql(share: str, knots) -> str:
    """SQL of `position_at`."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    cases, done = [], 0.0
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        slope = (b[1] - a[1]) / (b[0] - a[0])
        left = f"greatest({share} * {sum(areas)}::DOUBLE - {done}::DOUBLE, 0.0::DOUBLE)"
        into = f"{left} / {a[1]}::DOUBLE" if slope == 0 else (
            f"CASE WHEN {left} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {left} / ({a[1]}::DOUBLE + sqrt({a[1] ** 2}::DOUBLE + {2 * slope}::DOUBLE * {left})) END"
        )
        done += area
        cases.append(f"WHEN {share} * {sum(areas)}::DOUBLE <= {done}::DOUBLE THEN least({a[0]}::DOUBLE + {into}, {b[0]}::DOUBLE)")
    return f"CASE {' '.join(cases)} ELSE {knots[-1][0]}::DOUBLE END"


def oracle() -> str:
    """SQL of `mix_report` with the standing parameters."""
    def position(p: str) -> str:
        share = f"(({p} * source_size + before)::DOUBLE / whole::DOUBLE)"
        cases = " ".join(f"WHEN {i} THEN {_position_sql(share, knots)}" for i, knots in enumerate(SCHEDULES))
        return f"CASE WHEN len(passes) > 0 THEN round(CASE rank % 3 {cases} END, 9) END"

    return r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1]::BIGINT AS weight FROM s),
o AS (SELECT *, 2 * source_size / weight AS stops_at, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
  coalesce(sum(source_size) OVER before, 0) AS stopped, coalesce(sum(weight) OVER before, 0) AS gone FROM w
  WINDOW before AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (3 * words - 4 * stopped)::DOUBLE / (2.0::DOUBLE * (weights - gone)::DOUBLE) AS rate FROM o),
g AS (SELECT min_by(rate, stops_at) AS rate FROM r WHERE rate <= stops_at),
t AS (SELECT r.source, rank, source_size, least(2.0::DOUBLE * source_size::DOUBLE, weight::DOUBLE * coalesce(g.rate, 'inf'::DOUBLE)) AS target FROM r, g),
c AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, floor(t.target)::HUGEINT AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 THEN greatest(least(whole - before, size), 0) ELSE 0 END AS one,
  CASE WHEN size > 0 THEN greatest(least(whole - source_size - before, size), 0) ELSE 0 END AS two FROM c),
v AS (SELECT *, CASE WHEN one > 0 THEN [0] ELSE [] END || CASE WHEN two > 0 THEN [1] ELSE [] END AS passes FROM n)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, len(passes)::INTEGER AS visits,
  @first AS first_position, @last AS last_position FROM v""".replace("@first", position("passes[1]")).replace("@last", position("passes[-1]"))
