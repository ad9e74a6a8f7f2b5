"""How filters interact: what each removes at each place of each order, by a recursive query.

A document's failures are one mask, a bit per filter. Documents are counted per part and
mask, so that a part has at most 32 cells whatever its size. The recursive query then
extends prefixes of filter orders by the letters not used yet: a row carries its prefix and
the bits applied so far, meets the cells of its part, and each level of the recursion gives
the metrics of that step. The orders are read off the prefixes of full length.
"""

from __future__ import annotations

from contextlib import contextmanager
from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwright.llm.common import SPACE, stored

LETTERS = "ABCDE"
SHORT_WORDS = 50  # A: fewer words than this
DISTINCT_PERCENT = 65  # B: fewer distinct words in a hundred than this
CAPITAL_PERCENT = 5  # C: more capitals in a hundred characters than this
ODD = r"[#$%&*|]"  # D: any of these
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
_CELLS = "array<struct<mask:int,n:bigint,good:bigint,toxic:bigint>>"


def with_failures(docs: DataFrame) -> DataFrame:
    """`docs` (which has `part` and a `text` without nulls) with `mask`: bits of the filters A to D that the text fails."""
    # Steps of their own, so that each text is cut into words once. Only the first and the last piece may be empty.
    cut = docs.withColumn("words", F.split("text", SPACE))
    first, last = F.get("words", F.lit(0)) == "", F.get("words", F.size("words") - 1) == ""
    counted = cut.withColumns({
        "n_words": F.size("words") - first.cast("int") - (last & (F.size("words") > 1)).cast("int"),
        "n_distinct": F.size(F.array_distinct("words")) - (first | last).cast("int"),
        "capitals": F.regexp_count("text", F.lit("[A-Z]")), "odd": F.col("text").rlike(ODD),
    })
    bit = lambda failed, letter: F.when(failed, _BIT[letter]).otherwise(0)
    return counted.withColumn("mask", (
        bit(F.col("n_words") < SHORT_WORDS, "A") + bit(100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), "B")
        + bit(100 * F.col("capitals") > CAPITAL_PERCENT * F.length("text"), "C") + bit(F.col("odd"), "D")
    ).cast("int"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and its cells: documents, good and toxic ones for each mask of failed filters.

    Texts are met by their SHA-256, so no text is shuffled. Rows alike in id, text and part
    are counted first, then rows alike in text, part and labels: copies, however many, are
    few rows before they meet. Of equal texts all but those of the smallest doc_id fail E.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_failures(texts).select("doc_id", "part", "mask", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = own.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"),
    )
    labelled = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        *rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")
    )
    # Rows without an id meet no label, and need not meet in one task for it.
    met = labelled.unionAll(rows.where("doc_id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("bad")))
    # Per text, part and labels: rows, the smallest id and the rows that have it.
    alike = met.groupBy("digest", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "part", "n"))).alias("first"),
    )
    # Of one text there are no more rows than parts, four times, by now, however many copies it has.
    firsts = alike.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    stays = F.coalesce(F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")), F.lit(0)) + F.col("no_id")
    cases = firsts.select("part", "good", "bad", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), stays.alias("n")),
        F.struct((F.col("mask") + _BIT["E"]).alias("mask"), (F.col("n") - stays).alias("n")),
    ))).where("n > 0")
    cells = cases.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic")
    )
    # At most 32 cells a part.
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).cast(_CELLS).alias("cells"))


def _total(value: str, condition: str) -> str:
    """SQL: the sum of `value` over the part's cells that meet `condition`."""
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (acc, x) -> acc + x.{value})"


def steps_sql() -> str:
    """The recursive query over {cells}: one row per part and prefix of an order."""
    before, bit = "e.applied", "e.bit"
    removed = f"x.mask & {before} = 0 AND x.mask & {bit} <> 0"
    letters = ", ".join(f"named_struct('letter', '{letter}', 'bit', {b})" for letter, b in _BIT.items())
    return f"""WITH RECURSIVE steps AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS bit, 0 AS step, {", ".join(f"0L AS {m}" for m in MEASURES)} FROM {{cells}}
  UNION ALL
  SELECT e.part, concat(e.prefix, e.letter), e.applied | e.bit, e.bit, e.step + 1,
    {_total("n", f"x.mask & ({before} | {bit}) = 0")}, {_total("n", removed)}, {_total("n", f"x.mask & {before} <> 0 AND x.mask & {bit} <> 0")},
    {_total("n", f"x.mask = {bit}")}, {_total("good", removed)}, {_total("toxic", removed)}
  FROM (SELECT s.part, s.prefix, s.applied, s.step, t.letter, t.bit FROM steps s
        LATERAL VIEW inline(filter(array({letters}), l -> s.applied & l.bit = 0)) t AS letter, bit WHERE s.step < {len(LETTERS)}) e
  JOIN {{cells}} c ON c.part = e.part
)
SELECT * FROM steps WHERE step > 0"""


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """A recursion may give any number of rows meanwhile: 325 a part; the caller's setting comes back after."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def prefix_steps(cells: DataFrame) -> DataFrame:
    """Per part and non-empty prefix of an order: the metrics of its last step, by recursion."""
    spark = cells.sparkSession
    cells = stored(cells, "audit-cells")  # every level of the recursion reads them again
    with _any_number_of_rows(spark):
        return stored(spark.sql(steps_sql(), cells=cells), "audit-steps")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the step's counts, for all orders of the five filters in each part.

    A part is a value of source; null is the empty string, so both are one part. Null text
    counts as empty. Rows that repeat a doc_id are documents of their own; equal texts of
    one doc_id do not fail E by each other. Null doc_id: neither fails E nor makes others
    fail it, and has no label. A document has a label's property if any of its label rows
    has. Further columns are not read. An empty table gives an empty result.
    """
    steps = prefix_steps(mask_cells(docs, labels))
    last = F.substring("prefix", -1, 1)
    # An order's step is that of its prefix: a prefix of k letters begins (5 - k)! orders.
    weight = F.element_at(F.array(*[F.lit(factorial(len(LETTERS) - k)).cast("bigint") for k in range(1, len(LETTERS) + 1)]), F.col("step"))
    shapley = steps.groupBy("part", last.alias("letter")).agg(F.sum(F.col("removed") * weight).alias("shapley"))
    places = steps.where(F.col("step") == len(LETTERS)).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
    )
    placed = places.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    return placed.join(steps.drop("step", "applied", "bit"), ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *MEASURES, "shapley"
    )


def oracle() -> str:
    """SQL of `audit`."""
    return r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order, 0 AS applied, 0 AS step UNION ALL
  SELECT filter_order || letter, applied | bit, step + 1 FROM o, f WHERE applied & bit = 0),
p AS (SELECT filter_order, s AS step, letter, bit, (SELECT coalesce(sum(g.bit), 0)::INTEGER FROM f g WHERE instr(filter_order, g.letter) < s) AS before
  FROM o, range(1, 6) r(s), f WHERE o.step = 5 AND letter = filter_order[s]),
x AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, p GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM x"""
