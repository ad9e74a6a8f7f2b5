"""Usage cost over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.usage import budget_cutoff, price_calls, tier_depth, tiers_of, usage_by_model, usage_summary
from ledgerwright.plans import testmodel as tm

QUERIES: dict = {}
SQL: dict = {}

COST = """u AS (SELECT event_id AS k, printf('00000000-0000-0000-0000-%012x', event_id) AS id, ts,
    CASE WHEN event_type = 'view' THEN 'local-stub' ELSE ['Haiku-4', 'sonnet-4', 'opus-4'][event_id % 3 + 1] END AS model,
    CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS o,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 500 END AS w, event_id % 300 AS r FROM events),
c AS (SELECT *, CASE WHEN model LIKE 'Haiku%' THEN 1.0 WHEN model LIKE 'sonnet%' THEN 3.0 WHEN model LIKE 'opus%' THEN 15.0 ELSE 0.0 END AS p FROM u),
cost AS (SELECT *, CAST(p * (i + 5 * o + 1.25 * w + 0.1 * r) / 1000000 AS DECIMAL(28,10)) AS cost FROM c)"""

QUERIES["price_calls"] = lambda spark, d: price_calls(tm.usage_rows(spark, d)).select(
    "id", "cache_creation_input_tokens", F.round("cost_usd", 8).alias("cost_usd")
)
SQL["price_calls"] = f"WITH {COST} SELECT id, w AS cache_creation_input_tokens, round(CAST(cost AS DOUBLE), 8) AS cost_usd FROM cost"

QUERIES["usage_summary"] = lambda spark, d: usage_summary(price_calls(tm.usage_rows(spark, d)), 5.0)
SQL["usage_summary"] = f"""WITH {COST}, s AS (SELECT CAST(sum(cost) AS DOUBLE) AS s, count(*) AS n FROM cost)
SELECT round(s, 4) AS spent_usd, 5.0::DOUBLE AS limit_usd, round(greatest(0.0, 5 - s), 4) AS remaining_usd,
  round(least(1.0, s / 5), 4) AS percent_used, n AS call_count, s >= 5 AS exhausted FROM s"""

QUERIES["usage_by_model"] = lambda spark, d: usage_by_model(tm.usage_rows(spark, d)).select(
    "model", "calls", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
    F.round("cost_usd", 6).alias("cost_usd"), F.round("share", 6).alias("share"),
)
SQL["usage_by_model"] = f"""WITH {COST} SELECT CASE WHEN model LIKE 'Haiku%' THEN 'haiku' WHEN model LIKE '%-4' THEN split_part(model, '-', 1) ELSE model END AS model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  CAST(sum(w) AS BIGINT) AS cache_creation_input_tokens, CAST(sum(r) AS BIGINT) AS cache_read_input_tokens,
  round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd, round(CAST(sum(cost) AS DOUBLE) / CAST(sum(sum(cost)) OVER () AS DOUBLE), 6) AS share FROM cost GROUP BY 1"""

QUERIES["budget_cutoff"] = lambda spark, d: budget_cutoff(price_calls(tm.usage_rows(spark, d)), 0.5).select(
    "id", F.round(F.col("spent_before") + 1e-9, 6).alias("spent_before"), "refused"
)
SQL["budget_cutoff"] = f"""WITH {COST}, b AS (SELECT id, CAST(coalesce(sum(cost) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS s FROM cost)
SELECT id, round(s + 1e-9, 6) AS spent_before, s >= 0.5 AS refused FROM b"""


def _traces(spark, d):
    """Conversations as extractions, each turn one recorded tier."""
    c = tm.table(spark, d, "conversations")
    size = F.length("text").cast("bigint")
    usage = F.struct(
        size.alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_input_tokens"), F.lit(None).cast("bigint").alias("cache_read_input_tokens"),
    )
    return c.groupBy(F.col("conv_id").alias("invoice_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("sonnet-"), "role").alias("model"), usage.alias("usage")))),
        lambda t: F.struct(t["model"], t["usage"]),
    ).alias("tiers"))


QUERIES["tier_depth"] = lambda spark, d: tier_depth(_traces(spark, d)).select(F.round("avg_depth", 6).alias("avg_depth"), "max_depth")
SQL["tier_depth"] = """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT round(avg(n), 6) AS avg_depth, CAST(max(n) AS INTEGER) AS max_depth FROM n"""

QUERIES["tier_tokens"] = lambda spark, d: usage_by_model(tiers_of(_traces(spark, d))).select("model", "calls", "input_tokens", "output_tokens")
SQL["tier_tokens"] = """SELECT 'sonnet' AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens,
  CAST(sum(turn + 1) AS BIGINT) AS output_tokens FROM conversations GROUP BY 1"""
