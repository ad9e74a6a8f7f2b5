"""Cost of model calls: records, totals, shares by tier, depth and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions.amounts import round_exact
from ledgerwright.functions.scoring import model_tier, usage_cost
from ledgerwright.operators.ordered import running_totals, time_buckets
from ledgerwright.schema import USAGE

TOKENS = tuple(f.name for f in USAGE.fields)


def price_calls(calls: DataFrame) -> DataFrame:
    """Usage rows with cost_usd; missing token counts are stored as 0."""
    zeroed = calls.withColumns({t: F.coalesce(F.col(t), F.lit(0)).cast("bigint") for t in TOKENS})
    return zeroed.withColumn("cost_usd", usage_cost(F.col("model"), {t: F.col(t) for t in TOKENS}))


def _cost() -> Column:
    # Ten decimals hold a single cached token of the cheapest tier exactly.
    return F.col("cost_usd").cast("decimal(28,10)")


def usage_summary(log: DataFrame, limit_usd: float) -> DataFrame:
    """Spend against a limit, figures rounded to 4 places."""
    spent = F.coalesce(F.sum(_cost()), F.lit(0)).cast("double")
    totals = log.agg(spent.alias("spent"), F.count("*").alias("call_count"))
    limit = F.lit(float(limit_usd))
    share = F.lit(0.0) if limit_usd <= 0 else F.least(F.lit(1.0), F.col("spent") / limit)
    return totals.select(
        round_exact(F.col("spent"), 4).alias("spent_usd"),
        limit.alias("limit_usd"),
        round_exact(F.greatest(F.lit(0.0), limit - F.col("spent")), 4).alias("remaining_usd"),
        round_exact(share, 4).alias("percent_used"),
        "call_count",
        (F.col("spent") >= limit).alias("exhausted"),
    )


def usage_by_model(tiers: DataFrame) -> DataFrame:
    """Calls, tokens, cost and share of cost by tier; `tiers` is one row per call.

    `model` is the tier of the model called; a model of no known tier stays by itself.
    """
    per_model = price_calls(tiers).groupBy(model_tier(F.col("model")).alias("model")).agg(
        F.count("*").alias("calls"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum(_cost()).alias("__cost"),
    )
    whole = per_model.agg(F.sum("__cost").alias("__all"))
    # The right side is one row.
    return per_model.crossJoin(whole).select(
        "model", "calls", *TOKENS, F.col("__cost").cast("double").alias("cost_usd"),
        F.coalesce(
            F.try_divide(F.col("__cost").cast("double"), F.col("__all").cast("double")), F.lit(0.0)
        ).alias("share"),
    )


def tiers_of(extractions: DataFrame) -> DataFrame:
    """One row per recorded tier of the extractions."""
    return extractions.select("invoice_id", F.explode("tiers").alias("t")).select(
        "invoice_id", "t.model", *[F.col(f"t.usage.{t}").alias(t) for t in TOKENS]
    )


def tier_depth(extractions: DataFrame) -> DataFrame:
    return extractions.agg(
        F.avg(F.size("tiers")).alias("avg_depth"), F.max(F.size("tiers")).alias("max_depth")
    )


def budget_cutoff(log: DataFrame, limit_usd: float, id_col: str = "id") -> DataFrame:
    """Calls with the spend recorded before each and whether the limit was reached by then.

    The running sum is global, so it is carried over days, then minutes, then rows.
    """
    summed = running_totals(
        log, [], time_buckets("created_at", "day", "minute"), ["created_at", id_col],
        {"__before": _cost()},
    )
    spent = F.col("__before").cast("double")
    return (
        summed.withColumn("spent_before", spent)
        .withColumn("refused", F.col("spent_before") >= F.lit(float(limit_usd)))
        .drop("__before")
    )
