"""Inbox, navigation and vendor roll-ups over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.amounts import MONEY
from ledgerwright.functions.scoring import min_confidence
from ledgerwright.functions.text import strip
from ledgerwright.operators.fields import field_value, promote
from ledgerwright.operators.ordered import running_totals
from ledgerwright.session import materialised

STATES = (fixed.NEEDS_REVIEW, fixed.CONFIDENT, fixed.LIKELY_DUPLICATE)


def _pending(state: str) -> Column:
    return (F.col("state") == state) & (F.col("review_status") == fixed.PENDING)


def _in_tab(tab: str) -> Column:
    if tab in (fixed.CONFIRMED, fixed.UNPROCESSABLE):
        return F.col("review_status") == tab
    return _pending(tab) if tab in STATES else F.lit(True)


def inbox_tab(base: DataFrame, tab: str) -> DataFrame:
    """Rows of one inbox tab; state tabs hold pending rows only, an unknown tab holds all."""
    return base.where(_in_tab(tab))


def with_tabs(rows: DataFrame, tabs: dict[str, Column]) -> DataFrame:
    """Each row once for every tab whose condition it meets, with the tab's name; one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tabs.items()]))
    return rows.withColumn("tab", F.explode(names))


def inbox_tabs(base: DataFrame) -> DataFrame:
    """All inbox tabs: base rows with `tab`."""
    return with_tabs(base, {t: _in_tab(t) for t in ("all", *STATES, fixed.CONFIRMED, fixed.UNPROCESSABLE)})


def inbox_counts(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count("*").alias("all"),
        *[F.count_if(_pending(s)).alias(s) for s in STATES],
        *[
            F.count_if(F.col("review_status") == s).alias(s)
            for s in (fixed.UNPROCESSABLE, fixed.CONFIRMED)
        ],
    )


def nav_counts(base: DataFrame) -> DataFrame:
    """Navigation counts: unprocessable rows count there only, and only confident needs pending."""
    out = F.col("review_status") == fixed.UNPROCESSABLE
    kept = F.coalesce(~out, F.lit(True))
    return base.agg(
        F.count_if(kept & (F.col("state") == fixed.NEEDS_REVIEW)).alias("needs_review"),
        F.count_if(_pending(fixed.CONFIDENT)).alias("confident"),
        F.count_if(kept & (F.col("state") == fixed.LIKELY_DUPLICATE)).alias("likely_duplicate"),
        F.count_if(out).alias("unprocessable"),
    )


def vendor_label() -> Column:
    """Trimmed extracted vendor name, null if nothing is left; reads a promoted relation."""
    return F.nullif(strip(F.col("vendor_text")), F.lit(""))


def vendor_count(base: DataFrame) -> DataFrame:
    return promote(base, "vendor_text").agg(F.countDistinct(vendor_label()).alias("vendors"))


def trend(older: Column, older_n: Column, recent: Column, recent_n: Column) -> Column:
    """new, rising, declining or stable from the sums of the older and the recent half."""
    before = F.try_divide(older.cast("double"), older_n)
    change = F.try_divide(F.try_divide(recent.cast("double"), recent_n) - before, before)
    return (
        F.when(older_n + recent_n <= 1, "new")
        .when(change > 0.15, "rising")
        .when(change < -0.15, "declining")
        .otherwise("stable")
    )


def vendor_rollup(base: DataFrame) -> DataFrame:
    """One row per trimmed extracted vendor name: spend, dates, open anomalies, trend.

    The base relation is read once, into narrow rows, and summed per vendor and date text. The older half of a vendor's
    positive totals, by date text, is found from the counts of these cells; only the cell that the half ends in is put
    in order, from counts per leading characters of the id, so a large vendor is never ordered in one task. Its invoices
    are a query of their own (`vendor_invoices`), not an array without bound.
    """
    open_state = F.col("state").isin(fixed.NEEDS_REVIEW, fixed.LIKELY_DUPLICATE)
    total = F.col("total_amount")
    rows = materialised(promote(base, "vendor_text", "total_amount").select(
        vendor_label().alias("name"), "invoice_id",
        F.coalesce(field_value("invoice_date"), F.lit("")).alias("date_text"),
        F.when(total > 0, total).alias("spent"),
        min_confidence(F.col("confidence")).alias("low"),
        F.coalesce((F.col("review_status") == fixed.PENDING) & open_state, F.lit(False)).alias("flag"),
    ).where(F.col("name").isNotNull()), "rows")
    cells = rows.groupBy("name", "date_text").agg(
        F.count("*").alias("invoices"), F.count_if("flag").alias("flags"),
        F.sum("low").alias("low"), F.count("low").alias("lows"),
        F.sum(F.col("spent").cast(MONEY)).alias("money"), F.count("spent").alias("n"),
    )
    vendor = Window.partitionBy("name")
    before = F.sum("n").over(vendor.orderBy("date_text").rowsBetween(Window.unboundedPreceding, -1))
    half = F.greatest(F.lit(1), F.floor(F.sum("n").over(vendor) / 2))
    # How many of the cell's positive totals lie in the older half.
    older = F.least(F.greatest(half - F.coalesce(before, F.lit(0)), F.lit(0)), F.col("n"))
    cells = materialised(cells.withColumn("older", older), "cells")
    money, whole = F.col("money"), lambda cond: F.when(cond, F.col("money"))
    plain = cells.select(
        "name", "date_text", "invoices", "flags", "low", "lows", "money", "n", F.col("older").alias("older_n"),
        whole(F.col("older") == F.col("n")).alias("older"), whole(F.col("older") == 0).alias("recent"),
    )
    cut = cells.where((F.col("older") > 0) & (F.col("older") < F.col("n"))).select("name", "date_text", "older")
    inside = running_totals(
        rows.where(F.col("spent").isNotNull()).join(cut, ["name", "date_text"]), ["name", "date_text"],
        [F.substring("invoice_id", 1, 4)], ["invoice_id"], {"before": F.lit(1).cast("bigint")},
    ).withColumn("money", F.col("spent").cast(MONEY))
    first = F.col("before") < F.col("older")
    parts = inside.groupBy("name").agg(F.sum(F.when(first, money)).alias("older"), F.sum(F.when(~first, money)).alias("recent"))
    n, older_n = F.col("__n"), F.col("__on")
    return (
        plain.unionByName(parts, allowMissingColumns=True)
        .groupBy("name")
        .agg(
            F.sum("invoices").alias("invoices"),
            F.coalesce(F.sum("money"), F.lit(0)).cast("double").alias("total_spent"),
            F.nullif(F.max("date_text"), F.lit("")).alias("last_seen"),
            F.sum("flags").alias("anomalies"),
            F.coalesce(F.try_divide(F.sum("low"), F.sum("lows")), F.lit(0.0)).alias("confidence"),
            F.sum("older").alias("__o"), F.sum("older_n").alias("__on"), F.sum("recent").alias("__r"), F.sum("n").alias("__n"),
        )
        .withColumns({
            "avg_invoice": F.coalesce(F.try_divide("total_spent", n), F.lit(0.0)),
            "trend": trend(F.col("__o"), older_n, F.col("__r"), n - older_n),
        })
        .drop("__o", "__on", "__r", "__n")
    )


def sort_vendors(rolled: DataFrame, by: str = "total_spent") -> DataFrame:
    """By name ascending, or by any other column descending; the name breaks ties."""
    if by == "name":
        return rolled.orderBy("name")
    return rolled.orderBy(F.desc_nulls_last(by), F.asc("name"))


def vendor_invoices(base: DataFrame, name: str) -> DataFrame:
    """Invoices of one vendor, newest date text first."""
    return promote(base, "vendor_text").where(vendor_label() == name).orderBy(
        F.coalesce(field_value("invoice_date"), F.lit("")).desc(), F.asc("invoice_id")
    )


def vendor_totals(rolled: DataFrame) -> DataFrame:
    """Corpus totals; the mean confidence gives each vendor the same weight."""
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return rolled.agg(
        zero(F.sum(F.col("total_spent").cast("decimal(28,4)")).cast("double"), "spent"),
        zero(F.sum("invoices"), "invoices"),
        zero(F.sum("anomalies"), "anomalies"),
        zero(F.avg("confidence"), "avg_confidence"),
    )
