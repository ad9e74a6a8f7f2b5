"""Reviewer actions applied to the invoice table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.operators.fields import promote

CONFIRM, UNPROCESSABLE, DISMISS = "confirm", "mark_unprocessable", "dismiss_duplicate"


def unknown_invoices(actions: DataFrame, invoices: DataFrame) -> DataFrame:
    """Actions that name no invoice."""
    return actions.join(invoices.select("invoice_id"), "invoice_id", "left_anti").withColumn(
        "error", F.concat(F.lit("invoice "), F.col("invoice_id"), F.lit(" not found"))
    )


def apply_actions(invoices: DataFrame, actions: DataFrame) -> DataFrame:
    """Invoices after the actions (action_id, acted_at, invoice_id, action, against_id).

    The last status action wins. A dismissed pair is added to the list once, in the order
    of the first dismissal.
    """
    status = F.when(F.col("action") == CONFIRM, fixed.CONFIRMED).when(
        F.col("action") == UNPROCESSABLE, fixed.UNPROCESSABLE
    )
    last = actions.withColumn("__s", status).where(F.col("__s").isNotNull()).groupBy(
        "invoice_id"
    ).agg(F.max_by("__s", F.struct("acted_at", "action_id")).alias("__s"))
    pairs = actions.where(
        (F.col("action") == DISMISS) & F.col("against_id").isNotNull()
    ).groupBy("invoice_id", "against_id").agg(F.min(F.struct("acted_at", "action_id")).alias("at"))
    # The list is a column of the invoice; pairs are distinct before they are gathered.
    lists = pairs.groupBy("invoice_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "against_id"))), lambda p: p["against_id"]
        ).alias("__d")
    )
    none = F.array().cast("array<string>")
    return (
        invoices.join(last, "invoice_id", "left").join(lists, "invoice_id", "left")
        .withColumn("review_status", F.coalesce("__s", "review_status"))
        .withColumn(
            "duplicate_dismissals",
            F.array_union(F.coalesce("duplicate_dismissals", none), F.coalesce("__d", none)),
        )
        .select(*invoices.columns)
    )


def confirm_events(actions: DataFrame, base: DataFrame) -> DataFrame:
    """(vendor_id, invoice_id, confirmed_at, total) for the vendor statistics.

    An invoice counts once, at its first confirmation, however often it is confirmed.
    """
    first = actions.where(F.col("action") == CONFIRM).groupBy("invoice_id").agg(
        F.min("acted_at").alias("confirmed_at")
    )
    totals = promote(base, "total_amount").where(F.col("vendor_id").isNotNull()).select(
        "vendor_id", "invoice_id", F.col("total_amount").cast("double").alias("total")
    )
    return totals.join(first, "invoice_id")
