"""Severity bands and the sentences shown for an anomaly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright.functions.amounts import round_exact


def severity(z: Column) -> Column:
    return F.when(z >= 4.0, "high").when(z >= 2.5, "medium").otherwise("low")


def ratio_text(ratio: Column) -> Column:
    return F.concat(
        F.when(ratio >= 10, F.format_number(round_exact(ratio, 0), 0)).otherwise(
            F.format_number(round_exact(ratio, 1), 1)
        ),
        F.lit("×"),
    )


def _symbol(currency: Column) -> Column:
    return F.when(currency == "USD", "$").otherwise(F.concat(currency, F.lit(" ")))


def headline(value: Column, currency: Column) -> Column:
    return F.concat(_symbol(currency), F.format_number(round_exact(value, 2), 2), F.lit(" invoice"))


def explanation(value: Column, mean: Column, currency: Column, priors: Column) -> Column:
    """Why the amount stands out, against the mean of the vendor's prior invoices. The wording is fixed."""
    count = F.concat(
        priors.cast("string"), F.lit(" prior invoice"), F.when(priors == 1, "").otherwise("s")
    )
    average = F.concat(_symbol(currency), F.format_number(round_exact(mean, 0), 0))
    return (
        F.when(
            mean <= 0,
            F.concat(
                F.lit("No prior history for this vendor — first material extraction ("),
                count, F.lit(")"),
            ),
        )
        .when(
            value >= mean,
            F.concat(
                ratio_text(F.try_divide(value, mean)), F.lit(" this vendor's average ("),
                average, F.lit(" across "), count, F.lit(")"),
            ),
        )
        .when(
            value <= 0,
            F.concat(
                F.lit("Zero or missing total against this vendor's "), average,
                F.lit(" average ("), count, F.lit(")"),
            ),
        )
        .otherwise(
            F.concat(
                ratio_text(F.try_divide(mean, value)),
                F.lit(" smaller than this vendor's average ("),
                average, F.lit(" across "), count, F.lit(")"),
            )
        )
    )
