"""Soft comparison of an extracted value with annotated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.text import clean_amount, normalize_date_text


def _either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def numeric_close(a: Column, b: Column, fraction: float = 0.01) -> Column:
    """Within a share of the larger magnitude, taken as at least 1."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= fraction


def soft_match(field: Column, expected: Column, actual: Column) -> Column:
    """True where `actual` agrees with `expected` under the rule of its field."""
    want, got = F.trim(expected), F.trim(actual)
    numbers = [clean_amount(x).try_cast("double") for x in (want, got)]
    symbols = F.create_map(*[F.lit(x) for kv in fixed.CURRENCY_SYMBOLS.items() for x in kv])
    code = F.coalesce(F.element_at(symbols, want), F.upper(want))
    matched = (
        F.when(field.isin(*fixed.AMOUNT_FIELDS), numeric_close(*numbers))
        .when(field == "currency", F.upper(got) == code)
        .when(
            field == "invoice_date",
            _either_contains(normalize_date_text(got), normalize_date_text(want)),
        )
        .otherwise(_either_contains(F.lower(got), F.lower(want)))
    )
    return F.coalesce(matched, F.lit(False))
