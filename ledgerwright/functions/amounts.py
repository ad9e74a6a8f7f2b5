"""Amounts in exact decimals: casts, reconciliation, agreement and sum checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.sqltext import apply, let
from ledgerwright.functions.text import strip

#: 29 digits before the point and nine behind it.
MONEY = "decimal(38,9)"


def amount(text: Column) -> Column:
    """Text as an exact amount; text that is no number, NaN or infinity becomes null."""
    return text.try_cast(MONEY)


def finite(value: Column) -> Column:
    """A number or its text as a double; null for text that is no number, NaN or infinity."""
    x = value.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _lit(text: str) -> Column:
    return F.lit(text).cast(MONEY)


def math_reconciles(subtotal: Column, tax: Column, total: Column) -> Column:
    """subtotal + tax = total within 0.02. True if a part is missing, false if one is negative."""
    parts = (subtotal, tax, total)
    missing = subtotal.isNull() | tax.isNull() | total.isNull()
    return (
        F.when(missing, True)
        .when(F.least(*parts) < 0, False)
        .otherwise(F.abs(subtotal + tax - total) <= _lit(fixed.AMOUNT_TOLERANCE))
    )


def agreement(left: Column, right: Column, field: str) -> Column:
    """1.0 where two readings of a field agree, else 0.3."""
    if field in fixed.AMOUNT_FIELDS:
        same = F.abs(amount(left) - amount(right)) <= _lit(fixed.AGREEMENT_TOLERANCE)
    else:
        same = strip(left) == strip(right)
    return F.when(left.isNull() & right.isNull(), 1.0).when(same, 1.0).otherwise(0.3)


def values_match(left: Column, right: Column, field: str) -> Column:
    """Side-by-side equality of two values: amounts within 0.01, other text trimmed."""
    if field in fixed.AMOUNT_FIELDS:
        same = F.abs(amount(left) - amount(right)) <= _lit(fixed.AGREEMENT_TOLERANCE)
    else:
        same = strip(left) == strip(right)
    return F.when(left.isNull() & right.isNull(), True).otherwise(F.coalesce(same, F.lit(False)))


def sum_check(rows: Column, member: str, header: Column) -> Column:
    """Struct (matches, delta) of an array's member sum against the header amount.

    An empty array or a missing header passes with delta 0; a member that is no number
    fails with delta 0.
    """
    cast = lambda r: F.coalesce(F.nullif(r[member].cast("string"), F.lit("")), F.lit("0"))
    numbers = F.transform(rows, lambda r: amount(cast(r)))
    bad = F.exists(numbers, lambda x: x.isNull())
    total = F.aggregate(
        numbers, F.lit(0).cast(MONEY), lambda acc, x: (acc + x).cast(MONEY)
    )
    delta = (total - header).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    vacuous = rows.isNull() | (F.size(rows) == 0) | header.isNull()
    return F.struct(
        F.when(vacuous, True).when(bad, False)
        .otherwise(F.abs(delta) <= _lit(fixed.AMOUNT_TOLERANCE)).alias("matches"),
        F.when(vacuous | bad, zero).otherwise(delta).alias("delta"),
    )


def line_items_check(items: Column, subtotal: Column) -> Column:
    return sum_check(items, "line_total", subtotal)


def tax_rows_check(rows: Column, tax: Column) -> Column:
    return sum_check(rows, "amount", tax)


def member_sum(rows: Column, member: str) -> Column:
    """Displayed total of an array member, a missing member counting as nothing."""
    values = F.transform(rows, lambda r: F.coalesce(r[member], F.lit(0.0)))
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def round_exact(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    Spark rounds the printed form of a double: 2.15, which is a little less than it looks,
    would go up. Here the fraction is taken as a whole number of 2^-60 and compared as a
    whole number. A value too large to have that many binary digits behind the point, NaN
    and infinity pass as they are.
    """
    scale, unit = 10**digits, 1 << 60
    fraction = f"CAST(CAST((abs(x) - floor(abs(x))) * {unit}D AS BIGINT) AS DECIMAL(20,0))"
    body = let(
        "p",
        f"named_struct('w', floor(abs(x)) * {scale}L, 'n', {fraction} * {scale})",
        f"""CAST(p.w + p.n div {unit} + if(p.n % {unit} > {unit // 2}
            OR (p.n % {unit} = {unit // 2} AND (p.w + p.n div {unit}) % 2 = 1), 1L, 0L) AS DOUBLE)
            / {scale}D * if(x < 0, -1D, 1D)""",
    )
    x = x.cast("double")
    return F.when(F.abs(x) < 9e14, apply(body, F.when(F.abs(x) < 9e14, x))).otherwise(x)
