"""Structured query: checked on the driver, then turned into DataFrame operations."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.amounts import MONEY
from ledgerwright.functions.stemming import lexemes, matches_all, text_matches
from ledgerwright.operators.fields import promote

_COMPARE = ("eq", "neq", "gt", "gte", "lt", "lte", "between")
# Operators allowed per field.
ALLOWED = {
    "vendor_name": ("eq", "neq", "in", "contains"),
    "invoice_date": _COMPARE,
    "total": _COMPARE,
    "subtotal": _COMPARE,
    "tax_total": _COMPARE,
    "currency": ("eq", "neq", "in"),
    "triage_state": ("eq", "neq", "in"),
    "review_status": ("eq", "neq", "in"),
    "has_anomaly": ("eq",),
    "is_duplicate": ("eq",),
    "raw_text": ("contains", "fts_matches"),
}
SORTABLE = ("vendor_name", "invoice_date", "total", "subtotal", "tax_total")
GROUPABLE = ("vendor_name", "triage_state", "review_status", "currency")
AGGREGATED = ("total", "subtotal", "tax_total")
AGGREGATES = ("count", "sum", "avg")
MAX_LIMIT, DEFAULT_LIMIT = 500, 50

_AMOUNTS = {"total": "total_amount", "subtotal": "subtotal_amount", "tax_total": "tax_amount"}
_PLAIN = {"currency": "currency", "triage_state": "state", "review_status": "review_status"}


class QueryError(ValueError):
    """The query is outside the whitelist."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise QueryError(message)


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        _require(self.field in ALLOWED, f"unknown field {self.field!r}")
        allowed = ALLOWED[self.field]
        _require(
            self.op in allowed,
            f"op {self.op!r} is not allowed on field {self.field!r}; allowed: {sorted(allowed)}",
        )
        listed = isinstance(self.value, (list, tuple))
        if self.op == "between":
            _require(listed and len(self.value) == 2, "between takes two values")
        elif self.op != "in":
            _require(not listed, f"op {self.op!r} takes one value")


@dataclass(frozen=True)
class Aggregate:
    op: str
    field: str | None = None
    group_by: str | None = None

    def __post_init__(self) -> None:
        _require(self.op in AGGREGATES, f"unknown aggregate {self.op!r}")
        if self.op == "count":
            _require(self.field is None, "count does not take a field")
        else:
            _require(self.field in AGGREGATED, f"op {self.op!r} requires a numeric field")
        _require(self.group_by is None or self.group_by in GROUPABLE, "cannot group by that field")


@dataclass(frozen=True)
class StructuredQuery:
    """Filters joined by AND, an optional sort, a row limit, and an optional aggregate."""

    filters: tuple[Clause, ...] = ()
    sort: tuple[str, str] | None = None
    limit: int = DEFAULT_LIMIT
    untranslated_intent: str | None = None
    aggregate: Aggregate | None = None

    def __post_init__(self) -> None:
        _require(1 <= self.limit <= MAX_LIMIT, f"limit must lie in 1..{MAX_LIMIT}")
        if self.sort is not None:
            _require(self.sort[0] in SORTABLE, f"cannot sort by {self.sort[0]!r}")
            _require(self.sort[1] in ("asc", "desc"), "sort direction is asc or desc")

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> "StructuredQuery":
        """Checked query from plain data; an unknown key is refused."""
        known = {"filters", "sort", "limit", "untranslated_intent", "aggregate"}
        _require(set(raw) <= known, f"unknown keys: {sorted(set(raw) - known)}")
        try:
            filters = tuple(Clause(**c) for c in raw.get("filters") or ())
            agg = raw.get("aggregate")
            aggregate = Aggregate(**agg) if agg else None
        except TypeError as exc:
            raise QueryError(str(exc)) from exc
        sort = raw.get("sort")
        return StructuredQuery(
            filters=filters, sort=tuple(sort) if sort else None,
            limit=raw.get("limit", DEFAULT_LIMIT),
            untranslated_intent=raw.get("untranslated_intent"), aggregate=aggregate,
        )


def _date(value: Any) -> Column:
    try:
        day = value if isinstance(value, dt.date) else dt.datetime.fromisoformat(value)
    except (TypeError, ValueError) as exc:
        raise QueryError(f"not a date: {value!r}") from exc
    return F.lit(f"{day:%Y-%m-%d}").cast("date")


def _compare(col: Column, op: str, value: Any, make=F.lit) -> Column:
    if op == "between":
        return col.between(make(value[0]), make(value[1]))
    operator = {
        "eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__",
    }[op]
    return getattr(col, operator)(make(value))


def _number(value: Any) -> decimal.Decimal:
    try:
        number = decimal.Decimal(str(value))
    except decimal.InvalidOperation as exc:
        raise QueryError(f"not a number: {value!r}") from exc
    _require(number.is_finite(), f"not a number: {value!r}")
    return number


def _amount_clause(col: Column, op: str, value: Any) -> Column:
    """A comparison with a literal of any length.

    Stored amounts have nine digits behind the point; a literal with more lies between two
    of them, and one beyond the largest lies above all.
    """
    if op == "between":
        return _amount_clause(col, "gte", value[0]) & _amount_clause(col, "lte", value[1])
    number = _number(value)
    with decimal.localcontext() as context:
        context.prec, context.rounding = 400, decimal.ROUND_FLOOR
        most = decimal.Decimal("1E29") - decimal.Decimal("1E-9")
        low = min(max(number, -most), most).quantize(decimal.Decimal("1E-9"))
    literal = F.lit(f"{low:f}").cast(MONEY)
    if low == number:
        return _compare(col, op, number, lambda _: literal)
    above = low < number  # else the literal lies below every amount
    return {
        "eq": col.isNull() & F.lit(False), "neq": col.isNotNull(),
        "lt": col <= literal if above else F.lit(False), "lte": col <= literal if above else F.lit(False),
        "gt": col > literal if above else col.isNotNull(), "gte": col > literal if above else col.isNotNull(),
    }[op]


def _listed(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _vendor(op: str, value: Any) -> Column:
    """A vendor matches by its table name or by the name extracted from the document."""
    names = (F.col("vendor_table_name"), F.col("vendor_text"))
    if op == "contains":
        # % and _ in the value act as wildcards.
        return reduce(Column.__or__, [n.ilike(f"%{value}%") for n in names])
    wanted = [str(v).lower() for v in _listed(value)]
    if op == "neq":
        return reduce(
            Column.__and__, [F.coalesce(F.lower(n), F.lit("")) != wanted[0] for n in names]
        )
    return reduce(Column.__or__, [F.lower(n).isin(wanted) for n in names])


def clause_column(clause: Clause) -> Column:
    """Filter condition over the promoted base relation."""
    name, op, value = clause.field, clause.op, clause.value
    if name == "vendor_name":
        return _vendor(op, value)
    if name in _AMOUNTS:
        return _amount_clause(F.col(_AMOUNTS[name]), op, value)
    if name == "invoice_date":
        return _compare(F.col("period_start"), op, value, _date)
    if name == "has_anomaly":
        found = F.exists("reasons", lambda r: r["type"] == "anomaly")
        return found if value else ~found
    if name == "is_duplicate":
        same = F.col("state") == fixed.LIKELY_DUPLICATE
        return same if value else ~same
    if name == "raw_text":
        if op == "contains":
            return F.col("raw_text").ilike(f"%{value}%")
        return matches_all(F.col("lexemes"), str(value))
    col = F.col(_PLAIN[name])
    return col.isin(_listed(value)) if op == "in" else _compare(col, op, value)


def filtered(base: DataFrame, query: StructuredQuery) -> DataFrame:
    """Rows of the base relation that meet every clause; no clause keeps all rows.

    Stored typed columns (total_amount, period_start, ..., lexemes) are used where the
    table has them, so that filters reach the file reader; otherwise they are derived. Without
    stored lexemes a search looks at the texts, and lexemes are made of the rows it leaves.
    """
    rows = promote(base)
    searched = [c for c in query.filters if c.op == "fts_matches" and "lexemes" not in rows.columns]
    conditions = [text_matches(F.col("raw_text"), str(c.value)) if c in searched else clause_column(c) for c in query.filters]
    rows = rows.where(reduce(Column.__and__, conditions, F.lit(True)))
    return rows.withColumn("lexemes", lexemes(F.col("raw_text"))) if searched else rows


def _sort_column(name: str) -> Column:
    plain = {"vendor_name": "vendor_table_name", "invoice_date": "period_start"}
    return F.col(plain.get(name) or _AMOUNTS[name])


def run_query(base: DataFrame, query: StructuredQuery) -> DataFrame:
    """Matching rows in order, nulls last, at most `limit` of them; the id breaks ties."""
    rows = filtered(base, query)
    if query.sort is None:
        order = F.col("uploaded_at").desc()
    else:
        col = _sort_column(query.sort[0])
        order = col.asc_nulls_last() if query.sort[1] == "asc" else col.desc_nulls_last()
    return rows.orderBy(order, F.col("invoice_id").asc()).limit(query.limit)


def search(base: DataFrame, query: StructuredQuery) -> DataFrame:
    """Row search; a query with an aggregate yields no rows here."""
    rows = run_query(base, query)
    return rows.limit(0) if query.aggregate else rows


def run_aggregate(base: DataFrame, query: StructuredQuery) -> DataFrame:
    """(group, value) of the matching rows, largest value first; one row with no grouping."""
    agg = query.aggregate
    if agg is None:
        raise QueryError("the query has no aggregate")
    rows = filtered(base, query)
    if agg.op == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        amount = F.col(_AMOUNTS[agg.field])
        value = (F.sum if agg.op == "sum" else F.avg)(amount).cast("double")
    if agg.group_by is None:
        return rows.agg(F.coalesce(value, F.lit(0.0)).alias("value")).select(
            F.lit(None).cast("string").alias("group"), "value"
        )
    key = {"vendor_name": "vendor_table_name"}.get(agg.group_by) or _PLAIN[agg.group_by]
    found = rows.groupBy(F.col(key).alias("group")).agg(value.alias("value"))
    if agg.op == "sum":
        found = found.withColumn("value", F.coalesce("value", F.lit(0.0)))
    top = found.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("group")).limit(query.limit)
    return top.select(
        F.coalesce("group", F.lit("(unknown)")).alias("group"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def with_shares(groups: DataFrame) -> DataFrame:
    """Aggregate rows with the total of all values and each row's percent of the largest.

    Groups are at most `limit` rows by now, so the one-row side is tiny.
    """
    whole = groups.agg(F.sum("value").alias("total"), F.greatest(F.max("value"), F.lit(0.0)).alias("__m"))
    return groups.crossJoin(whole).withColumn(
        "percent_of_max", F.coalesce(F.try_divide("value", "__m") * 100, F.lit(0.0))
    ).drop("__m")
