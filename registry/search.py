"""Structured queries: filters, sorts, pages, aggregates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.rollup import inbox_tab, inbox_tabs
from ledgerwright.operators.scan import base_relation, current_extractions, newest_invoices, page
from ledgerwright.plans import testmodel as tm
from ledgerwright.plans.query import StructuredQuery, filtered, run_aggregate, run_query, with_shares
from ledgerwright.session import new_path
from ledgerwright.sources.export import export_rows, read_extractions, write_extractions
from ledgerwright.sources.postings import search_postings, write_postings
from registry.sqlmodel import BASE, ORD, RAW

QUERIES: dict = {}
SQL: dict = {}


def _query(filters=(), **rest) -> StructuredQuery:
    return StructuredQuery.from_dict(
        {"filters": [{"field": f, "op": o, "value": v} for f, o, v in filters], **rest}
    )


def _filter(key: str, filters: list, where: str, texts: bool = False) -> None:
    """A filter over all rows, and the WHERE clause it stands for."""
    query = _query(filters)
    QUERIES[key] = lambda spark, d: filtered(tm.base(spark, d, texts), query).select(
        "invoice_id", "vendor_table_name", F.col("total_amount").cast("double").alias("total"), "state"
    )
    cte, rel = (RAW, "raw") if texts else (BASE, "base")
    SQL[key] = (
        f"WITH {cte} SELECT invoice_id, vendor_table_name, CAST(total_amount AS DOUBLE) AS total, state "
        f"FROM {rel} WHERE {where}"
    )


V = "Customer#000000013"
EITHER = "lower(coalesce(vendor_table_name,'')) {0} OR lower(coalesce(vendor_name,'')) {0}"

_filter("filter_none", [], "true")
_filter("filter_total_gt", [("total", "gt", 150000)], "total_amount > 150000")
_filter("filter_total_between", [("total", "between", [1000, 100000])], "total_amount BETWEEN 1000 AND 100000")
_filter("filter_total_neq_lte", [("total", "neq", 5000), ("subtotal", "lte", 90000)],
        "total_amount <> 5000 AND subtotal_amount <= 90000")
_filter("filter_tax_gte_lt", [("tax_total", "gte", 1000), ("tax_total", "lt", 4000.5)],
        "tax_amount >= 1000 AND tax_amount < 4000.5")
_filter("filter_vendor_eq_ci", [("vendor_name", "eq", V.upper())], EITHER.format(f"= '{V.lower()}'"))
_filter("filter_vendor_neq", [("vendor_name", "neq", V)],
        f"lower(coalesce(vendor_table_name,'')) <> '{V.lower()}' AND lower(coalesce(vendor_name,'')) <> '{V.lower()}'")
_filter("filter_vendor_contains", [("vendor_name", "contains", "#0000001_7")],
        "vendor_table_name ILIKE '%#0000001_7%' OR vendor_name ILIKE '%#0000001_7%'")
_filter("filter_vendor_in", [("vendor_name", "in", [V, "CUSTOMER#000000002", "Customer #000000007"])],
        EITHER.format("IN ('customer#000000013','customer#000000002','customer #000000007')"))
_filter("filter_date_gte", [("invoice_date", "gte", "1999-01-01")], "period_start >= DATE '1999-01-01'")
_filter("filter_date_between", [("invoice_date", "between", ["1996-02-01", "1996-12-31"])],
        "period_start BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'")
_filter("filter_date_eq_neq", [("invoice_date", "neq", "1997-05-01"), ("invoice_date", "lt", "1997-06-01")],
        "period_start <> DATE '1997-05-01' AND period_start < DATE '1997-06-01'")
_filter("filter_currency_eq", [("currency", "eq", "USD")], "currency = 'USD'")
_filter("filter_currency_neq", [("currency", "neq", "USD")], "currency <> 'USD'")
_filter("filter_currency_in", [("currency", "in", ["EUR", "usd"])], "currency IN ('EUR','usd')")
_filter("filter_state_in", [("triage_state", "in", ["needs_review", "confident"])],
        "state IN ('needs_review','confident')")
_filter("filter_state_neq", [("triage_state", "neq", "confident")], "state <> 'confident'")
_filter("filter_status_eq", [("review_status", "eq", "confirmed")], "review_status = 'confirmed'")
_filter("filter_status_in", [("review_status", "in", ["confirmed", "unprocessable"])],
        "review_status IN ('confirmed','unprocessable')")
_filter("filter_has_anomaly", [("has_anomaly", "eq", True)], "has_anomaly")
_filter("filter_no_anomaly", [("has_anomaly", "eq", False)], "NOT has_anomaly")
_filter("filter_is_duplicate", [("is_duplicate", "eq", True)], "state = 'likely_duplicate'")
_filter("filter_not_duplicate", [("is_duplicate", "eq", False)], "state <> 'likely_duplicate'")
_filter("filter_raw_contains", [("raw_text", "contains", "BLUE ring")], "raw_text ILIKE '%BLUE ring%'", True)
_filter("filter_conjunction",
        [("vendor_name", "contains", "customer"), ("total", "gt", 50000), ("currency", "in", ["USD", "EUR"]),
         ("invoice_date", "lt", "2000-01-01"), ("is_duplicate", "eq", False)],
        "(vendor_table_name ILIKE '%customer%' OR vendor_name ILIKE '%customer%') AND total_amount > 50000 "
        "AND currency IN ('USD','EUR') AND period_start < DATE '2000-01-01' AND state <> 'likely_duplicate'")
# All words have regular stems, so the lexeme match is a match on word families.
_filter("filter_fts_all_terms", [("raw_text", "fts_matches", "the blue rings")],
        r"regexp_matches(lower(raw_text), '\bblue\b') AND regexp_matches(lower(raw_text), '\brings?\b')", True)


def _stored(key: str, filters: list, twin: str) -> None:
    """A filter over extractions that were written and read back, as a deployment keeps them."""
    query = _query(filters)

    def run(spark, d):
        path = new_path(spark, "extractions")
        write_extractions(tm.extractions(spark, d, True), path)
        base = base_relation(tm.invoices(spark, d), read_extractions(spark, path), tm.vendors(spark, d))
        return filtered(base, query).select(
            "invoice_id", "vendor_table_name", F.col("total_amount").cast("double").alias("total"), "state"
        )

    QUERIES[key] = run
    SQL[key] = SQL[twin]


_stored("stored_total_between", [("total", "between", [1000, 100000])], "filter_total_between")
_stored("stored_fts_all_terms", [("raw_text", "fts_matches", "the blue rings")], "filter_fts_all_terms")


def _posted(spark, d):
    """The same search over postings that were written and read back."""
    path = new_path(spark, "postings")
    # The texts are those of the current extractions; which of them have an invoice the search's join tells.
    texts = current_extractions(tm.extractions(spark, d, True))
    write_postings(texts.select("invoice_id", "raw_text"), path, "invoice_id", "raw_text")
    hits = search_postings(spark, path, "the blue rings", "invoice_id")
    return tm.base(spark, d).join(hits, "invoice_id", "left_semi").select(
        "invoice_id", "vendor_table_name", F.col("total_amount").cast("double").alias("total"), "state"
    )


QUERIES["posted_fts_all_terms"] = _posted
SQL["posted_fts_all_terms"] = SQL["filter_fts_all_terms"]


def _sorted(key: str, query: StructuredQuery, order: str, limit: int) -> None:
    QUERIES[key] = lambda spark, d: run_query(tm.base(spark, d), query).select(
        "invoice_id", "vendor_table_name", F.col("total_amount").cast("double").alias("total")
    )
    SQL[key] = (
        f"WITH {BASE} SELECT invoice_id, vendor_table_name, CAST(total_amount AS DOUBLE) AS total FROM base "
        f"ORDER BY {order}, invoice_id LIMIT {limit}"
    )


_sorted("sort_total_desc_nulls_last", _query(sort=["total", "desc"], limit=500), "total_amount DESC NULLS LAST", 500)
_sorted("sort_date_asc", _query(sort=["invoice_date", "asc"], limit=200), "period_start ASC NULLS LAST", 200)
_sorted("sort_vendor_asc", _query(sort=["vendor_name", "asc"], limit=300), "vendor_table_name ASC NULLS LAST", 300)
_sorted("sort_default_newest", _query(), "ts DESC", 50)


def _aggregate(key: str, agg: dict, value: str, group: str | None, filters=(), where="true", limit=500) -> None:
    query = _query(filters, aggregate=agg, limit=limit)
    QUERIES[key] = lambda spark, d: run_aggregate(tm.base(spark, d), query).withColumn(
        "value", F.round("value", 4)
    ).withColumn("group", F.coalesce("group", F.lit("")))
    if group is None:
        SQL[key] = (
            f"WITH {BASE} SELECT '' AS \"group\", round(coalesce(CAST({value} AS DOUBLE), 0), 4) AS value "
            f"FROM base WHERE {where}"
        )
    else:
        SQL[key] = (
            f"WITH {BASE}, g AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v FROM base WHERE {where} GROUP BY 1) "
            f"SELECT coalesce(g, '(unknown)') AS \"group\", round(coalesce(v, 0), 4) AS value FROM g "
            f"ORDER BY v DESC NULLS LAST, g NULLS LAST LIMIT {limit}"
        )


_aggregate("agg_count", {"op": "count"}, "count(*)", None)
_aggregate("agg_sum_total", {"op": "sum", "field": "total"}, "sum(total_amount)", None,
           [("currency", "eq", "USD")], "currency = 'USD'")
_aggregate("agg_sum_empty", {"op": "sum", "field": "tax_total"}, "sum(tax_amount)", None,
           [("currency", "eq", "none")], "currency = 'none'")
_aggregate("agg_avg_subtotal", {"op": "avg", "field": "subtotal"}, "avg(CAST(subtotal_amount AS DOUBLE))", None)
_aggregate("agg_by_vendor_top", {"op": "sum", "field": "total", "group_by": "vendor_name"}, "sum(total_amount)",
           "vendor_table_name", [("total", "gt", 100000)], "total_amount > 100000", 10)
_aggregate("agg_by_state", {"op": "count", "group_by": "triage_state"}, "count(*)", "state")
_aggregate("agg_by_status", {"op": "sum", "field": "subtotal", "group_by": "review_status"},
           "coalesce(sum(subtotal_amount), 0)", "review_status")
_aggregate("agg_by_currency", {"op": "avg", "field": "total", "group_by": "currency"},
           "avg(CAST(total_amount AS DOUBLE))", "currency")


def _share(spark, d):
    query = _query(aggregate={"op": "sum", "field": "total", "group_by": "currency"})
    return with_shares(run_aggregate(tm.base(spark, d), query)).select(
        "group", *[F.round(c, 4).alias(c) for c in ("value", "total", "percent_of_max")]
    )


QUERIES["agg_share"] = _share
SQL["agg_share"] = f"""WITH {BASE}, g AS (
  SELECT coalesce(currency, '(unknown)') AS "group", CAST(sum(total_amount) AS DOUBLE) AS value FROM base GROUP BY 1)
SELECT "group", round(value, 4) AS value, round(sum(value) OVER (), 4) AS total,
  round(value / max(value) OVER () * 100, 4) AS percent_of_max FROM g"""

QUERIES["page_of_inbox"] = lambda spark, d: page(
    inbox_tab(tm.base(spark, d), "needs_review"), [F.desc("uploaded_at"), F.asc("invoice_id")], 2, 25
).select("invoice_id")
SQL["page_of_inbox"] = f"""WITH {BASE} SELECT invoice_id FROM base WHERE state = 'needs_review' AND review_status = 'pending'
ORDER BY ts DESC, invoice_id LIMIT 25 OFFSET 25"""

QUERIES["page_clamped"] = lambda spark, d: page(
    inbox_tab(tm.base(spark, d), "likely_duplicate"), [F.desc("uploaded_at"), F.asc("invoice_id")], 10**6, 25
).select("invoice_id")
SQL["page_clamped"] = f"""WITH {BASE}, f AS (
  SELECT invoice_id, row_number() OVER (ORDER BY ts DESC, invoice_id) AS rn, count(*) OVER () AS n
  FROM base WHERE state = 'likely_duplicate' AND review_status = 'pending')
SELECT invoice_id FROM f WHERE rn > (ceil(n / 25.0) - 1) * 25"""

QUERIES["newest_invoices"] = lambda spark, d: newest_invoices(tm.invoices(spark, d), 200).select(
    "invoice_id", "file_hash", "storage_key"
)
SQL["newest_invoices"] = f"""WITH {ORD} SELECT invoice_id, sha256(invoice_id) AS file_hash, sha256(invoice_id) || '.pdf' AS storage_key
FROM ord ORDER BY ts DESC, invoice_id LIMIT 200"""


QUERIES["inbox_tabs"] = lambda spark, d: inbox_tabs(tm.base(spark, d)).select("tab", "invoice_id")
SQL["inbox_tabs"] = f"""WITH {BASE}
SELECT 'all' AS tab, invoice_id FROM base
UNION ALL SELECT review_status, invoice_id FROM base WHERE review_status IN ('confirmed','unprocessable')
UNION ALL SELECT state, invoice_id FROM base WHERE review_status = 'pending'"""

QUERIES["export_flat"] = lambda spark, d: export_rows(tm.base(spark, d))
SQL["export_flat"] = f"""WITH {BASE} SELECT invoice_id, vendor_name, invoice_number, invoice_date, subtotal, tax, total, currency,
  state AS triage_state, review_status, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS uploaded_at,
  '[' || concat_ws(',',
    CASE WHEN k % 10 = 0 THEN '{{"type":"duplicate_of","invoice_id":"' || printf('00000000-0000-0000-0000-%012x', greatest(k - 1, 0)) || '","similarity":1.0,"match_method":"perceptual_hash"}}' END,
    CASE WHEN has_anomaly THEN '{{"type":"anomaly","field":"total","vendor_mean":' || printf('%.1f', k % 1000 * 100.0) || ',"vendor_std":100.0,"z_score":' || printf('%.1f', (k % 60) / 10.0) || '}}' END) || ']' AS reasons
FROM base"""
