"""Inbox, navigation and vendor roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.functions.scoring import min_confidence
from ledgerwright.operators.fields import display_state, field_values, overlay_corrections, located_fields
from ledgerwright.operators.rollup import (
    inbox_counts, nav_counts, sort_vendors, vendor_count, vendor_invoices, vendor_rollup, vendor_totals,
)
from ledgerwright.plans import testmodel as tm
from registry.sqlmodel import BASE, ORD

QUERIES: dict = {}
SQL: dict = {}

QUERIES["inbox_counts"] = lambda spark, d: inbox_counts(tm.base(spark, d))
SQL["inbox_counts"] = f"""WITH {ORD} SELECT count(*) AS "all", count(*) FILTER (state = 'needs_review' AND review_status = 'pending') AS needs_review,
  count(*) FILTER (state = 'confident' AND review_status = 'pending') AS confident,
  count(*) FILTER (state = 'likely_duplicate' AND review_status = 'pending') AS likely_duplicate,
  count(*) FILTER (review_status = 'unprocessable') AS unprocessable, count(*) FILTER (review_status = 'confirmed') AS confirmed FROM ord"""

QUERIES["nav_counts"] = lambda spark, d: nav_counts(tm.base(spark, d))
SQL["nav_counts"] = f"""WITH {ORD} SELECT count(*) FILTER (review_status <> 'unprocessable' AND state = 'needs_review') AS needs_review,
  count(*) FILTER (state = 'confident' AND review_status = 'pending') AS confident,
  count(*) FILTER (review_status <> 'unprocessable' AND state = 'likely_duplicate') AS likely_duplicate,
  count(*) FILTER (review_status = 'unprocessable') AS unprocessable FROM ord"""

QUERIES["vendor_count"] = lambda spark, d: vendor_count(tm.base(spark, d))
SQL["vendor_count"] = f"WITH {ORD} SELECT count(DISTINCT nullif(trim(vendor_name), '')) AS vendors FROM ord"

ROLL = BASE + """, g AS (SELECT trim(vendor_name) AS name, k, invoice_id, coalesce(invoice_date, '') AS date_text,
    CASE WHEN total_amount > 0 THEN total_amount END AS spent,
    least((k % 10) / 10.0::DOUBLE, (k % 7) / 7.0::DOUBLE, (k % 13) / 13.0::DOUBLE) AS low,
    review_status = 'pending' AND state IN ('needs_review', 'likely_duplicate') AS flag
  FROM base WHERE nullif(trim(vendor_name), '') IS NOT NULL),
o AS (SELECT *, count(spent) OVER (PARTITION BY name) AS n,
    count(spent) OVER (PARTITION BY name ORDER BY date_text COLLATE "C", invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
r AS (SELECT name, count(*) AS invoices, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS total_spent, nullif(max(date_text COLLATE "C"), '') AS last_seen,
    count(*) FILTER (flag) AS anomalies, avg(low) AS confidence, any_value(n) AS n,
    avg(CAST(spent AS DOUBLE)) FILTER (before < greatest(1, n // 2)) AS older,
    avg(CAST(spent AS DOUBLE)) FILTER (before >= greatest(1, n // 2)) AS recent FROM o GROUP BY name),
roll AS (SELECT *, coalesce(total_spent / nullif(n, 0), 0) AS avg_invoice, CASE WHEN n <= 1 THEN 'new' WHEN (recent - older) / older > 0.15 THEN 'rising'
    WHEN (recent - older) / older < -0.15 THEN 'declining' ELSE 'stable' END AS trend FROM r)"""
ROLL = ROLL.replace(' COLLATE "C"', "")

QUERIES["vendor_rollup"] = lambda spark, d: vendor_rollup(tm.base(spark, d)).select(
    "name", "invoices", F.round("total_spent", 2).alias("total_spent"), "last_seen", "anomalies",
    F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), F.round(F.col("avg_invoice") + 1e-7, 2).alias("avg_invoice"), "trend",
)
SQL["vendor_rollup"] = f"""WITH {ROLL} SELECT name, invoices, round(total_spent, 2) AS total_spent, last_seen, anomalies,
  round(confidence + 1e-9, 6) AS confidence, round(avg_invoice + 1e-7, 2) AS avg_invoice, trend FROM roll"""

QUERIES["vendor_top_sorted"] = lambda spark, d: sort_vendors(vendor_rollup(tm.base(spark, d)), "last_seen").select(
    "name", "last_seen"
).limit(50)
SQL["vendor_top_sorted"] = f"WITH {ROLL} SELECT name, last_seen FROM roll ORDER BY last_seen DESC NULLS LAST, name LIMIT 50"

QUERIES["vendor_totals"] = lambda spark, d: vendor_totals(vendor_rollup(tm.base(spark, d))).select(
    F.round("spent", 2).alias("spent"), "invoices", "anomalies", F.round(F.col("avg_confidence") + 1e-9, 6).alias("avg_confidence")
)
SQL["vendor_totals"] = f"""WITH {ROLL} SELECT round(CAST(sum(CAST(total_spent AS DECIMAL(18,4))) AS DOUBLE), 2) AS spent, CAST(sum(invoices) AS BIGINT) AS invoices,
  CAST(sum(anomalies) AS BIGINT) AS anomalies, round(avg(confidence) + 1e-9, 6) AS avg_confidence FROM roll"""

QUERIES["vendor_drill_down"] = lambda spark, d: vendor_invoices(tm.base(spark, d), "Customer#000000004").select(
    "invoice_id", field_values()["invoice_date"].alias("invoice_date")
)
SQL["vendor_drill_down"] = f"WITH {BASE} SELECT invoice_id, invoice_date FROM base WHERE trim(vendor_name) = 'Customer#000000004'"

QUERIES["display_state_and_confidence"] = lambda spark, d: tm.base(spark, d).select(
    "invoice_id", display_state(F.col("review_status"), F.when(F.col("state") != "confident", F.col("state"))).alias("shown"),
    F.round(min_confidence(F.col("confidence")), 6).alias("low"),
)
SQL["display_state_and_confidence"] = f"""WITH {ORD} SELECT invoice_id, CASE WHEN review_status = 'unprocessable' THEN review_status
  WHEN state <> 'confident' THEN state ELSE 'needs_review' END AS shown,
  round(least((k % 10) / 10.0::DOUBLE, (k % 7) / 7.0::DOUBLE, (k % 13) / 13.0::DOUBLE), 6) AS low FROM ord"""


def _overlay(spark, d):
    """Two corrections of the same field for every fourth invoice; one of a field not extracted."""
    rows = tm.order_rows(spark, d, amounts=False).where(F.col("k") % 4 == 0)
    fix = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(s).alias("s"))
        for f, v, s in (("total", "1.00", 1), ("total", "2.00", 2), ("due_date", "2024-01-01", 1))
    ])).alias("x")
    corrections = rows.select("invoice_id", "ts", fix).select(
        "invoice_id", "x.field", "x.value", F.timestamp_seconds(F.unix_seconds("ts") + F.col("x.s")).alias("corrected_at")
    )
    done = overlay_corrections(tm.extractions(spark, d).where("is_current"), corrections)
    return done.select(
        "invoice_id", F.col("fields")["total"]["value"].alias("total"), F.col("fields")["total"]["source"].alias("source"),
        F.round(F.col("fields")["total"]["confidence"], 4).alias("confidence"),
        F.coalesce(F.try_element_at("fields", F.lit("due_date"))["value"], F.lit("")).alias("due"), F.size("fields").alias("n"),
    )


QUERIES["corrections_overlay"] = _overlay
SQL["corrections_overlay"] = f"""WITH {BASE} SELECT invoice_id, CASE WHEN k % 4 = 0 THEN '2.00' ELSE total END AS total,
  CASE WHEN k % 4 = 0 THEN 'manual-correction' ELSE 'pymupdf+haiku' END AS source,
  CASE WHEN k % 4 = 0 THEN 1.0 ELSE round((k % 10) / 10.0::DOUBLE, 4) END AS confidence,
  CASE WHEN k % 4 = 0 THEN '2024-01-01' ELSE '' END AS due, CASE WHEN k % 4 = 0 THEN 8 ELSE 7 END AS n FROM base"""


def _located(spark, d):
    boxed = F.transform_values(
        "fields", lambda n, f: F.when((n == "total") & (F.col("k") % 2 == 0), f.withField("bbox", F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]))).otherwise(f)
    )
    return located_fields(tm.extractions(spark, d).where("is_current").withColumn("fields", boxed)).select(
        "invoice_id", "field", F.element_at("bbox", 4).alias("y1")
    )


QUERIES["located_fields"] = _located
SQL["located_fields"] = f"WITH {ORD} SELECT invoice_id, 'total' AS field, 0.4::DOUBLE AS y1 FROM ord WHERE k % 2 = 0"
