"""Outliers, the anomaly listing and its figures, and acknowledgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.anomalies import (
    acknowledge, anomaly_aggregates, anomaly_counts, append_outliers, by_newest,
    check_requests, detect_anomalies, failed_requests, list_anomalies, parse_anomaly_id, tab_conditions,
)
from ledgerwright.operators.rollup import with_tabs
from ledgerwright.operators.vendors import point_in_time_stats, vendor_stats
from ledgerwright.plans import testmodel as tm
from registry.sqlmodel import BASE, EVENTS

QUERIES: dict = {}
SQL: dict = {}


def _whole_history(spark, d):
    rows = tm.event_rows(spark, d)
    return rows.join(vendor_stats(rows), "vendor_id")


QUERIES["outliers"] = lambda spark, d: detect_anomalies(_whole_history(spark, d)).select(
    "invoice_id", F.round("anomaly.vendor_mean", 4).alias("mean"), F.round("anomaly.vendor_std", 4).alias("std"),
    F.round("anomaly.z_score", 1).alias("z"),
)
ZED = EVENTS + """, s AS (SELECT vendor_id, count(*) AS n, avg(CAST(total AS DOUBLE)) AS avg, stddev_samp(CAST(total AS DOUBLE)) AS std FROM ev GROUP BY 1),
o AS (SELECT ev.*, avg, std, abs(CAST(total AS DOUBLE) - avg) / std AS z FROM ev JOIN s USING (vendor_id)
  WHERE n >= 3 AND std > 0 AND abs(CAST(total AS DOUBLE) - avg) / std >= 3)"""
SQL["outliers"] = f"""WITH {ZED} SELECT invoice_id, round(avg, 4) AS mean, round(std, 4) AS std, round(round(z, 2), 1) AS z FROM o"""


def _acked(spark, d):
    """Every seventh event above 30 counts as acknowledged for its user."""
    return tm.event_rows(spark, d).where((F.col("k") % 7 == 0) & (F.col("total") > 30)).select(
        "vendor_id", F.col("total").cast("double").alias("value")
    )


QUERIES["outliers_acked"] = lambda spark, d: detect_anomalies(
    _whole_history(spark, d), _acked(spark, d)
).select("invoice_id")
SQL["outliers_acked"] = f"""WITH {ZED}, a AS (SELECT vendor_id, CAST(total AS DOUBLE) AS value FROM ev WHERE k % 7 = 0 AND total > 30)
SELECT invoice_id FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.vendor_id = o.vendor_id AND abs(CAST(o.total AS DOUBLE) - value) / value < 0.10)"""

QUERIES["outliers_point_in_time"] = lambda spark, d: detect_anomalies(
    point_in_time_stats(tm.event_rows(spark, d), F.lit(True))
).select("invoice_id", F.round("anomaly.z_score", 1).alias("z"))
SQL["outliers_point_in_time"] = f"""WITH {EVENTS}, p AS (SELECT invoice_id, CAST(total AS DOUBLE) AS x, count(*) OVER w AS n,
    avg(CAST(total AS DOUBLE)) OVER w AS avg, stddev_samp(CAST(total AS DOUBLE)) OVER w AS std FROM ev
  WINDOW w AS (PARTITION BY vendor_id ORDER BY uploaded_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT invoice_id, round(round(abs(x - avg) / std, 2), 1) AS z FROM p WHERE n >= 3 AND std > 0 AND abs(x - avg) / std >= 3"""


def _acks(spark, d):
    rows = tm.order_rows(spark, d, amounts=False)
    return rows.where(F.col("k") % 3 == 0).select(
        "invoice_id", F.lit("amount").alias("subtype"), F.lit("total").alias("field"),
        F.col("ts").alias("acknowledged_at"), (F.col("k") % 5).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("notes"),
    )


def _users(spark, d):
    n = tm.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("user_id"), F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"))


def _listing(spark, d):
    return list_anomalies(tm.base(spark, d), _acks(spark, d), _users(spark, d))


LIST = BASE + """, l AS (SELECT *, CAST(coalesce(total_amount, 0) AS DOUBLE) AS value, coalesce(nullif(currency, ''), 'USD') AS cur,
    CAST(k % 1000 * 100 AS DOUBLE) AS mean, (k % 60) / 10.0::DOUBLE AS z, k % 3 = 0 AS acked FROM base WHERE has_anomaly AND vendor_id IS NOT NULL),
h AS (SELECT a.invoice_id, b.total_amount, row_number() OVER (PARTITION BY a.invoice_id ORDER BY b.ts DESC, b.invoice_id) AS r
  FROM l a JOIN base b ON b.vendor_id = a.vendor_id AND b.invoice_id <> a.invoice_id AND b.review_status = 'confirmed'),
hc AS (SELECT invoice_id, count(total_amount) AS priors, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS prior_sum FROM h WHERE r <= 11 GROUP BY 1)"""

QUERIES["anomaly_listing"] = lambda spark, d: by_newest(_listing(spark, d)).select(
    "id", "status", "vendor", "headline", "severity", "currency", "value", "z_score", "acknowledged_by",
    F.size("history").alias("points"), F.regexp_extract("sub", r"(\d+ prior invoices?)", 1).alias("priors"),
    F.round(F.aggregate("history", F.lit(0.0), lambda a, h: a + h["value"]), 2).alias("history_sum"),
    F.element_at("history", -1)["current"].alias("last_is_current"),
)
SQL["anomaly_listing"] = f"""WITH {LIST} SELECT l.invoice_id || ':amount:total' AS id, CASE WHEN acked THEN 'acknowledged' ELSE 'unreviewed' END AS status,
  vendor_table_name AS vendor, CASE WHEN cur = 'USD' THEN '$' ELSE cur || ' ' END || format('{{:,.2f}}', value) || ' invoice' AS headline,
  CASE WHEN z >= 4 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'low' END AS severity, cur AS currency, value, z AS z_score,
  CASE WHEN acked THEN 'nation_' || (k % 5) || '@example.com' END AS acknowledged_by, CAST(coalesce(priors, 0) + 1 AS INTEGER) AS points,
  coalesce(priors, 0) || ' prior invoice' || CASE WHEN priors = 1 THEN '' ELSE 's' END AS priors,
  round(coalesce(prior_sum, 0) + value, 2) AS history_sum, true AS last_is_current
FROM l LEFT JOIN hc USING (invoice_id)"""

QUERIES["anomaly_counts"] = lambda spark, d: anomaly_counts(_listing(spark, d))
SQL["anomaly_counts"] = f"""WITH {LIST} SELECT count(*) AS "all", count(*) FILTER (NOT acked) AS unreviewed, count(*) FILTER (NOT acked) AS amount,
  count(*) FILTER (acked) AS acknowledged, 0::BIGINT AS frequency, 0::BIGINT AS pattern FROM l"""

QUERIES["anomaly_aggregates"] = lambda spark, d: anomaly_aggregates(_listing(spark, d))
SQL["anomaly_aggregates"] = f"""WITH {LIST}, u AS (SELECT * FROM l WHERE NOT acked),
c AS (SELECT cur, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS s FROM u GROUP BY 1 ORDER BY s DESC, cur LIMIT 1),
t AS (SELECT z, vendor_table_name FROM u ORDER BY z DESC, ts DESC, invoice_id DESC LIMIT 1)
SELECT (SELECT s FROM c) AS total_flagged_amount, (SELECT cur FROM c) AS total_flagged_currency,
  (SELECT count(DISTINCT vendor_table_name) FROM u) AS vendors_affected, (SELECT z FROM t) AS highest_severity_z,
  (SELECT vendor_table_name FROM t) AS highest_severity_vendor"""


def _tabs(spark, d):
    return with_tabs(_listing(spark, d), tab_conditions()).groupBy("tab").agg(F.count("*").alias("n"))


QUERIES["anomaly_tabs"] = _tabs
SQL["anomaly_tabs"] = f"""WITH {LIST} SELECT 'all' AS tab, count(*) AS n FROM l UNION ALL SELECT 'unreviewed', count(*) FROM l WHERE NOT acked
UNION ALL SELECT 'acknowledged', count(*) FROM l WHERE acked UNION ALL SELECT 'amount', count(*) FROM l WHERE NOT acked"""


def _request_rows(spark, d):
    """Requests for every order, twice; some ids are malformed."""
    rows = tm.order_rows(spark, d, amounts=False)
    k = F.col("k")
    text = F.when(k % 41 == 0, F.col("invoice_id")).when(k % 43 == 0, F.concat(F.lit("x"), "invoice_id", F.lit(":amount:total"))).when(
        k % 47 == 0, F.concat("invoice_id", F.lit(":pattern:total"))
    ).otherwise(F.concat("invoice_id", F.lit(":amount:total")))
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("again")
    return rows.select(text.alias("id"), "k", "ts", again).select(
        "id", F.timestamp_seconds(F.unix_seconds("ts") + F.col("again") * 60).alias("requested_at"),
        (k % 5 + F.col("again")).cast("string").alias("user_id"), F.lit(None).cast("string").alias("notes"),
    )


QUERIES["parse_anomaly_ids"] = lambda spark, d: _request_rows(spark, d).select(
    "id", parse_anomaly_id(F.col("id")).alias("p")
).select("id", "p.subtype", "p.field", "p.error")
REQ = """q AS (SELECT k, ts, has_anomaly AND vendor_id IS NOT NULL AS live, invoice_id, vendor_id, total_amount,
    CASE WHEN k % 41 = 0 THEN invoice_id WHEN k % 43 = 0 THEN 'x' || invoice_id || ':amount:total'
      WHEN k % 47 = 0 THEN invoice_id || ':pattern:total' ELSE invoice_id || ':amount:total' END AS id,
    CASE WHEN k % 41 = 0 THEN 'malformed anomaly id: ''' || invoice_id || '''' WHEN k % 43 = 0 THEN 'invalid invoice id in anomaly id: ''x' || invoice_id || ':amount:total'''
      WHEN k % 47 = 0 THEN 'unsupported anomaly subtype: ''pattern''' END AS bad FROM base)"""
SQL["parse_anomaly_ids"] = f"""WITH {BASE}, {REQ} SELECT id, CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 'amount' WHEN k % 47 = 0 THEN 'pattern' ELSE 'amount' END AS subtype,
  CASE WHEN k % 41 = 0 THEN NULL ELSE 'total' END AS field, bad AS error FROM q, (SELECT unnest([0, 1]))"""


def _checked(spark, d):
    return check_requests(_request_rows(spark, d), _listing(spark, d))


QUERIES["acknowledge_failures"] = lambda spark, d: failed_requests(_checked(spark, d))
SQL["acknowledge_failures"] = f"""WITH {BASE}, {REQ} SELECT id, coalesce(bad, 'not_found') AS error FROM q, (SELECT unnest([0, 1])) WHERE bad IS NOT NULL OR NOT live"""

QUERIES["acknowledge"] = lambda spark, d: acknowledge(_acks(spark, d), _checked(spark, d)).select(
    "invoice_id", "user_id", F.date_format("acknowledged_at", "yyyy-MM-dd HH:mm").alias("first_at")
)
SQL["acknowledge"] = f"""WITH {BASE}, {REQ} SELECT invoice_id, CAST(k % 5 AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d %H:%M') AS first_at
FROM q WHERE k % 3 = 0 OR (bad IS NULL AND live)"""


def _outlier_list(spark, d):
    none = spark.createDataFrame([], "vendor_id string, field string, value double, acked_at timestamp, invoice_id string")
    return append_outliers(none, _checked(spark, d)).select("vendor_id", "value", "invoice_id")


QUERIES["append_outliers"] = _outlier_list
SQL["append_outliers"] = f"""WITH {BASE}, {REQ}, v AS (SELECT vendor_id, CAST(coalesce(total_amount, 0) AS DOUBLE) AS value, invoice_id, ts FROM q WHERE bad IS NULL AND live)
SELECT vendor_id, value, first(invoice_id ORDER BY ts, invoice_id) AS invoice_id FROM v GROUP BY 1, 2"""
