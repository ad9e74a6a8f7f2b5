"""Ordered work per invoice and vendor: current rows, histories, running statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.functions.amounts import MONEY
from ledgerwright.operators.scan import (
    current_extractions, invoices_with_current, mark_newest_current, promote_current,
    vendor_of_invoice, vendor_view,
)
from ledgerwright.operators.anomalies import prior_values, vendor_history
from ledgerwright.operators.vendors import (
    fold_confirms, point_in_time_stats, resolve_vendors, vendor_stats,
)
from ledgerwright.plans import testmodel as tm
from ledgerwright.session import materialised, new_path
from ledgerwright.sources.store import ExtractionStore
from registry.sqlmodel import BASE, EVENTS, ORD, R4

QUERIES: dict = {}
SQL: dict = {}

VERSIONS = BASE + """, ver AS (
  SELECT base.*, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] ELSE [0] END) AS v FROM base),
ext AS (SELECT *, invoice_id || CASE WHEN v = 1 THEN '-old' ELSE '' END AS extraction_id,
  ts - v * INTERVAL 1 DAY AS created_at FROM ver)"""

QUERIES["current_extraction"] = lambda spark, d: mark_newest_current(
    tm.extractions(spark, d).select(
        "invoice_id", "extraction_id", "created_at", F.lit(False).alias("is_current"),
        F.col("fields")["total"]["value"].alias("total"),
    )
).select("extraction_id", "invoice_id", "is_current", "total")
SQL["current_extraction"] = f"""WITH {VERSIONS} SELECT extraction_id, invoice_id,
  row_number() OVER (PARTITION BY invoice_id ORDER BY created_at DESC, extraction_id DESC) = 1 AS is_current, total FROM ext"""


def _promoted(spark, d):
    ext = tm.extractions(spark, d).select("extraction_id", "invoice_id", "k", "is_current")
    chosen = ext.where(F.col("extraction_id").endswith("-old") & (F.col("k") % 2 == 0))
    return promote_current(ext, chosen).select("extraction_id", "is_current")


QUERIES["promote_extraction"] = _promoted
SQL["promote_extraction"] = f"""WITH {VERSIONS} SELECT extraction_id,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN v = 1 ELSE v = 0 END AS is_current FROM ext"""

def _kept(spark, d, promoted=False):
    """Older rows, then newer ones, which come twice, in a stored table; read back."""
    rows = materialised(tm.extractions(spark, d).select("extraction_id", "invoice_id", "created_at", "is_current", "k"), "extractions")
    older = F.col("extraction_id").endswith("-old")
    store = ExtractionStore(spark, new_path(spark, "extraction-store"), rows.schema, buckets=16)
    store.append(rows.where(older))
    store.append(rows.where(~older))
    store.append(rows.where(~older))
    if promoted:
        store.promote(rows.where(older & (F.col("k") % 2 == 0)).select("invoice_id", "extraction_id"))
    return store.read().select("extraction_id", "invoice_id", "is_current")


QUERIES["store_append"] = _kept
SQL["store_append"] = f"WITH {VERSIONS} SELECT extraction_id, invoice_id, v = 0 AS is_current FROM ext"
QUERIES["store_promote"] = lambda spark, d: _kept(spark, d, promoted=True)
SQL["store_promote"] = f"""WITH {VERSIONS} SELECT extraction_id, invoice_id,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN v = 1 ELSE v = 0 END AS is_current FROM ext"""

QUERIES["invoice_with_current"] = lambda spark, d: invoices_with_current(
    tm.invoices(spark, d), tm.extractions(spark, d).where(F.col("k") % 4 != 1)
).select(
    "invoice_id", "review_status", F.size("duplicate_dismissals").alias("dismissals"),
    F.col("current.state").alias("state"), F.col("current.extraction_id").alias("extraction_id"),
)
SQL["invoice_with_current"] = f"""WITH {ORD} SELECT invoice_id, review_status, 0 AS dismissals,
  CASE WHEN k % 4 <> 1 THEN state END AS state, CASE WHEN k % 4 <> 1 THEN invoice_id END AS extraction_id FROM ord"""


def _vendor_rows(spark, d):
    """Vendors with statistics of their confirmed totals as they are stored."""
    rows = tm.order_rows(spark, d).where((F.col("review_status") == "confirmed") & F.col("vendor_id").isNotNull())
    stats = vendor_stats(rows.withColumn("total", F.col("total").try_cast(MONEY)))
    nested = stats.select("vendor_id", F.struct("n", "avg", "std").alias("stats"))
    return tm.vendors(spark, d).join(nested, "vendor_id", "left").withColumn("first_seen_at", F.lit(None).cast("timestamp"))


def _rounded(*names, digits=2):
    """Rounded columns; the nudge, also in the SQL, keeps exact halves from hanging on the last bit."""
    return [F.round(F.coalesce(n, F.lit(0.0)) + 1e-7, digits).alias(n) for n in names]


QUERIES["vendor_stats"] = lambda spark, d: vendor_view(_vendor_rows(spark, d)).select(
    "vendor_id", "name", "normalized_name", F.col("total_seen").cast("bigint").alias("total_seen"), *_rounded("avg_total", "std_total")
)
VSTATS = """vs AS (SELECT vendor_id, count(total_amount) AS n, avg(CAST(total_amount AS DOUBLE)) AS avg,
    coalesce(stddev_samp(CAST(total_amount AS DOUBLE)), 0) AS std FROM base
  WHERE review_status = 'confirmed' AND vendor_id IS NOT NULL AND total_amount IS NOT NULL GROUP BY 1)"""
SQL["vendor_stats"] = rf"""WITH {BASE}, {VSTATS} SELECT CAST(c_custkey AS VARCHAR) AS vendor_id, c_name AS name,
  regexp_replace(lower(c_name), '[^\w\s]+', '', 'g') AS normalized_name, coalesce(n, 0) AS total_seen,
  round(coalesce(avg, 0) + 1e-7, 2) AS avg_total, round(coalesce(std, 0) + 1e-7, 2) AS std_total
FROM customer LEFT JOIN vs ON vendor_id = CAST(c_custkey AS VARCHAR)"""

QUERIES["vendor_of_invoice"] = lambda spark, d: vendor_of_invoice(
    tm.invoices(spark, d), _vendor_rows(spark, d)
).select("invoice_id", "vendor_id", "name", F.coalesce(F.col("total_seen").cast("bigint"), F.lit(-1).cast("bigint")).alias("total_seen"))
SQL["vendor_of_invoice"] = f"""WITH {BASE}, {VSTATS} SELECT invoice_id, vendor_id, vendor_table_name AS name,
  CASE WHEN vendor_id IS NULL THEN -1 ELSE coalesce(n, 0) END AS total_seen FROM base LEFT JOIN vs USING (vendor_id)"""


def _point_in_time(spark, d):
    rows = tm.order_rows(spark, d).where(F.col("vendor_id").isNotNull()).select(
        "invoice_id", "vendor_id", "ts", "review_status", F.col("total").try_cast(MONEY).alias("total")
    )
    out = point_in_time_stats(rows, F.col("review_status") == "confirmed", ts="ts", units=("year", "day"))
    return out.select("invoice_id", "n", *_rounded("avg", "std"))


QUERIES["point_in_time_stats"] = _point_in_time
SQL["point_in_time_stats"] = f"""WITH {BASE}, c AS (SELECT *, CASE WHEN review_status = 'confirmed' THEN CAST(total_amount AS DOUBLE) END AS x
  FROM base WHERE vendor_id IS NOT NULL)
SELECT invoice_id, count(x) OVER w AS n, round(coalesce(avg(x) OVER w, 0) + 1e-7, 2) AS avg, round(coalesce(stddev_samp(x) OVER w, 0) + 1e-7, 2) AS std
FROM c WINDOW w AS (PARTITION BY vendor_id ORDER BY ts, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _event_stats(spark, d):
    out = point_in_time_stats(tm.event_rows(spark, d), F.col("event_type") != "error")
    return out.select("invoice_id", "n", *_rounded("avg", "std", digits=4))


QUERIES["point_in_time_event_stats"] = _event_stats
SQL["point_in_time_event_stats"] = f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(total AS DOUBLE) END AS x FROM ev)
SELECT invoice_id, count(x) OVER w AS n, round(coalesce(avg(x) OVER w, 0) + 1e-7, 4) AS avg, round(coalesce(stddev_samp(x) OVER w, 0) + 1e-7, 4) AS std
FROM c WINDOW w AS (PARTITION BY vendor_id ORDER BY uploaded_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _fold(spark, d):
    """Confirmed totals folded in two increments, the second on top of the first."""
    rows = tm.order_rows(spark, d).where(F.col("review_status") == "confirmed").select(
        "invoice_id", "vendor_id", "ts", F.col("total").try_cast("double").alias("total")
    )
    early = F.col("ts") < F.lit("1998-01-01").cast("timestamp")
    first = fold_confirms(None, rows.where(early), ts="ts")
    return fold_confirms(first, rows.where(~early), ts="ts").select("vendor_id", "n", "avg", "std")


QUERIES["vendor_stats_fold"] = _fold
SQL["vendor_stats_fold"] = f"""WITH RECURSIVE {BASE}, c AS (
  SELECT vendor_id, CAST(total_amount AS DOUBLE) AS x, row_number() OVER (PARTITION BY vendor_id ORDER BY ts, invoice_id) AS i
  FROM base WHERE review_status = 'confirmed' AND vendor_id IS NOT NULL AND total_amount IS NOT NULL),
f AS (
  SELECT vendor_id, i, {R4('x')} AS avg, 0.0::DOUBLE AS m2 FROM c WHERE i = 1
  UNION ALL
  SELECT c.vendor_id, c.i, {R4('f.avg + (c.x - f.avg) / c.i')},
    f.m2 + (c.x - f.avg) * (c.x - (f.avg + (c.x - f.avg) / c.i))
  FROM f JOIN c ON c.vendor_id = f.vendor_id AND c.i = f.i + 1)
SELECT vendor_id, i AS n, avg, {R4('CASE WHEN i > 1 THEN sqrt(m2 / (i - 1)) ELSE 0 END')} AS std
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY i DESC) AS last FROM f) WHERE last = 1"""


def _history(spark, d):
    base = tm.base(spark, d)
    recent = vendor_history(base)
    rows = base.select("invoice_id", "vendor_id").where(F.col("vendor_id").isNotNull()).join(recent, "vendor_id", "left")
    values = prior_values(F.col("recent"), F.col("invoice_id"))
    return rows.select("invoice_id", F.posexplode(values).alias("pos", "value"))


QUERIES["vendor_history_11"] = _history
SQL["vendor_history_11"] = f"""WITH {BASE}, h AS (
  SELECT a.invoice_id, b.total_amount, row_number() OVER (PARTITION BY a.invoice_id ORDER BY b.ts DESC, b.invoice_id) AS r
  FROM base a JOIN base b ON b.vendor_id = a.vendor_id AND b.invoice_id <> a.invoice_id AND b.review_status = 'confirmed')
SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY r) - 1 AS INTEGER) AS pos, CAST(total_amount AS DOUBLE) AS value
FROM h WHERE r <= 11 AND total_amount IS NOT NULL"""


def _resolve(spark, d):
    """Extracted names resolved against the vendors with an even key; the rest are created."""
    docs = tm.order_rows(spark, d, amounts=False).select("invoice_id", "vendor_name", F.col("ts").alias("uploaded_at"))
    known = tm.vendors(spark, d).where(F.col("vendor_id").cast("bigint") % 2 == 0)
    placed, vendors = resolve_vendors(docs, known)
    names = vendors.select("vendor_id", "name")
    return placed.join(names, "vendor_id").select("invoice_id", "vendor_id", "name")


QUERIES["resolve_vendors"] = _resolve
SQL["resolve_vendors"] = rf"""WITH {ORD}, n AS (SELECT invoice_id, ts, coalesce(nullif(vendor_name, ''), 'Unknown') AS name FROM ord),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^\w\s]+', '', 'g'), '\s+', ' ', 'g')) AS key FROM n),
v AS (SELECT CAST(c_custkey AS VARCHAR) AS vendor_id, c_name AS name, regexp_replace(lower(c_name), '[^\w\s]+', '', 'g') AS key
  FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT key, first(name ORDER BY ts, invoice_id) AS name FROM k WHERE key NOT IN (SELECT key FROM v) GROUP BY 1),
al AS (SELECT vendor_id, name, key FROM v UNION ALL
  SELECT substr(sha256(key), 1, 32), CASE WHEN name = upper(name) THEN array_to_string(list_transform(string_split(name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE name END, key FROM new)
SELECT invoice_id, vendor_id, al.name FROM k JOIN al USING (key)"""
