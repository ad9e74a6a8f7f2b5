"""Reviewer actions over the line items, each line item being one action on its order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.actions import apply_actions, confirm_events, unknown_invoices
from ledgerwright.plans import testmodel as tm
from registry.sqlmodel import BASE, ORD

QUERIES: dict = {}
SQL: dict = {}


def _actions(spark, d):
    li = tm.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    target = F.when(F.col("l_suppkey") % 50 == 7, F.col("l_orderkey") + 1_000_000_000).otherwise(F.col("l_orderkey"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("action_id"),
        F.col("l_shipdate").cast("timestamp").alias("acted_at"), tm.uuid_of(target).alias("invoice_id"),
        F.when(n % 3 == 0, "confirm").when(n % 3 == 1, "dismiss_duplicate").otherwise("mark_unprocessable").alias("action"),
        F.when(n % 3 == 1, tm.uuid_of(F.col("l_partkey") % 50)).alias("against_id"),
    )


ACT = ORD + """, act AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS action_id, l_shipdate AS acted_at,
  printf('00000000-0000-0000-0000-%012x', CASE WHEN l_suppkey % 50 = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END) AS invoice_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dismiss_duplicate' ELSE 'mark_unprocessable' END AS action,
  printf('00000000-0000-0000-0000-%012x', l_partkey % 50) AS against_id FROM lineitem)"""

QUERIES["apply_actions"] = lambda spark, d: apply_actions(tm.invoices(spark, d), _actions(spark, d)).select(
    "invoice_id", "review_status", F.array_join("duplicate_dismissals", ",").alias("dismissals")
)
SQL["apply_actions"] = f"""WITH {ACT}, s AS (SELECT invoice_id, arg_max(CASE action WHEN 'confirm' THEN 'confirmed' ELSE 'unprocessable' END, (acted_at, action_id)) AS st
  FROM act WHERE action <> 'dismiss_duplicate' GROUP BY 1),
p AS (SELECT invoice_id, against_id, min((acted_at, action_id)) AS first_at FROM act WHERE action = 'dismiss_duplicate' GROUP BY 1, 2),
l AS (SELECT invoice_id, string_agg(against_id, ',' ORDER BY first_at) AS ds FROM p GROUP BY 1)
SELECT ord.invoice_id, coalesce(st, review_status) AS review_status, coalesce(ds, '') AS dismissals
FROM ord LEFT JOIN s USING (invoice_id) LEFT JOIN l USING (invoice_id)"""

QUERIES["unknown_invoices"] = lambda spark, d: unknown_invoices(_actions(spark, d), tm.invoices(spark, d)).select("action_id", "error")
SQL["unknown_invoices"] = f"""WITH {ACT} SELECT action_id, 'invoice ' || invoice_id || ' not found' AS error FROM act
WHERE invoice_id NOT IN (SELECT invoice_id FROM ord)"""

QUERIES["confirm_events"] = lambda spark, d: confirm_events(_actions(spark, d), tm.base(spark, d)).select(
    "invoice_id", "vendor_id", F.date_format("confirmed_at", "yyyy-MM-dd").alias("day"), F.coalesce("total", F.lit(-1.0)).alias("total")
)
SQL["confirm_events"] = f"""WITH {BASE}, {ACT[len(ORD) + 2:]},
f AS (SELECT invoice_id, min(acted_at) AS first_at FROM act WHERE action = 'confirm' GROUP BY 1)
SELECT invoice_id, vendor_id, strftime(first_at, '%Y-%m-%d') AS day, coalesce(CAST(total_amount AS DOUBLE), -1) AS total
FROM base JOIN f USING (invoice_id) WHERE vendor_id IS NOT NULL"""
