"""Scoring against ground truth derived from the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators import evaluate as ev
from ledgerwright.plans import testmodel as tm
from ledgerwright.sources.ingest import annotation_rows, ocr_text
from registry.sqlmodel import BASE, ORD

QUERIES: dict = {}
SQL: dict = {}

STATES = ["confident", "likely_duplicate", "needs_review"]


def _judged(spark, d):
    rows = tm.order_rows(spark, d)
    k = F.col("k")
    none = F.array().cast("array<string>")
    truth = rows.where(k % 6 != 5).select(
        "invoice_id", F.col("cname").alias("expected_vendor"), F.col("subtotal").cast("double").alias("expected_total"),
        F.when(k % 9 == 0, "likely_duplicate").when(k % 2 == 0, F.col("state")).otherwise("needs_review").alias("expected_state"),
        F.when(k % 8 == 0, F.array(F.lit("extraction_failed"))).when(k % 4 == 0, F.array(F.lit("anomaly"))).otherwise(none).alias("expected_reasons"),
        (k % 23 == 0).alias("unprocessable"),
    ).withColumn("expected_total", F.coalesce("expected_total", F.lit(0.0)))
    odd = F.when(k % 7 == 0, F.array(F.lit("anomaly"), F.lit("math_fails"))).otherwise(none)
    low = F.least((k % 10).cast("double") / 10, (k % 7).cast("double") / 7, (k % 13).cast("double") / 13)
    results = rows.select(
        "invoice_id", "vendor_name", F.when(k % 3 == 0, F.col("subtotal")).otherwise(F.col("total")).alias("total"),
        "state", odd.alias("reason_types"), F.when(k % 15 != 0, low).alias("confidence_min"),
    )
    return ev.judge(truth, results)


JUDGE = BASE + """, j AS (SELECT k, invoice_id, state, coalesce(CASE WHEN k % 15 <> 0 THEN least((k % 10) / 10.0::DOUBLE, (k % 7) / 7.0::DOUBLE, (k % 13) / 13.0::DOUBLE) END, 0) AS conf,
    CASE WHEN k % 9 = 0 THEN 'likely_duplicate' WHEN k % 2 = 0 THEN state ELSE 'needs_review' END AS expected_state,
    coalesce(vendor_name = cname, false) OR (k % 23 = 0 AND (vendor_name IS NULL OR vendor_name = 'Unknown')) AS vendor_ok,
    CASE WHEN k % 23 = 0 THEN coalesce(CASE WHEN k % 3 = 0 THEN subtotal_amount ELSE total_amount END, 0) = 0
      ELSE coalesce(abs(CAST(CASE WHEN k % 3 = 0 THEN subtotal_amount ELSE total_amount END AS DOUBLE) - CAST(coalesce(subtotal_amount, 0) AS DOUBLE)) <= 0.5, false) END AS total_ok,
    CASE WHEN k % 8 = 0 THEN false WHEN k % 4 = 0 THEN k % 7 = 0 ELSE true END AS reasons_ok FROM base WHERE k % 6 <> 5),
judged AS (SELECT *, state = expected_state AS state_ok FROM j)"""

_R = lambda *names: [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]

QUERIES["eval_flags"] = lambda spark, d: _judged(spark, d).select("invoice_id", *ev.FLAGS)
SQL["eval_flags"] = f"WITH {JUDGE} SELECT invoice_id, vendor_ok, total_ok, state_ok, reasons_ok FROM judged"

QUERIES["eval_accuracy"] = lambda spark, d: ev.accuracy(_judged(spark, d)).select(
    "n", *_R("vendor_accuracy", "total_accuracy", "state_accuracy", "reason_recall")
)
_A = lambda c: f"round(avg(CAST({c} AS DOUBLE)) + 1e-9, 6)"
SQL["eval_accuracy"] = f"""WITH {JUDGE} SELECT count(*) AS n, {_A('vendor_ok')} AS vendor_accuracy, {_A('total_ok')} AS total_accuracy,
  {_A('state_ok')} AS state_accuracy, {_A('reasons_ok')} AS reason_recall FROM judged"""

QUERIES["eval_by_state"] = lambda spark, d: ev.accuracy_by_state(_judged(spark, d)).select(
    "expected_state", "n", *_R("state_accuracy", "reason_recall")
)
SQL["eval_by_state"] = f"""WITH {JUDGE} SELECT expected_state, count(*) AS n, {_A('state_ok')} AS state_accuracy, {_A('reasons_ok')} AS reason_recall FROM judged GROUP BY 1"""

QUERIES["confusion"] = lambda spark, d: ev.confusion(_judged(spark, d), STATES)
SQL["confusion"] = f"WITH {JUDGE} SELECT expected_state, " + ", ".join(
    f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES
) + " FROM judged GROUP BY 1"

QUERIES["calibration"] = lambda spark, d: ev.calibration(_judged(spark, d)).select(
    "bucket", "n", *_R("correct_rate"), F.round("confidence_mid", 2).alias("confidence_mid")
)
SQL["calibration"] = f"""WITH {JUDGE} SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bucket, count(*) AS n,
  {_A('vendor_ok AND total_ok AND state_ok AND reasons_ok')} AS correct_rate, round((least(floor(conf * 10), 9) + 0.5) / 10, 2) AS confidence_mid
FROM judged WHERE NOT (expected_state = 'needs_review' AND k % 8 = 0) GROUP BY 1, 4"""

QUERIES["eval_errors"] = lambda spark, d: ev.errors(_judged(spark, d)).select("invoice_id", "expected_state", "state")
SQL["eval_errors"] = f"""WITH {JUDGE} SELECT invoice_id, expected_state, state FROM judged
WHERE NOT (vendor_ok AND total_ok AND state_ok AND reasons_ok) ORDER BY invoice_id LIMIT 20"""


def _search_scores(spark, d):
    """One case per nation: large orders by listed price, found by extracted total."""
    nations = tm.table(spark, d, "nation").select(F.col("n_name").alias("case"), "n_nationkey")
    cust = tm.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = tm.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    who = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("o_orderkey", "case", "o_totalprice", "n_nationkey")
    keyed = who.select("case", tm.uuid_of(F.col("o_orderkey")).alias("invoice_id"), "o_totalprice", "n_nationkey")
    totals = tm.order_rows(spark, d).select("invoice_id", F.col("total").try_cast("double").alias("total"))
    found = keyed.join(totals, "invoice_id").where((F.col("total") > 300000) & (F.col("n_nationkey") % 5 != 1))
    wanted = keyed.where((F.col("o_totalprice") > 300000) & (F.col("n_nationkey") % 7 != 2))
    return ev.search_scores(nations.select("case"), wanted, found)


SEARCH = BASE + """, c AS (SELECT base.*, n_name, n_nationkey, o_totalprice FROM base JOIN orders ON o_orderkey = base.k
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT n_name, o_totalprice > 300000 AND n_nationkey % 7 <> 2 AS e, coalesce(total_amount > 300000, false) AND n_nationkey % 5 <> 1 AS a FROM c),
s AS (SELECT n.n_name AS "case", count(*) FILTER (e AND a) AS tp, count(*) FILTER (a AND NOT e) AS fp, count(*) FILTER (e AND NOT a) AS fn
  FROM nation n LEFT JOIN m ON m.n_name = n.n_name GROUP BY 1),
scores AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall, fp = 0 AND fn = 0 AS exact FROM s)"""
QUERIES["search_scores"] = lambda spark, d: _search_scores(spark, d).select(
    "case", "tp", "fp", "fn", *_R("precision", "recall"), "exact"
)
SQL["search_scores"] = f"""WITH {SEARCH} SELECT "case", tp, fp, fn, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, exact FROM scores"""
QUERIES["search_macro"] = lambda spark, d: ev.macro(_search_scores(spark, d)).select("cases", *_R("precision", "recall", "exact_rate"))
SQL["search_macro"] = f"WITH {SEARCH} SELECT count(*) AS cases, {_A('precision')} AS precision, {_A('recall')} AS recall, {_A('exact')} AS exact_rate FROM scores"


def _clauses(spark, d):
    e = tm.table(spark, d, "events")
    k = F.col("event_id")
    clause = lambda f, o, v: F.struct(f.alias("field"), F.lit(o).alias("op"), v.cast("string").alias("value"))
    none = F.array().cast("array<struct<field:string,op:string,value:string>>")
    price = clause(F.lit("total"), "gt", k % 7)
    return e.select(
        k.alias("case"),
        F.when(k % 5 == 0, none).otherwise(F.array(clause(F.col("event_type"), "eq", k % 3), price)).alias("expected"),
        F.when(k % 4 == 0, none).when(k % 6 == 1, F.array(price)).otherwise(F.array(clause(F.col("event_type"), "eq", k % 2), price)).alias("actual"),
        (k % 3 == 0).alias("expect_untranslated"), (k % 9 == 0).alias("untranslated"),
    )


CLAUSE = """c AS (SELECT event_id AS k, event_type, CASE WHEN event_id % 5 = 0 THEN [] ELSE [event_type || '=' || (event_id % 3), 'total>' || (event_id % 7)] END AS e,
    CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 6 = 1 THEN ['total>' || (event_id % 7)] ELSE [event_type || '=' || (event_id % 2), 'total>' || (event_id % 7)] END AS a,
    (event_id % 3 = 0) = (event_id % 9 = 0) AS intent_ok FROM events),
s AS (SELECT *, len(list_intersect(e, a)) AS n FROM c),
sc AS (SELECT k, CASE WHEN len(e) > 0 AND len(a) > 0 THEN n / len(a) WHEN len(a) > 0 THEN 0.0 ELSE 1.0 END AS precision,
  CASE WHEN len(e) > 0 AND len(a) > 0 THEN n / len(e) WHEN len(e) > 0 THEN 0.0 ELSE 1.0 END AS recall, intent_ok,
  n = len(e) AND n = len(a) AND intent_ok AS exact, e, a, event_type FROM s)"""
QUERIES["clause_scores"] = lambda spark, d: ev.clause_scores(_clauses(spark, d)).select(
    "case", *_R("precision", "recall"), "intent_ok", "exact"
)
SQL["clause_scores"] = f'WITH {CLAUSE} SELECT k AS "case", round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, intent_ok, exact FROM sc'
QUERIES["clause_recall_by_field"] = lambda spark, d: ev.clause_recall_by_field(_clauses(spark, d)).select("field", "expected", "recalled", *_R("rate"))
SQL["clause_recall_by_field"] = f"""WITH {CLAUSE}, x AS (SELECT event_type, a, unnest(e) AS c FROM sc), y AS (
  SELECT CASE WHEN c LIKE 'total%' THEN 'total' ELSE event_type END AS field, list_contains(a, c) AS hit FROM x)
SELECT field, count(*) AS expected, count(*) FILTER (hit) AS recalled, round(avg(CAST(hit AS DOUBLE)) + 1e-9, 6) AS rate FROM y GROUP BY 1"""


def _compared(spark, d):
    rows = tm.order_rows(spark, d).withColumnRenamed("invoice_id", "doc_id")
    told = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), c.alias("text"))
        for f, c in (("vendor_name", F.col("cname")), ("total", F.concat(F.lit("$ "), F.coalesce("subtotal", F.lit("0")))), ("currency", F.lit("$")))
    ])).alias("t")
    truth = rows.select("doc_id", told).select("doc_id", "t.field", "t.text")
    values = F.create_map(*[x for f in ("vendor_name", "total", "currency") for x in (F.lit(f), F.col(f))])
    return ev.compare_fields(truth, rows.where(F.col("k") % 12 != 7).select("doc_id", values.alias("values")))


COMPARED = BASE + """, x AS (SELECT invoice_id, 'vendor_name' AS field, coalesce(contains(lower(trim(vendor_name)), lower(cname)) OR contains(lower(cname), lower(trim(vendor_name))), false) AS ok FROM base WHERE k % 12 <> 7
  UNION ALL SELECT invoice_id, 'currency', coalesce(upper(currency) = 'USD', false) FROM base WHERE k % 12 <> 7
  UNION ALL SELECT invoice_id, 'total', coalesce(abs(CAST(total_amount AS DOUBLE) - CAST(coalesce(subtotal_amount, 0) AS DOUBLE)) / greatest(abs(CAST(total_amount AS DOUBLE)), abs(CAST(coalesce(subtotal_amount, 0) AS DOUBLE)), 1) <= 0.01, false) FROM base WHERE k % 12 <> 7)"""
QUERIES["field_accuracy"] = lambda spark, d: ev.field_accuracy(_compared(spark, d)).select("field", "ok", "total", *_R("rate"))
SQL["field_accuracy"] = f"""WITH {COMPARED} SELECT field, count(*) FILTER (ok) AS ok, count(*) AS total, {_A('ok')} AS rate FROM x GROUP BY 1
UNION ALL SELECT '(all)', count(*) FILTER (ok), count(*), {_A('ok')} FROM x"""
QUERIES["documents_with_mismatch"] = lambda spark, d: ev.documents_with_mismatch(_compared(spark, d))
SQL["documents_with_mismatch"] = f"WITH {COMPARED} SELECT count(DISTINCT invoice_id) AS documents FROM x WHERE NOT ok"


def _annotations(spark, d):
    rows = tm.order_rows(spark, d, amounts=False)
    entry = lambda kind, text: F.struct(F.lit(kind).alias("fieldtype"), text.alias("text"))
    return annotation_rows(rows.select(
        F.col("invoice_id").alias("doc_id"),
        F.array(
            entry("note", F.lit("x")), entry("vendor_name", F.col("vendor_name")), entry("amount_total_gross", F.col("total")),
            entry("vendor_name", F.lit("second")), entry("currency_code_amount_due", F.col("currency")),
        ).alias("field_extractions"),
    ))


QUERIES["annotation_fields"] = _annotations
SQL["annotation_fields"] = f"""WITH {ORD} SELECT invoice_id AS doc_id, 'vendor_name' AS field, coalesce(vendor_name, '') AS text FROM ord
UNION ALL SELECT invoice_id, 'total', CASE WHEN k % 31 = 0 THEN 'N/A' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END FROM ord JOIN orders ON o_orderkey = k
UNION ALL SELECT invoice_id, 'currency', coalesce(currency, '') FROM ord"""


def _ocr(spark, d):
    """Conversations as scanned documents: a page per turn, a block per line."""
    c = tm.table(spark, d, "conversations")
    blocks = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text")))
    pages = c.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", blocks.alias("blocks")))), lambda p: F.struct(p["blocks"])
    ).alias("pages"))
    return pages.select("conv_id", F.sha2(ocr_text(F.col("pages")), 256).alias("text_hash"), F.length(ocr_text(F.col("pages"), 200)).alias("cut_length"))


QUERIES["ocr_text"] = _ocr
SQL["ocr_text"] = r"""WITH b AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
t AS (SELECT conv_id, turn, i, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM b),
j AS (SELECT conv_id, coalesce(string_agg(t, ' ' ORDER BY turn, i) FILTER (t <> ''), '') AS text FROM t GROUP BY 1)
SELECT conv_id, sha256(text) AS text_hash, CAST(CASE WHEN length(text) > 200 THEN 203 ELSE length(text) END AS INTEGER) AS cut_length FROM j"""
