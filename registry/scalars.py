"""Column functions over the tables: names, dates, amounts, hashes, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.functions import scoring
from ledgerwright.functions.amounts import (
    agreement, amount, line_items_check, math_reconciles, member_sum, tax_rows_check,
)
from ledgerwright.functions.compare import soft_match
from ledgerwright.functions.dates import is_valid_date, parse_period
from ledgerwright.functions.text import (
    clean_amount, display_name, normalize_date_text, normalize_name, normalize_token,
    short_fingerprint, storage_key,
)
from ledgerwright.functions.wording import explanation, headline, ratio_text, severity
from ledgerwright.operators.fields import period_counts, with_periods
from ledgerwright.plans import testmodel as tm
from registry.sqlmodel import BASE, DAY_FORMATS, ORD, any_of

QUERIES: dict = {}
SQL: dict = {}


def _names(spark, d):
    rows = tm.order_rows(spark, d, amounts=False)
    return rows.select("invoice_id", normalize_name(F.col("vendor_name")).alias("normalized"))


QUERIES["normalize_vendor"] = _names
SQL["normalize_vendor"] = rf"""WITH {ORD} SELECT invoice_id,
  trim(regexp_replace(regexp_replace(lower(vendor_name), '[^\w\s]+', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM ord"""


def _display(spark, d):
    part = tm.table(spark, d, "part")
    shouted = F.upper(F.concat_ws(" ", "p_name", F.lit("Inc., LLC gmbh.")))
    mixed = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(shouted)
    return part.select("p_partkey", display_name(mixed).alias("shown"))


QUERIES["display_name"] = _display
SQL["display_name"] = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' INC., LLC GMBH.' END AS shown
FROM part"""

QUERIES["parse_dates"] = lambda spark, d: tm.order_rows(spark, d, amounts=False).select(
    "invoice_id", "invoice_date", parse_period(F.col("invoice_date")).alias("p")
).select("invoice_id", "invoice_date", "p.iso_from", "p.iso_to")
SQL["parse_dates"] = f"WITH {BASE} SELECT invoice_id, invoice_date, iso_from, iso_to FROM base"

QUERIES["valid_dates"] = lambda spark, d: tm.order_rows(spark, d, amounts=False).select(
    "invoice_id", F.coalesce(is_valid_date(F.col("invoice_date")), F.lit(False)).alias("valid")
)
SQL["valid_dates"] = f"""WITH {ORD} SELECT invoice_id, coalesce({any_of('invoice_date', (
    '%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%d-%m-%Y', '%d.%m.%Y', '%B %d, %Y', '%d %B %Y',
    '%m/%d/%y', '%d/%m/%y', '%m-%d-%y', '%d-%m-%y', '%b %d, %Y', '%d %b %Y', '%d-%b-%Y', '%d-%b-%y'))}
  IS NOT NULL, false) AS valid FROM ord"""


def _backfill(spark, d):
    ext = tm.extractions(spark, d)
    # Half of the stored periods are wiped, so that there is something to fill.
    k = F.col("k")
    stale = F.transform_values(
        "fields", lambda n, f: F.when(k % 2 == 0, f.withField("iso_from", F.lit(None).cast("string")).withField("iso_to", F.lit(None).cast("string"))).otherwise(f)
    )
    return period_counts(with_periods(ext.withColumn("fields", stale)))


QUERIES["backfill_period_counts"] = _backfill
SQL["backfill_period_counts"] = f"""WITH {BASE}, versions AS (
  SELECT base.*, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] ELSE [0] END) AS v FROM base)
SELECT count(*) AS seen, count(*) FILTER (iso_from IS NOT NULL AND k % 2 = 0) AS updated,
  count(*) FILTER (iso_from IS NOT NULL AND k % 2 = 1) AS already_set, count(*) FILTER (iso_from IS NULL) AS unparseable
FROM versions"""

QUERIES["math_reconcile"] = lambda spark, d: tm.order_rows(spark, d).select(
    "invoice_id", math_reconciles(*[amount(F.col(c)) for c in ("subtotal", "tax", "total")]).alias("passed")
)
MATH = """CASE WHEN subtotal_amount IS NULL OR tax_amount IS NULL OR total_amount IS NULL THEN true
  WHEN least(subtotal_amount, tax_amount, total_amount) < 0 THEN false
  ELSE abs(subtotal_amount + tax_amount - total_amount) <= 0.02 END"""
SQL["math_reconcile"] = f"WITH {BASE} SELECT invoice_id, {MATH} AS passed FROM base"

QUERIES["valid_currency"] = lambda spark, d: tm.order_rows(spark, d, amounts=False).select(
    "invoice_id", scoring.is_valid_currency(F.col("currency")).alias("valid")
)
SQL["valid_currency"] = f"""WITH {ORD} SELECT invoice_id, coalesce(upper(trim(currency)) IN ('USD','EUR','GBP','INR','CAD','AUD','JPY','CHF',
  'CNY','SEK','NOK','DKK','SGD','HKD','MXN','BRL','ZAR'), false) AS valid FROM ord"""


def _item_rows(spark, d):
    """Orders with their lines and tax rows as arrays of text amounts."""
    li = tm.table(spark, d, "lineitem")
    net = (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(16,2)")
    tax = (net * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(16,2)")
    lines = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", net.alias("line_total"), tax.alias("amount")
        ))).alias("items")
    )
    return tm.order_rows(spark, d).join(lines, "k", "left")


def _checks(spark, d):
    rows = _item_rows(spark, d).withColumns({
        "i": line_items_check(F.col("items"), amount(F.col("subtotal"))),
        "t": tax_rows_check(F.col("items"), amount(F.col("tax"))),
    })
    return rows.select(
        "invoice_id", F.col("i.matches").alias("items_match"), F.col("i.delta").cast("double").alias("items_delta"),
        F.col("t.matches").alias("tax_match"), F.col("t.delta").cast("double").alias("tax_delta"),
        F.round(member_sum(F.transform("items", lambda r: F.struct(r["line_total"].cast("double").alias("line_total"))), "line_total"), 2).alias("shown_sum"),
    )


QUERIES["line_item_and_tax_checks"] = _checks
SQL["line_item_and_tax_checks"] = f"""WITH {BASE}, r AS (
  SELECT l_orderkey AS k, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,2)) AS net,
    CAST(l_tax AS DECIMAL(4,2)) AS rate FROM lineitem),
s AS (SELECT k, sum(net) AS items, sum(CAST(net * rate AS DECIMAL(16,2))) AS taxes FROM r GROUP BY 1)
SELECT invoice_id, coalesce(abs(items - subtotal_amount) <= 0.02, true) AS items_match,
  CAST(coalesce(items - subtotal_amount, 0) AS DOUBLE) AS items_delta,
  coalesce(abs(taxes - tax_amount) <= 0.02, true) AS tax_match,
  CAST(coalesce(taxes - tax_amount, 0) AS DOUBLE) AS tax_delta, round(CAST(items AS DOUBLE), 2) AS shown_sum
FROM base LEFT JOIN s ON s.k = base.k"""


def _agreement(spark, d):
    """Readings of consecutive line items of an order compared with each other."""
    li = tm.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("string").alias("q"),
        F.when(F.col("l_linenumber") % 3 == 0, None).otherwise(F.col("l_returnflag")).alias("r"),
    )
    part = tm.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("string").alias("size"), "p_type")
    return li.join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        agreement(F.col("q"), F.col("size"), "total").alias("amounts"),
        agreement(F.col("r"), F.lit(" R "), "currency").alias("texts"),
        agreement(F.col("r"), F.lit(None).cast("string"), "currency").alias("nulls"),
    )


QUERIES["agreement_scores"] = _agreement
SQL["agreement_scores"] = """SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CASE WHEN abs(l_quantity - p_size) <= 0.01 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS amounts,
  CAST(CASE WHEN l_linenumber % 3 <> 0 AND l_returnflag = 'R' THEN 1.0 ELSE 0.3 END AS DOUBLE) AS texts,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS nulls
FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _cleaned(spark, d):
    o = tm.table(spark, d, "orders")
    money = F.concat(F.lit("US$ "), F.format_number(F.col("o_totalprice"), 2), F.lit(" EUR.-"))
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd . MM - yyyy |")
    return o.select(
        "o_orderkey", clean_amount(money).try_cast("double").alias("money"),
        normalize_date_text(day).alias("day"),
        normalize_token(F.concat(F.lit(" "), "o_orderpriority", F.lit(".,:"))).alias("token"),
    )


QUERIES["cleaned_text"] = _cleaned
SQL["cleaned_text"] = """SELECT o_orderkey, round(o_totalprice, 2) AS money, strftime(o_orderdate, '%d/%m/%Y') AS day,
  lower(o_orderpriority) AS token FROM orders"""


def _soft(spark, d):
    rows = tm.order_rows(spark, d)
    k = F.col("k")
    field = tm.choose(k, F.lit("total"), F.lit("currency"), F.lit("invoice_date"), F.lit("vendor_name"))
    expected = F.when(k % 4 == 0, F.concat(F.lit("$"), "subtotal")).when(k % 4 == 1, F.lit("€")).when(
        k % 4 == 2, F.replace("invoice_date", F.lit(","), F.lit("."))
    ).otherwise(F.upper("cname"))
    actual = F.when(k % 4 == 0, F.col("total")).when(k % 4 == 1, F.col("currency")).when(
        k % 4 == 2, F.col("invoice_date")
    ).otherwise(F.substring("cname", 3, 12))
    return rows.select("invoice_id", soft_match(field, expected, actual).alias("ok"))


QUERIES["soft_compare"] = _soft
SQL["soft_compare"] = f"""WITH {BASE} SELECT invoice_id, coalesce(CASE k % 4
  WHEN 0 THEN abs(CAST(subtotal_amount AS DOUBLE) - CAST(total_amount AS DOUBLE)) / greatest(abs(CAST(subtotal_amount AS DOUBLE)), abs(CAST(total_amount AS DOUBLE)), 1) <= 0.01
  WHEN 1 THEN upper(currency) = 'EUR'
  WHEN 2 THEN contains(trim(regexp_replace(replace(invoice_date, ',', '.'), '[\\s/\\-.l|]+', '/', 'g'), '/'), trim(regexp_replace(invoice_date, '[\\s/\\-.l|]+', '/', 'g'), '/'))
    OR contains(trim(regexp_replace(invoice_date, '[\\s/\\-.l|]+', '/', 'g'), '/'), trim(regexp_replace(replace(invoice_date, ',', '.'), '[\\s/\\-.l|]+', '/', 'g'), '/'))
  ELSE contains(lower(cname), lower(substr(cname, 3, 12))) END, false) AS ok FROM base"""


def _wording(spark, d):
    e = tm.table(spark, d, "events")
    v, k = F.col("value"), F.col("event_id")
    code = F.when(k % 3 == 0, "EUR").otherwise("USD")
    mean = (k % 40 - 1).cast("double")
    value = F.when(k % 11 == 0, 0.0).otherwise(F.col("value"))
    return e.select(
        "event_id", severity(v / 25).alias("severity"), ratio_text(v + 0.5).alias("ratio"),
        headline(value, code).alias("headline"), F.regexp_extract(
            explanation(value, mean, code, (k % 12).cast("int")), r"^(\S+ \S+)", 1).alias("lead"),
    )


QUERIES["anomaly_wording"] = _wording
SQL["anomaly_wording"] = """WITH e AS (SELECT event_id, value AS v, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS x,
  CAST(event_id % 40 - 1 AS DOUBLE) AS m, CASE WHEN event_id % 3 = 0 THEN 'EUR ' ELSE '$' END AS c FROM events)
SELECT event_id, CASE WHEN v / 25 >= 4 THEN 'high' WHEN v / 25 >= 2.5 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN v + 0.5 >= 10 THEN printf('%.0f', v + 0.5) ELSE printf('%.1f', v + 0.5) END || '×' AS ratio,
  c || printf('%.2f', x) || ' invoice' AS headline,
  CASE WHEN m <= 0 THEN 'No prior' WHEN x >= m THEN CASE WHEN x / m >= 10 THEN printf('%.0f', x / m) ELSE printf('%.1f', x / m) END || '× this'
    WHEN x <= 0 THEN 'Zero or' ELSE CASE WHEN m / x >= 1000 THEN format('{:,}', CAST(round_even(m / x, 0) AS BIGINT)) WHEN m / x >= 10 THEN printf('%.0f', m / x) ELSE printf('%.1f', m / x) END || '× smaller' END AS lead
FROM e"""


def _fingerprints(spark, d):
    p = tm.table(spark, d, "pages")
    return p.select("page_id", storage_key(F.col("html")).alias("key"), short_fingerprint(F.col("url")).alias("short"))


QUERIES["fingerprints"] = _fingerprints
SQL["fingerprints"] = "SELECT page_id, sha256(html) || '.pdf' AS key, substr(sha256(url), 1, 16) AS short FROM pages"


def _hamming(spark, d):
    p = tm.table(spark, d, "pages")
    a, b = F.substring(F.md5("html"), 1, 16), F.substring(F.md5("url"), 1, 16)
    short = F.when(F.col("page_id") % 5 == 0, F.substring(b, 1, 12)).otherwise(b)
    dist = scoring.hamming(a, short)
    kind = scoring.duplicate_class(F.col("page_id") % 2 == 0, dist - 26)
    return p.select(
        "page_id", dist.alias("distance"), F.round(scoring.hash_similarity(dist), 6).alias("similarity")
    , kind["method"].alias("method"), F.round(kind["similarity"], 6).alias("class_similarity"))


QUERIES["hash_distance"] = _hamming
SQL["hash_distance"] = """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN
    CAST(bit_count(xor(CAST('0x' || substr(md5(html), 1, 16) AS UBIGINT), CAST('0x' || substr(md5(url), 1, 16) AS UBIGINT))) AS INTEGER) END AS d FROM pages)
SELECT page_id, d AS distance, round(greatest(0.0::DOUBLE, coalesce(1 - d / 64.0::DOUBLE, 0.0)), 6) AS similarity,
  CASE WHEN page_id % 2 = 0 AND d - 26 <= 5 THEN 'both' WHEN page_id % 2 = 0 THEN 'content_fingerprint' WHEN d - 26 <= 5 THEN 'perceptual_hash' END AS method,
  CASE WHEN page_id % 2 = 0 THEN 1.0::DOUBLE WHEN d - 26 <= 5 THEN round(greatest(0.0::DOUBLE, 1 - (d - 26) / 64.0::DOUBLE), 6) END AS class_similarity FROM p"""


def _tiers(spark, d):
    names = {"haiku": "m1", "sonnet": "m2", "opus": "m3"}
    e = tm.table(spark, d, "events")
    model = F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))
    return e.select("event_id", scoring.tier_of_model(model, names).alias("tier"))


QUERIES["tier_of_model"] = _tiers
SQL["tier_of_model"] = """SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'sonnet' WHEN 3 THEN 'opus' ELSE 'haiku' END AS tier FROM events"""
