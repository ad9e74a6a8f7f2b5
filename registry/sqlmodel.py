"""SQL twins of the model tables, as common table expressions."""

from __future__ import annotations

# The date layouts that are understood.
DAY_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y", "%m-%d-%y", "%d/%m/%Y",
    "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%d-%b-%Y", "%d %b %Y", "%d-%B-%Y",
    "%b %d, %y", "%d-%b-%y",
)
MONTH_FORMATS = ("%B %Y", "%b %Y", "%b-%Y", "%B-%Y", "%b-%y", "%B-%y")


def any_of(text: str, formats: tuple[str, ...]) -> str:
    # strptime takes short years for %Y here, so texts with and without a long year are parted.
    tries = lambda y: "coalesce(" + ", ".join(
        f"try_strptime({text}, '{f}')" for f in formats if y in f
    ) + ", NULL)"
    return f"CASE WHEN regexp_matches({text}, '[0-9]{{4}}') THEN {tries('%Y')} ELSE {tries('%y')} END"


def period_sql(text: str) -> tuple[str, str]:
    """Start and end expressions of a period written as a day, a month or `a - b`."""
    left = f"CASE WHEN contains({text}, ' - ') THEN trim(split_part({text}, ' - ', 1)) ELSE trim({text}) END"
    right = f"CASE WHEN contains({text}, ' - ') THEN trim(split_part({text}, ' - ', 2)) ELSE trim({text}) END"
    start = f"coalesce({any_of(left, DAY_FORMATS)}, {any_of(left, MONTH_FORMATS)})"
    end = f"coalesce({any_of(right, DAY_FORMATS)}, CAST(last_day({any_of(right, MONTH_FORMATS)}) AS TIMESTAMP))"
    known = f"({start}) IS NOT NULL AND ({end}) IS NOT NULL"
    return (
        f"CASE WHEN {known} THEN strftime({start}, '%Y-%m-%d') END",
        f"CASE WHEN {known} THEN strftime({end}, '%Y-%m-%d') END",
    )


def R4(x: str) -> str:
    """Four places, rounded from the exact binary value as printf does."""
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(printf('%.4f', CAST({x} AS DOUBLE)) AS DOUBLE) END"


LINES = """lines AS (
  SELECT l_orderkey AS k,
    CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DECIMAL(18,2)) AS subtotal,
    CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS tax
  FROM lineitem GROUP BY 1)"""

ORD = LINES + """,
ord0 AS (
  SELECT o_orderkey AS k, o_orderdate AS ts, o_custkey AS c, o_orderstatus AS s,
    CAST(o_totalprice AS DECIMAL(18,2)) AS price, c_name AS cname, c_nationkey AS nat,
    subtotal AS sub0, tax AS tax0
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON lines.k = o_orderkey),
ord AS (
  SELECT k, printf('00000000-0000-0000-0000-%012x', k) AS invoice_id, ts, cname,
    CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(c AS VARCHAR) END AS vendor_id,
    CASE s WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'unprocessable' ELSE 'pending' END AS review_status,
    CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN '' WHEN k % 4 = 0 THEN cname
      WHEN k % 4 = 1 THEN upper(cname) WHEN k % 4 = 2 THEN ' ' || cname || ' '
      ELSE replace(cname, '#', ' #') END AS vendor_name,
    CASE WHEN k % 19 = 0 THEN NULL ELSE 'INV-' || k END AS invoice_number,
    CASE k % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%m/%d/%Y')
      WHEN 2 THEN strftime(ts, '%B %d, %Y') WHEN 3 THEN strftime(ts, '%d-%b-%y')
      WHEN 4 THEN strftime(ts, '%B %Y')
      WHEN 5 THEN strftime(ts, '%m/%d/%y') || ' - ' || strftime(ts + INTERVAL 5 DAY, '%m/%d/%y')
      WHEN 6 THEN 'n/a' ELSE strftime(ts, '%b %d, %y') END AS invoice_date,
    CAST(sub0 AS VARCHAR) AS subtotal, CAST(tax0 AS VARCHAR) AS tax,
    CASE WHEN k % 31 = 0 THEN 'N/A' WHEN k % 5 = 0 OR sub0 IS NULL THEN CAST(price AS VARCHAR)
      ELSE CAST(CAST(sub0 + tax0 AS DECIMAL(18,2)) AS VARCHAR) END AS total,
    CASE WHEN k % 37 = 0 THEN NULL ELSE ['USD','EUR','GBP','XXX','usd'][nat % 5 + 1] END AS currency,
    CASE WHEN k % 10 = 0 THEN 'likely_duplicate' WHEN k % 10 < 4 THEN 'needs_review' ELSE 'confident' END AS state,
    k % 7 = 0 AS has_anomaly
  FROM ord0)"""

_START, _END = period_sql("invoice_date")
BASE = ORD + f""",
base AS (
  SELECT ord.*, c_name AS vendor_table_name,
    TRY_CAST(total AS DECIMAL(18,4)) AS total_amount, TRY_CAST(subtotal AS DECIMAL(18,4)) AS subtotal_amount,
    TRY_CAST(tax AS DECIMAL(18,4)) AS tax_amount,
    CAST({_START} AS DATE) AS period_start, {_START} AS iso_from, {_END} AS iso_to
  FROM ord LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = vendor_id)"""

RAW = BASE + """,
items AS (
  SELECT l_orderkey AS k, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS descriptions
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
raw AS (
  SELECT base.*, concat_ws(' ', vendor_name, invoice_number, invoice_date, total, currency, subtotal, tax, descriptions) AS raw_text
  FROM base LEFT JOIN items ON items.k = base.k)"""

EVENTS = """ev AS (
  SELECT event_id AS k, printf('00000000-0000-0000-0000-%012x', event_id) AS invoice_id,
    CAST(user_id AS VARCHAR) AS vendor_id, ts AS uploaded_at, CAST(value AS DECIMAL(18,4)) AS total, event_type
  FROM events)"""

DOCS = """tok AS (
  SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)),
th AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 16)) AS UBIGINT) AS h FROM tok),
tb AS (SELECT doc_id, i, 2 * sum(CAST((h >> i) & CAST(1 AS UBIGINT) AS INTEGER)) > count(*) AS bit
  FROM th, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY 1, 2),
sim AS (SELECT doc_id, CAST(sum(CASE WHEN bit THEN CAST(1 AS UBIGINT) << i ELSE 0 END) AS UBIGINT) AS hash_bits
  FROM tb GROUP BY 1),
docs AS (
  SELECT documents.doc_id AS k, printf('00000000-0000-0000-0000-%012x', documents.doc_id) AS invoice_id, text,
    make_timestamp(documents.doc_id * 60000000) AS uploaded_at, sha256(text) AS file_hash, hash_bits,
    CASE WHEN documents.doc_id % 3 = 0 THEN [printf('00000000-0000-0000-0000-%012x', greatest(documents.doc_id - 1, 0)),
      printf('00000000-0000-0000-0000-%012x', 0)] ELSE [] END AS dismissals
  FROM documents JOIN sim USING (doc_id))"""
