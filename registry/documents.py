"""Word boxes, extraction from text, stored lexemes, nested rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.stemming import lexemes
from ledgerwright.operators.extract import Extractor, extract_patterns, nest_rows
from ledgerwright.operators.fields import raw_text
from ledgerwright.operators.words import field_boxes
from ledgerwright.plans import testmodel as tm
from registry.sqlmodel import RAW

QUERIES: dict = {}
SQL: dict = {}


def _words(spark, d):
    """Words of the documents, two hundred to a page, ten to a line."""
    docs = tm.table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "text"),
    ).select(
        "doc_id", F.floor(F.col("i") / 200).cast("int").alias("page"), (F.col("i") % 200).alias("word_no"), "text",
        (F.col("i") % 10 * 10.0).alias("x0"), (F.floor(F.col("i") % 200 / 10) * 20.0).alias("y0"),
        (F.col("i") % 10 * 10.0 + 9).alias("x1"), (F.floor(F.col("i") % 200 / 10) * 20.0 + 15).alias("y1"),
    )


def _boxes(spark, d):
    """Each document looked up by the three words in its middle, vowels in capitals."""
    docs = tm.table(spark, d, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    values = docs.withColumn("w", words).where(F.size("w") >= 3).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("middle").alias("field"),
        F.translate(F.array_join(F.slice("w", F.greatest(F.lit(1), F.floor((F.size("w") - 1) / 2)).cast("int"), 3), " "), "aeiou", "AEIOU").alias("value"),
    )
    return field_boxes(_words(spark, d), values).select(
        "doc_id", "page", *[F.round(F.element_at("bbox", i + 1), 4).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    )


QUERIES["field_boxes"] = _boxes
SQL["field_boxes"] = r"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
v AS (SELECT doc_id, list_transform(w[CAST((len(w) - 1) // 2 AS BIGINT):CAST((len(w) - 1) // 2 + 2 AS BIGINT)], lambda x: lower(regexp_replace(x, '[.,:;]+$', ''))) AS t FROM s WHERE len(w) >= 3),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM s),
p AS (SELECT doc_id, i, i // 200 AS page, i % 200 AS n, lower(regexp_replace(word, '[.,:;]+$', '')) AS tok, i % 10 * 10.0 AS x0, (i % 200) // 10 * 20.0 AS y0 FROM u),
r AS (SELECT *, lead(tok, 1) OVER o AS t2, lead(tok, 2) OVER o AS t3, lead(x0, 1) OVER o AS xb, lead(x0, 2) OVER o AS xc, lead(y0, 1) OVER o AS yb, lead(y0, 2) OVER o AS yc
  FROM p WINDOW o AS (PARTITION BY doc_id, page ORDER BY n)),
m AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.page, r.n) AS first FROM r JOIN v ON v.doc_id = r.doc_id AND r.tok = t[1] AND r.t2 = t[2] AND r.t3 = t[3]),
e AS (SELECT doc_id, page, max(x0) + 9 AS w, max(y0) + 15 AS h FROM p GROUP BY 1, 2)
SELECT m.doc_id, CAST(m.page AS INTEGER) AS page, round(CAST(least(x0, xb, xc) / w AS DOUBLE), 4) AS x0, round(CAST(least(y0, yb, yc) / h AS DOUBLE), 4) AS y0,
  round(CAST((greatest(x0, xb, xc) + 9) / w AS DOUBLE), 4) AS x1, round(CAST((greatest(y0, yb, yc) + 15) / h AS DOUBLE), 4) AS y1
FROM m JOIN e ON e.doc_id = m.doc_id AND e.page = m.page WHERE first = 1"""


#: What is read from the texts: the first match of each, which means the same to Java's and to RE2's patterns.
_PATTERNS = {
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "link": r"https?://[^ \t\n\r<>]+", "day": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "amount": r"[$€£] ?[0-9][0-9,.]*", "number": r"[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]*",
}
QUERIES["extract_fields"] = lambda spark, d: extract_patterns(tm.table(spark, d, "documents").select("doc_id", "text"), _PATTERNS).drop("text")
SQL["extract_fields"] = "SELECT doc_id, " + ", ".join(
    f"nullif(regexp_extract(text, '{pattern}'), '') AS {name}" for name, pattern in _PATTERNS.items()
) + ", coalesce(" + " AND ".join(f"regexp_extract(text, '{pattern}') = ''" for pattern in _PATTERNS.values()) + ", true) AS extraction_failed FROM documents"


def _first_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = batch["html"].str.extract(r'href="([^"]*)"', expand=False)
        yield pd.DataFrame({"page_id": batch["page_id"], "link": found, "size": batch["html"].str.len().astype("int64")})


def _custom(spark, d):
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("page_id", LongType()).add("link", StringType()).add("size", LongType())
    return Extractor("first_link", ("page_id", "html"), schema, _first_link)(tm.table(spark, d, "pages"))


QUERIES["custom_extractor"] = _custom
SQL["custom_extractor"] = """SELECT page_id, CASE WHEN contains(html, 'href="') THEN regexp_extract(html, 'href="([^"]*)"', 1) END AS link,
  length(html) AS size FROM pages"""

# Porter2 stems exist in no SQL engine at hand; the unit tests hold known word pairs.
QUERIES["document_lexemes"] = lambda spark, d: tm.table(spark, d, "documents").select(
    "doc_id", F.size(lexemes(F.col("text"))).alias("lexemes")
)


def _nested(spark, d):
    li = tm.table(spark, d, "lineitem")
    part = tm.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    none = F.lit(None)
    position = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_tax").alias("position")
    items = li.join(part, "l_partkey").select(
        tm.uuid_of(F.col("l_orderkey")).alias("invoice_id"), position, F.col("p_name").alias("description"),
        F.col("l_quantity").alias("quantity"), none.alias("unit_price"), F.col("l_extendedprice").alias("line_total"),
        none.alias("bbox"), F.lit(0).alias("page"), F.lit(0.9).alias("confidence"),
    )
    taxes = li.where(F.col("l_tax") > 0).select(
        tm.uuid_of(F.col("l_orderkey")).alias("invoice_id"), position, F.col("l_returnflag").alias("jurisdiction"),
        F.col("l_tax").alias("rate"), F.col("l_extendedprice").alias("amount"), none.alias("bbox"), F.lit(0).alias("page"), F.lit(0.9).alias("confidence"),
    )
    inv = tm.order_rows(spark, d, amounts=False).select("invoice_id", "k")
    return nest_rows(inv, items, taxes, F.col("k") % 9 != 4)


QUERIES["nested_rows"] = lambda spark, d: _nested(spark, d).select(
    "invoice_id", F.array_join(F.transform("line_items", lambda i: i["description"]), "|").alias("items"),
    F.array_join(F.transform("tax_rows", lambda t: t["jurisdiction"]), "|").alias("taxes"),
)
SQL["nested_rows"] = """WITH i AS (SELECT l_orderkey AS k, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_tax) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
t AS (SELECT l_orderkey AS k, string_agg(l_returnflag, '|' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_tax) AS s FROM lineitem WHERE l_tax > 0 GROUP BY 1)
SELECT printf('00000000-0000-0000-0000-%012x', o_orderkey) AS invoice_id, CASE WHEN o_orderkey % 9 <> 4 THEN coalesce(i.s, '') ELSE '' END AS items,
  CASE WHEN o_orderkey % 9 <> 4 THEN coalesce(t.s, '') ELSE '' END AS taxes FROM orders LEFT JOIN i ON i.k = o_orderkey LEFT JOIN t ON t.k = o_orderkey"""

QUERIES["raw_text"] = lambda spark, d: tm.extractions(spark, d, texts=True).where("is_current").select(
    "invoice_id", F.sha2(raw_text(F.col("fields"), F.col("line_items"), F.col("tax_rows")), 256).alias("text_hash")
)
SQL["raw_text"] = f"WITH {RAW} SELECT invoice_id, sha256(raw_text) AS text_hash FROM raw"
