"""Exact and near duplicates among the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.duplicates import content_duplicates, detect_duplicates, near_duplicates
from ledgerwright.operators.fields import field_diff
from ledgerwright.plans import testmodel as tm
from ledgerwright.session import cut_lineage, new_path
from ledgerwright.sources.hash_index import HashIndex
from ledgerwright.sources.ingest import address_content, drop_known, invoice_of_document, seeded_sample
from registry.sqlmodel import BASE, DOCS

QUERIES: dict = {}
SQL: dict = {}


def _documents(spark, d):
    """Hashing reads all texts, so its result is kept for the several joins that follow."""
    return cut_lineage(tm.document_rows(spark, d).drop("text"))


QUERIES["near_duplicates"] = lambda spark, d: near_duplicates(_documents(spark, d)).select(
    "invoice_id", "near_id", F.col("distance").cast("bigint").alias("distance")
)
NEAR = DOCS + """, cand AS (SELECT a.invoice_id, b.invoice_id AS near_id, bit_count(xor(a.hash_bits, b.hash_bits)) AS distance, b.uploaded_at
  FROM docs a JOIN docs b ON b.uploaded_at < a.uploaded_at AND bit_count(xor(a.hash_bits, b.hash_bits)) <= 5),
near AS (SELECT invoice_id, near_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY distance, uploaded_at, near_id) AS r FROM cand) WHERE r = 1)"""
SQL["near_duplicates"] = f"WITH {NEAR} SELECT invoice_id, near_id, CAST(distance AS BIGINT) AS distance FROM near"



def _indexed(spark, d):
    """All documents in ten batches by time, each probing the stored index and joining it."""
    docs = _documents(spark, d)
    index = HashIndex(spark, new_path(spark, "hash-index"), buckets=64, fan=4)
    most = docs.agg(F.max("k")).first()[0] or 0
    parts = [
        index.probe_and_add(docs.where(F.floor(F.col("k") * 10 / (most + 1)) == i), i) for i in range(10)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("invoice_id", "near_id", F.col("distance").cast("bigint").alias("distance"))


QUERIES["indexed_near_duplicates"] = _indexed
SQL["indexed_near_duplicates"] = SQL["near_duplicates"]

QUERIES["exact_duplicates"] = lambda spark, d: content_duplicates(_documents(spark, d)).select(
    "invoice_id", "content_id", F.col("content_distance").cast("bigint").alias("content_distance")
)
SQL["exact_duplicates"] = f"""WITH {DOCS}, l AS (SELECT invoice_id, lag(invoice_id) OVER (PARTITION BY file_hash ORDER BY uploaded_at, invoice_id) AS content_id FROM docs)
SELECT invoice_id, content_id, 0::BIGINT AS content_distance FROM l WHERE content_id IS NOT NULL"""

QUERIES["detect_duplicates"] = lambda spark, d: detect_duplicates(
    _documents(spark, d), hash_col="hash_bits"
).select("invoice_id", "duplicate_id", "match_method", F.round("similarity", 6).alias("similarity"))
SQL["detect_duplicates"] = f"""WITH {NEAR}, l AS (SELECT invoice_id, lag(invoice_id) OVER (PARTITION BY file_hash ORDER BY uploaded_at, invoice_id) AS content_id FROM docs),
j AS (SELECT docs.invoice_id, dismissals, content_id, near_id, distance FROM docs LEFT JOIN l USING (invoice_id) LEFT JOIN near USING (invoice_id))
SELECT invoice_id, coalesce(content_id, near_id) AS duplicate_id, CASE WHEN content_id IS NOT NULL THEN 'both' ELSE 'perceptual_hash' END AS match_method,
  CASE WHEN content_id IS NOT NULL THEN 1.0::DOUBLE ELSE round(1 - distance / 64.0::DOUBLE, 6) END AS similarity
FROM j WHERE coalesce(content_id, near_id) IS NOT NULL AND NOT list_contains(dismissals, coalesce(content_id, near_id))"""


def _ingest(spark, d):
    """Pages as files: first arrival per content, leaving out contents that are stored already."""
    pages = tm.table(spark, d, "pages")
    # Every page arrives twice, and each tenth is known.
    files = address_content(pages.select(
        "page_id", F.col("html").alias("content"), F.explode(F.array(F.lit(1), F.lit(0))).alias("arrival")
    ))
    known = address_content(pages.where(F.col("page_id") % 10 == 0).select(F.col("html").alias("content")))
    return drop_known(files, known, ("arrival", "page_id")).select("page_id", "arrival", "storage_key")


QUERIES["ingest_new_content"] = _ingest
SQL["ingest_new_content"] = """SELECT min(page_id) AS page_id, 0 AS arrival, sha256(html) || '.pdf' AS storage_key FROM pages
WHERE html NOT IN (SELECT html FROM pages WHERE page_id % 10 = 0) GROUP BY html"""


def _lookup(spark, d):
    docs = tm.table(spark, d, "documents")
    files = docs.where(F.col("doc_id") % 2 == 0)
    invoices = files.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").cast("string").alias("invoice_id"))
    return invoice_of_document(docs.select("doc_id", F.col("text").alias("content")), invoices).select("doc_id", "invoice_id")


QUERIES["invoice_of_document"] = _lookup
SQL["invoice_of_document"] = """WITH i AS (SELECT text, CAST(min(doc_id) AS VARCHAR) AS invoice_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, invoice_id FROM documents LEFT JOIN i USING (text)"""

QUERIES["seeded_sample"] = lambda spark, d: seeded_sample(
    tm.table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42
)
SQL["seeded_sample"] = "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100"


def _diff(spark, d):
    ext = tm.extractions(spark, d).where("is_current")
    pairs = ext.where(F.col("k") > 0).select("invoice_id", tm.uuid_of(F.col("k") - 1).alias("against_id"))
    return field_diff(pairs, ext).select("invoice_id", "field", "original_value", "current_value", "matches")


QUERIES["field_diff"] = _diff
_ROW = lambda f, same: (
    f"SELECT a.invoice_id, '{f}' AS field, b.{f} AS original_value, a.{f} AS current_value, "
    f"(a.{f} IS NULL AND b.{f} IS NULL) OR coalesce({same}, false) AS matches FROM base a JOIN base b ON b.k = a.k - 1"
)
SQL["field_diff"] = f"WITH {BASE} " + " UNION ALL ".join(
    _ROW(f, f"abs(a.{f}_amount - b.{f}_amount) <= 0.01" if f in ("subtotal", "tax", "total") else f"trim(a.{f}) = trim(b.{f})")
    for f in ("vendor_name", "invoice_number", "invoice_date", "subtotal", "tax", "total", "currency")
)
