"""What the writers store, read back: exports, the usage log, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.operators.rollup import inbox_tab
from ledgerwright.plans import testmodel as tm
from ledgerwright.session import new_path
from ledgerwright.sources.export import EXPORT_COLUMNS, append_usage, read_export, write_export, write_export_file
from ledgerwright.sources.pages import PageDirectory
from registry.search import SQL as SEARCH
from registry.sqlmodel import BASE
from registry.usage import SQL as USAGE

QUERIES: dict = {}
SQL: dict = {}
_QUERY, _AT = {"filters": [], "limit": None}, "2024-01-01T00:00:00Z"


def _exported(spark, d, form):
    path = new_path(spark, "export")
    write_export(tm.base(spark, d), path, _QUERY, _AT, form)
    return path


QUERIES["export_csv"] = lambda spark, d: read_export(spark, f"{_exported(spark, d, 'csv')}/rows", header=True)
SQL["export_csv"] = SEARCH["export_flat"]

QUERIES["export_json"] = lambda spark, d: spark.read.schema(", ".join(f"{name} string" for name in EXPORT_COLUMNS)).json(
    f"{_exported(spark, d, 'json')}/rows"
)
SQL["export_json"] = SEARCH["export_flat"]


def _sections(spark, d):
    """Invoices by id as one CSV in sections."""
    path = new_path(spark, "export")
    write_export_file(tm.base(spark, d).orderBy("invoice_id"), path, _QUERY, _AT)
    return path


QUERIES["export_file"] = lambda spark, d: read_export(spark, f"{_sections(spark, d)}/section=1")
SQL["export_file"] = SEARCH["export_flat"]
QUERIES["export_file_head"] = lambda spark, d: spark.read.text(f"{_sections(spark, d)}/section=0").select(F.col("value").alias("line"))
SQL["export_file_head"] = f"""WITH {BASE} SELECT unnest(['# Exported at: {_AT}', '# Rows: ' || count(*), '# Query: {{"filters": [], "limit": null}}', '{",".join(EXPORT_COLUMNS)}']) AS line FROM base"""


def _usage_log(spark, d):
    """Calls appended in three batches, the second of them twice."""
    calls, path = tm.usage_rows(spark, d).withColumn("part", F.crc32(F.col("id").cast("binary")) % 3), new_path(spark, "usage")
    for part in (0, 1, 1, 2):
        append_usage(calls.where(F.col("part") == part).drop("part"), path, str(part))
    return spark.read.parquet(path)


QUERIES["usage_log"] = lambda spark, d: _usage_log(spark, d).select(
    "id", "cache_creation_input_tokens", F.round("cost_usd", 8).alias("cost_usd")
)
SQL["usage_log"] = USAGE["price_calls"]


def _directory(spark, d, tab):
    rows = inbox_tab(tm.base(spark, d), tab).select("invoice_id", "uploaded_at", "review_status")
    directory = PageDirectory(spark, new_path(spark, "pages"), rows.schema, "uploaded_at", "invoice_id")
    directory.write(rows, ranges=32)
    return directory


QUERIES["directory_page"] = lambda spark, d: _directory(spark, d, "needs_review").page(7, 25).select("invoice_id")
SQL["directory_page"] = f"""WITH {BASE} SELECT invoice_id FROM base WHERE state = 'needs_review' AND review_status = 'pending'
ORDER BY ts DESC, invoice_id LIMIT 25 OFFSET 150"""
QUERIES["directory_last_page"] = lambda spark, d: _directory(spark, d, "likely_duplicate").page(10**6, 25).select("invoice_id")
SQL["directory_last_page"] = SEARCH["page_clamped"]
