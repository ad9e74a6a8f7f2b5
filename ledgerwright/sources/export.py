"""Exports and appends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwright.functions.stemming import lexemes
from ledgerwright.operators.fields import field_value, promote
from ledgerwright.operators.usage import price_calls
from ledgerwright.schema import STORED_EXTRACTIONS
from ledgerwright.session import open_writers

EXPORT_COLUMNS = (
    "invoice_id", "vendor_name", "invoice_number", "invoice_date", "subtotal", "tax", "total",
    "currency", "triage_state", "review_status", "uploaded_at", "reasons",
)
# Blanks around a value belong to it.
CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_rows(base: DataFrame) -> DataFrame:
    """Twelve flat columns per invoice; reasons as JSON without unused members."""
    value = lambda name: field_value(name).alias(name)
    return base.select(
        "invoice_id", value("vendor_name"), value("invoice_number"), value("invoice_date"),
        value("subtotal"), value("tax"), value("total"), value("currency"),
        F.col("state").alias("triage_state"), "review_status",
        F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("uploaded_at"),
        F.coalesce(F.to_json("reasons"), F.lit("[]")).alias("reasons"),
    )


def export_info(rows: DataFrame, query: dict, exported_at: str) -> DataFrame:
    """One row that says what was exported: time, number of rows, the query."""
    return rows.agg(F.count("*").alias("row_count")).select(
        F.lit(exported_at).alias("exported_at"), "row_count",
        F.lit(json.dumps(query, sort_keys=True)).alias("query"),
    )


def write_export(base: DataFrame, path: str, query: dict, exported_at: str, form: str = "csv") -> None:
    """Rows below path/rows and their description below path/query."""
    counted = Observation()
    rows = export_rows(base).observe(counted, F.count(F.lit(1)).alias("row_count"))
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", "true").options(**CSV).csv(f"{path}/rows")
    elif form == "json":
        writer.option("ignoreNullFields", "false").json(f"{path}/rows")
    else:
        raise ValueError(f"unknown export form: {form!r}")
    about = [(exported_at, counted.get["row_count"], json.dumps(query, sort_keys=True))]
    base.sparkSession.createDataFrame(about, "exported_at string, row_count bigint, query string").write.mode("overwrite").json(f"{path}/query")


def write_export_file(base: DataFrame, path: str, query: dict, exported_at: str) -> None:
    """One CSV in sections: all files below `path`, put together in the order of their names, are the export.

    Section 1 holds the rows in the order of `base`, written by all tasks; section 0 the
    lines that tell time, number of rows and query, and the header where there are rows.
    The number is counted while the rows are written, so section 0 comes last, and an export
    without it is not finished.
    """
    spark, counted = base.sparkSession, Observation()
    rows = export_rows(base).observe(counted, F.count(F.lit(1)).alias("row_count"))
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section=0")
    lines = rows.select(F.to_csv(F.struct(*EXPORT_COLUMNS), CSV).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/section=1")
    count = counted.get["row_count"]
    head = [f"# Exported at: {exported_at}", f"# Rows: {count}", f"# Query: {json.dumps(query, sort_keys=True)}"]
    head += [",".join(EXPORT_COLUMNS)] if count else []
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section=0")


def read_export(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Rows of an export in CSV: a folder whose files begin with a header each, or section 1 of one written in sections.

    Nothing between commas is null, two quotes are an empty text.
    """
    schema = ", ".join(f"{name} string" for name in EXPORT_COLUMNS)
    return spark.read.schema(schema).options(**CSV, nullValue="\0", multiLine="true", header=str(header).lower()).csv(path)


def append_usage(calls: DataFrame, path: str, batch: str | None = None) -> None:
    """Append priced calls to the usage log; a batch that is written again replaces itself."""
    priced = price_calls(calls)
    if batch is None:
        priced.write.mode("append").parquet(path)
    else:
        priced.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_extractions(extractions: DataFrame, path: str) -> None:
    """Extractions split by is_current, so that scans of current rows skip the others.

    Typed columns and lexemes are stored with them: filters on them reach the reader, and
    texts are stemmed once, here.
    """
    rows = promote(extractions) if "fields" in extractions.columns else extractions
    if "raw_text" in rows.columns and "lexemes" not in rows.columns:
        rows = rows.withColumn("lexemes", lexemes(F.col("raw_text")))
    # Two folders, and one for rows without the flag: wide rows need no sort to be told apart.
    with open_writers(rows.sparkSession, 3):
        rows.write.mode("overwrite").partitionBy("is_current").parquet(path)


def read_extractions(spark: SparkSession, path: str, schema: StructType = STORED_EXTRACTIONS) -> DataFrame:
    """Extractions written above; the declared type makes is_current a flag, not text."""
    return spark.read.schema(schema).parquet(path)
