"""Ingest of documents, annotations, OCR text and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright import fixed
from ledgerwright.functions.text import fingerprint, strip

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])
ANNOTATION = T.StructType([
    T.StructField("field_extractions", T.ArrayType(T.StructType([
        T.StructField("fieldtype", T.StringType()), T.StructField("text", T.StringType()),
    ]))),
])
OCR = T.StructType([
    T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
    ]))),
])
GROUND_TRUTH = T.StructType([
    T.StructField("invoice_id", T.StringType()),
    T.StructField("case", T.StructType([
        T.StructField("label", T.StringType()), T.StructField("body", T.StringType()),
        T.StructField("expected_vendor", T.StringType()),
        T.StructField("expected_total", T.DoubleType()),
        T.StructField("expected_triage_state", T.StringType()),
        T.StructField("expected_reason_types", T.ArrayType(T.StringType())),
        T.StructField("confirm", T.BooleanType()), T.StructField("unprocessable", T.BooleanType()),
        T.StructField("marker_key", T.StringType()),
    ])),
])


def address_content(files: DataFrame) -> DataFrame:
    """Files with file_hash and storage_key, both named by the content."""
    hashed = files.withColumn("file_hash", fingerprint(F.col("content")))
    return hashed.withColumn("storage_key", F.concat("file_hash", F.lit(".pdf")))


def read_documents(
    spark: SparkSession, path: str, glob: str = "*.pdf", keep_content: bool = False
) -> DataFrame:
    """Binary files below a path, addressed by content.

    The bytes are dropped once they are hashed, so that later shuffles move paths and
    hashes only; `keep_content` keeps them.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
    )
    addressed = address_content(files)
    return addressed if keep_content else addressed.drop("content")


def drop_known(
    incoming: DataFrame, extracted: DataFrame, order: tuple[str, ...] = ("modificationTime", "path")
) -> DataFrame:
    """One row per content, first in `order`, whose hash has no current extraction yet.

    `extracted` holds the file_hash of invoices that have one.
    """
    rest = [c for c in incoming.columns if c != "file_hash"]
    first = incoming.groupBy("file_hash").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    )
    known = extracted.select("file_hash").distinct()
    return (
        first.join(known, "file_hash", "left_anti")
        .select("file_hash", *[F.col(f"r.{c}").alias(c) for c in rest])
        .select(*incoming.columns)
    )


def _doc_id() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)


def annotation_rows(annotations: DataFrame) -> DataFrame:
    """(doc_id, field, text): the first annotation of each mapped field of a document.

    The first ones are picked inside the array, so a document is one narrow row, and the rows are shuffled before they
    are sorted for the aggregation, which puts documents together that come in several rows.
    """
    have, texts = F.col("field_extractions.fieldtype"), F.col("field_extractions.text")
    places = [F.nullif(F.array_position(have, kind), F.lit(0)) for kind in fixed.ANNOTATION_FIELDS]
    names = list(fixed.ANNOTATION_FIELDS.values())
    first = {f: [p for p, name in zip(places, names) if name == f] for f in names}
    rows = annotations.select("doc_id", *[(p[0] if len(p) == 1 else F.least(*p)).alias(f"p{n}") for n, p in enumerate(first.values())], texts.alias("texts"))
    # A place is null where the document has no such annotation, and its text then stays out.
    rows = rows.select("doc_id", *[F.col(f"p{n}") for n in range(len(first))], *[
        F.when(F.col(f"p{n}").isNotNull(), F.coalesce(F.get("texts", F.col(f"p{n}").cast("int") - 1), F.lit(""))).alias(f"f{n}") for n in range(len(first))
    ])
    firsts = rows.repartition("doc_id").groupBy("doc_id").agg(*[
        F.min_by(f"f{n}", f"p{n}").alias(f"f{n}") for n in range(len(first))
    ])
    told = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{n}").alias("text")) for n, f in enumerate(first)])
    return firsts.select("doc_id", F.inline(told)).where(F.col("text").isNotNull())


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ANNOTATION).option("multiLine", "true").json(path)
    return annotation_rows(raw.select(_doc_id().alias("doc_id"), "field_extractions"))


def ocr_text(pages: F.Column, max_chars: int | None = None) -> F.Column:
    """Trimmed non-empty block texts joined by blanks; cut with `...` where a length is given."""
    blocks = F.flatten(F.transform(pages, lambda p: F.transform(p["blocks"], lambda b: b["text"])))
    kept = F.filter(F.transform(blocks, strip), lambda t: F.coalesce(t != "", F.lit(False)))
    joined = F.array_join(kept, " ")
    if max_chars is None:
        return joined
    return F.when(
        F.length(joined) > max_chars, F.concat(F.substring(joined, 1, max_chars), F.lit("..."))
    ).otherwise(joined)


def read_ocr(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    raw = spark.read.schema(OCR).option("multiLine", "true").json(path)
    return raw.select(_doc_id().alias("doc_id"), ocr_text(F.col("pages"), max_chars).alias("text"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected results, one row per invoice."""
    raw = spark.read.schema(GROUND_TRUTH).option("multiLine", "true").json(path)
    return raw.select(
        "invoice_id", F.col("case.label").alias("label"),
        F.col("case.expected_vendor").alias("expected_vendor"),
        F.col("case.expected_total").alias("expected_total"),
        F.col("case.expected_triage_state").alias("expected_state"),
        F.col("case.expected_reason_types").alias("expected_reasons"),
        F.coalesce("case.unprocessable", F.lit(False)).alias("unprocessable"),
        F.coalesce("case.confirm", F.lit(False)).alias("confirm"),
    )


def seeded_sample(ids: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n ids without replacement, the same ones for the same seed: the first by md5 of `id:seed`."""
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))
    return ids.orderBy(key, id_col).limit(n)


def invoice_of_document(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Documents with the invoice whose file has the same content."""
    keyed = documents.withColumn("file_hash", fingerprint(F.col("content"))).drop("content")
    return keyed.join(invoices.select("file_hash", "invoice_id"), "file_hash", "left")
