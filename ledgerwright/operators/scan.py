"""Current extractions and the joined base relation that queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_newest_current(extractions: DataFrame) -> DataFrame:
    """Set is_current on the newest extraction of each invoice and clear it on the others."""
    newest = extractions.groupBy("invoice_id").agg(
        F.max(F.struct("created_at", "extraction_id"))["extraction_id"].alias("extraction_id")
    ).withColumn("__n", F.lit(True))
    return (
        extractions.drop("is_current")
        .join(newest, ["invoice_id", "extraction_id"], "left")
        .withColumn("is_current", F.coalesce("__n", F.lit(False)))
        .drop("__n")
        .select(*extractions.columns)
    )


def promote_current(extractions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Make the chosen extractions (extraction_id) current and demote their siblings.

    Of several chosen extractions of one invoice the last promotion holds, by the column
    `promoted_at` of `chosen` where it has one, then by extraction_id.
    """
    when = F.col("promoted_at") if "promoted_at" in chosen.columns else F.lit(0)
    picked = chosen.groupBy("extraction_id").agg(F.max(when).alias("__at"))
    winner = extractions.select("extraction_id", "invoice_id").join(picked, "extraction_id").groupBy("invoice_id").agg(
        F.max(F.struct("__at", "extraction_id"))["extraction_id"].alias("__winner")
    )
    current = F.when(F.col("__winner").isNull(), F.col("is_current")).otherwise(F.col("extraction_id") == F.col("__winner"))
    return extractions.join(winner, "invoice_id", "left").withColumn("is_current", current).select(*extractions.columns)


def append_extractions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing plus new rows, the newest row of each invoice being current."""
    return mark_newest_current(existing.unionByName(new))


def current_extractions(extractions: DataFrame) -> DataFrame:
    return extractions.where("is_current")


def base_relation(invoices: DataFrame, extractions: DataFrame, vendors: DataFrame) -> DataFrame:
    """Invoice, its current extraction and, where known, its vendor.

    No broadcast is forced: Spark broadcasts a side whose size is below its threshold and
    otherwise sorts and merges, splitting skewed vendors at run time.
    """
    names = vendors.select("vendor_id", F.col("name").alias("vendor_table_name"))
    return invoices.join(current_extractions(extractions), "invoice_id").join(
        names, "vendor_id", "left"
    )


def invoices_with_current(invoices: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each invoice with its current extraction as a struct, null if it has none."""
    current = current_extractions(extractions)
    nested = current.select(
        "invoice_id", F.struct(*[c for c in current.columns if c != "invoice_id"]).alias("current")
    )
    return invoices.join(nested, "invoice_id", "left").withColumn(
        "duplicate_dismissals",
        F.coalesce("duplicate_dismissals", F.array().cast("array<string>")),
    )


def vendor_view(vendors: DataFrame) -> DataFrame:
    """Vendors with their statistics, zero where none are kept yet."""
    zero = lambda c, v: F.coalesce(F.col(f"stats.{c}"), F.lit(v)).alias(
        {"n": "total_seen", "avg": "avg_total", "std": "std_total"}[c]
    )
    return vendors.select(
        "vendor_id", "name", "tax_id", "normalized_name", "first_seen_at",
        zero("n", 0), zero("avg", 0.0), zero("std", 0.0),
    )


def vendor_of_invoice(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor of each invoice; invoices without one stay, with nulls."""
    return invoices.select("invoice_id", "vendor_id").join(vendor_view(vendors), "vendor_id", "left")


def newest_invoices(invoices: DataFrame, limit: int = 100) -> DataFrame:
    return invoices.orderBy(F.desc("uploaded_at"), F.asc("invoice_id")).limit(limit)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a number outside 1..last is clamped.

    Skipped rows are sorted and dropped, which suits the first pages. For deep paging use
    `page_after`, which filters on the last key seen.
    """
    last = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("n")
    number = max(1, number)
    if number > 1:
        number = min(number, df.agg(last).first()["n"])
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, id_col: str, last_seen: tuple | None, size: int) -> DataFrame:
    """The page behind the (key, id) last seen: keys descending, nulls last, ids ascending."""
    if last_seen is None:
        rows = df
    else:
        value, last_id = last_seen
        later = F.col(id_col) > F.lit(last_id)
        if value is None:
            rows = df.where(F.col(key).isNull() & later)
        else:
            rows = df.where((F.col(key) < F.lit(value)) | F.col(key).isNull() | ((F.col(key) == F.lit(value)) & later))
    return rows.orderBy(F.desc_nulls_last(key), F.asc(id_col)).limit(size)
