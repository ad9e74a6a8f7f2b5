"""Access to and construction of the extracted-field map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.amounts import amount
from ledgerwright.functions.dates import iso_date, parse_period
from ledgerwright.schema import FIELD
from ledgerwright.session import materialised


def field_value(name: str, fields: str = "fields") -> Column:
    """Text value of a field of the map."""
    return F.col(fields)[name]["value"]


def field_start(name: str, fields: str = "fields") -> Column:
    """First day of a date field; null where the text was not readable."""
    return iso_date(F.col(fields)[name]["iso_from"])


def field_values(fields: str = "fields") -> Column:
    """Field map without its wrappers: name -> text value."""
    return F.transform_values(F.col(fields), lambda _, f: f["value"])


def header_columns(fields: str = "fields") -> dict[str, Column]:
    return {name: field_value(name, fields) for name in fixed.HEADER_FIELDS}


# Typed columns kept next to the map so that filters reach the Parquet reader.
TYPED_COLUMNS = {
    "vendor_text": lambda: field_value("vendor_name"),
    "currency": lambda: field_value("currency"),
    "total_amount": lambda: amount(field_value("total")),
    "subtotal_amount": lambda: amount(field_value("subtotal")),
    "tax_amount": lambda: amount(field_value("tax")),
    "period_start": lambda: field_start("invoice_date"),
}


def promote(extractions: DataFrame, *names: str) -> DataFrame:
    """Add the named typed columns, or all; stored ones are left alone."""
    have = set(extractions.columns)
    return extractions.withColumns(
        {name: TYPED_COLUMNS[name]() for name in names or TYPED_COLUMNS if name not in have}
    )


def build_fields(
    values: dict[str, Column],
    scores: dict[str, Column],
    tier_sources: Column,
    text_boxes: Column,
    image_boxes: Column,
    from_image: Column,
) -> Column:
    """Field map of an extraction from its parts.

    A box read from the image wins over one matched in the page words; the date field
    also gets the first and last day of its period.
    """
    period = parse_period(values["invoice_date"])
    null = F.lit(None).cast("string")
    entries = []
    for name in fixed.HEADER_FIELDS:
        dated = name == "invoice_date"
        source = F.when(from_image, fixed.IMAGE_SOURCE).otherwise(
            F.concat(
                F.lit(fixed.TEXT_SOURCE_PREFIX),
                F.coalesce(F.try_element_at(tier_sources, F.lit(name)), F.lit(fixed.TIER_NAMES[0])),
            )
        )
        made = F.struct(
            values[name].cast("string").alias("value"),
            F.coalesce(
                F.try_element_at(image_boxes, F.lit(name)), F.try_element_at(text_boxes, F.lit(name))
            ).alias("bbox"),
            F.lit(0).alias("page"),
            F.coalesce(scores[name], F.lit(0.0)).alias("confidence"),
            source.alias("source"),
            (period["iso_from"] if dated else null).alias("iso_from"),
            (period["iso_to"] if dated else null).alias("iso_to"),
        )
        entries += [F.lit(name), made.cast(FIELD)]
    return F.create_map(*entries)


def raw_text(fields: Column, items: Column, tax_rows: Column) -> Column:
    """Searchable text: field values, item descriptions, tax jurisdictions, blanks skipped."""
    known = F.filter(
        F.transform(F.map_values(fields), lambda f: f["value"]), lambda v: v.isNotNull()
    )
    filled = lambda rows, member: F.filter(
        F.transform(rows, lambda r: r[member]), lambda v: v.isNotNull() & (v != "")
    )
    nothing = F.array().cast("array<string>")
    parts = [
        F.coalesce(x, nothing)
        for x in (known, filled(items, "description"), filled(tax_rows, "jurisdiction"))
    ]
    return F.array_join(F.concat(*parts), " ")


def display_state(status: Column, state: Column) -> Column:
    return F.when(status == fixed.UNPROCESSABLE, status).otherwise(
        F.coalesce(state, F.lit(fixed.NEEDS_REVIEW))
    )


def with_periods(extractions: DataFrame) -> DataFrame:
    """Re-derive the period of each stored date field; `period_action` says what came of it.

    Actions: updated, already_set, unparseable, or null where there is no date field.
    """
    old = F.col("fields")["invoice_date"]
    staged = extractions.withColumns({"__old": old, "__new": parse_period(old["value"])})
    same = F.col("__new.iso_from").eqNullSafe(F.col("__old.iso_from")) & F.col(
        "__new.iso_to"
    ).eqNullSafe(F.col("__old.iso_to"))
    unreadable = F.col("__new.iso_from").isNull() & same
    action = (
        F.when(F.col("__old").isNull(), None)
        .when(unreadable, "unparseable")
        .when(same, "already_set")
        .otherwise("updated")
    )
    renewed = F.transform_values(
        "fields",
        lambda k, f: F.when(
            k == "invoice_date",
            f.withField("iso_from", F.col("__new.iso_from")).withField(
                "iso_to", F.col("__new.iso_to")
            ),
        ).otherwise(f),
    )
    return (
        staged.withColumn("period_action", action)
        .withColumn("fields", F.when(action == "updated", renewed).otherwise(F.col("fields")))
        .drop("__old", "__new")
    )


def period_counts(with_actions: DataFrame) -> DataFrame:
    return with_actions.agg(
        F.count("*").alias("seen"),
        *[
            F.count_if(F.col("period_action") == name).alias(name)
            for name in ("updated", "already_set", "unparseable")
        ],
    )


def overlay_corrections(extractions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace corrected values; corrections are (invoice_id, field, value, corrected_at).

    The latest correction of a field counts. It gets confidence 1 and the manual source;
    a field that was not extracted gets no box and page 0.
    """
    latest = corrections.groupBy("invoice_id", "field").agg(
        F.max_by("value", F.struct("corrected_at", "value")).alias("value")
    )
    # At most one entry per field name, so the collected list is short.
    maps = latest.groupBy("invoice_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__fix")
    )
    none = F.create_map().cast("map<string,string>")
    joined = extractions.join(maps, "invoice_id", "left").withColumn(
        "__fix", F.coalesce("__fix", none)
    )

    def merge(_, old: Column, new: Column) -> Column:
        made = F.struct(
            new.alias("value"), old["bbox"].alias("bbox"),
            F.coalesce(old["page"], F.lit(0)).alias("page"), F.lit(1.0).alias("confidence"),
            F.lit(fixed.CORRECTION_SOURCE).alias("source"),
            old["iso_from"].alias("iso_from"), old["iso_to"].alias("iso_to"),
        ).cast(FIELD)
        return F.when(new.isNotNull(), made).otherwise(old)

    return joined.withColumn("fields", F.map_zip_with("fields", "__fix", merge)).drop("__fix")


def located_fields(extractions: DataFrame) -> DataFrame:
    """(invoice_id, field, bbox) of the fields that have a box."""
    boxed = F.filter(F.map_entries("fields"), lambda e: e["value"]["bbox"].isNotNull())
    return extractions.select("invoice_id", F.explode(boxed).alias("e")).select(
        "invoice_id", F.col("e.key").alias("field"), F.col("e.value.bbox").alias("bbox")
    )


def field_diff(pairs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Seven fields of two invoices side by side; pairs are (invoice_id, against_id).

    The values are taken from the maps once and written, as both sides of the comparison read them.
    """
    from ledgerwright.functions.amounts import values_match

    order = ("vendor_name", "invoice_number", "invoice_date", "subtotal", "tax", "total", "currency")
    found = [F.try_element_at("fields", F.lit(f))["value"].alias(f"v{i}") for i, f in enumerate(order)]
    values = materialised(extractions.select("invoice_id", *found), "values")
    side = lambda key, mark: values.select(F.col("invoice_id").alias(key), *[F.col(f"v{i}").alias(f"{mark}{i}") for i in range(len(order))])
    both = pairs.join(side("invoice_id", "__c"), "invoice_id").join(side("against_id", "__o"), "against_id")
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"__o{i}").alias("original_value"), F.col(f"__c{i}").alias("current_value"))
        for i, f in enumerate(order)
    ])
    told = both.select("invoice_id", "against_id", F.inline(rows))
    match = lambda f: values_match(F.col("original_value"), F.col("current_value"), f)
    # One comparison for each kind of field, behind the rows, stays small enough to be compiled.
    return told.withColumn("matches", F.when(F.col("field").isin(*fixed.AMOUNT_FIELDS), match("total")).otherwise(match("vendor_name")))
