"""Outlier detection, the anomaly listing, and acknowledgement of anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.amounts import MONEY, finite, round_exact
from ledgerwright.functions.sqltext import apply
from ledgerwright.functions.wording import explanation, headline, severity
from ledgerwright.operators.fields import promote
from ledgerwright.operators.ordered import newest_n
from ledgerwright.schema import REASON

SUBTYPE, FIELD_NAME = "amount", "total"


def reason(kind: str, **members: Column) -> Column:
    """A reason of one type; members that are not given stay null."""
    given = F.struct(*[value.alias(name) for name, value in members.items()])
    body = ", ".join(
        f"'{f.name}', CAST({'m.' + f.name if f.name in members else 'NULL'} AS {f.dataType.simpleString()})"
        for f in REASON.fields if f.name != "type"
    )
    return apply(f"named_struct('type', '{kind}', {body})", given, "m")


def outlier_z(total: Column, n: Column, mean: Column, std: Column) -> Column:
    """Distance from the vendor's mean in deviations, where it makes the total an outlier."""
    z = F.try_divide(F.abs(total - mean), std)
    return F.when((n >= fixed.MIN_HISTORY) & (std > 0) & (z >= fixed.OUTLIER_Z), z)


# Acked values within 10 % of v are those in (v/1.1, v/0.9), an interval whose logarithm
# is 0.2007 wide. Buckets of width 0.2 are narrower, so the interval never lies inside one
# bucket: the smallest and the largest acked value of each bucket decide membership.
_WIDTH = 0.2
_LOW, _HIGH = 1 + fixed.ACK_FRACTION, 1 - fixed.ACK_FRACTION


def ack_ranges(acked: DataFrame, key: str = "vendor_id") -> DataFrame:
    """Acked values (key, value) folded to the least and greatest per logarithmic bucket."""
    bucket = F.floor(F.ln("value") / _WIDTH)
    return acked.where(F.col("value") > 0).groupBy(key, bucket.alias("bucket")).agg(
        F.min("value").alias("least"), F.max("value").alias("greatest")
    )


def ack_map(acked: DataFrame, key: str = "vendor_id") -> DataFrame:
    """(key, acked): per vendor the least and greatest acked value of each logarithmic bucket.

    A map has an entry per bucket, not per value: amounts of 38 digits span some 440 buckets.
    """
    entries = F.collect_list(F.struct("bucket", F.struct("least", "greatest").alias("ends")))
    return ack_ranges(acked, key).groupBy(key).agg(F.map_from_entries(entries).alias("acked"))


def within_acked(value: Column, acked: Column) -> Column:
    """Is the value within 10 % of one in the vendor's `ack_map`? False without one."""
    x = value.cast("double")
    near = lambda a: F.abs(x - a) / a < fixed.ACK_FRACTION
    buckets = F.sequence(F.floor((F.ln(x / _LOW) - 1e-9) / _WIDTH), F.floor((F.ln(x / _HIGH) + 1e-9) / _WIDTH))
    ends = F.transform(buckets, lambda b: F.try_element_at(acked, b))
    hit = F.exists(ends, lambda e: F.coalesce(near(e["least"]) | near(e["greatest"]), F.lit(False)))
    return F.when(acked.isNotNull() & (x > 0), hit).otherwise(F.lit(False))


def drop_acked(
    outliers: DataFrame, acked: DataFrame, key: str = "vendor_id", x: str = "total",
    id_col: str = "invoice_id",
) -> DataFrame:
    """Outliers whose value is not within 10 % of a value acked before for the same vendor.

    An equality join on (vendor, bucket) with at most three buckets per outlier; the acked
    values themselves are never paired with the outliers.
    """
    value = F.col(x).cast("double")
    spread = F.sequence(
        F.floor((F.ln(value / _LOW) - 1e-9) / _WIDTH), F.floor((F.ln(value / _HIGH) + 1e-9) / _WIDTH)
    )
    probes = outliers.where(value > 0).select(
        F.col(id_col), F.col(key), value.alias("__v"), F.explode(spread).alias("bucket")
    )
    near = lambda a: F.abs(F.col("__v") - F.col(a)) / F.col(a) < fixed.ACK_FRACTION
    known = (
        probes.join(ack_ranges(acked, key), [key, "bucket"])
        .where(near("least") | near("greatest"))
        .select(id_col).distinct()
    )
    return outliers.join(known, id_col, "left_anti")


def detect_anomalies(
    rows: DataFrame, acked: DataFrame | None = None, key: str = "vendor_id"
) -> DataFrame:
    """(invoice_id, anomaly) for totals three or more deviations off.

    `rows` carries invoice_id, the vendor key, total, and the vendor's n, avg and std.
    """
    z = outlier_z(finite(F.col("total")), F.col("n"), F.col("avg"), F.col("std"))
    found = rows.withColumn("__z", z).where(F.col("__z").isNotNull())
    if acked is not None:
        found = drop_acked(found, acked, key)
    return found.select(
        "invoice_id",
        reason(
            "anomaly", field=F.lit(FIELD_NAME), vendor_mean=F.col("avg"),
            vendor_std=F.col("std"), z_score=round_exact(F.col("__z"), 2),
        ).alias("anomaly"),
    )


def vendor_history(base: DataFrame, limit: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """(vendor_id, recent): the newest limit+1 confirmed invoices of each vendor, newest first.

    One more than needed is kept, so that any single invoice can be left out later.
    """
    confirmed = promote(base, "total_amount").where(
        (F.col("review_status") == fixed.CONFIRMED) & F.col("vendor_id").isNotNull()
    ).select("vendor_id", "invoice_id", "uploaded_at", F.col("total_amount").cast("double").alias("total"))
    top = newest_n(
        confirmed, ["vendor_id"], [F.desc("uploaded_at"), F.asc("invoice_id")], limit + 1
    )
    return top.groupBy("vendor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "invoice_id", "total"))).alias("recent")
    )


def prior_values(recent: Column, invoice_id: Column, limit: int = fixed.HISTORY_LIMIT) -> Column:
    """Values of the newest `limit` other invoices, newest first; the limit comes before
    totals that are no numbers are dropped."""
    others = F.slice(F.filter(recent, lambda h: h["invoice_id"] != invoice_id), 1, limit)
    numbers = F.transform(others, lambda h: h["total"])
    return F.coalesce(
        F.filter(numbers, lambda v: v.isNotNull()), F.array().cast("array<double>")
    )


def anomaly_id(invoice_id: Column) -> Column:
    return F.concat_ws(":", invoice_id, F.lit(SUBTYPE), F.lit(FIELD_NAME))


def parse_anomaly_id(text: Column) -> Column:
    """Struct (invoice_id, subtype, field, error); error is null for a well-formed id.

    Ids without dashes or in capitals come out in the usual form.
    """
    parts = F.split(text, ":", 3)
    quoted = F.concat(F.lit("'"), text, F.lit("'"))
    uuid = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
    get = lambda i: F.get(parts, F.lit(i))
    grouped = F.regexp_replace(F.replace(F.lower(get(0)), F.lit("-")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    error = (
        F.when(F.size(parts) != 3, F.concat(F.lit("malformed anomaly id: "), quoted))
        .when(~get(0).rlike(uuid), F.concat(F.lit("invalid invoice id in anomaly id: "), quoted))
        .when(
            get(1) != SUBTYPE,
            F.concat(F.lit("unsupported anomaly subtype: '"), get(1), F.lit("'")),
        )
    )
    return F.struct(
        F.when(get(0).rlike(uuid), grouped).otherwise(get(0)).alias("invoice_id"), get(1).alias("subtype"), get(2).alias("field"),
        error.alias("error"),
    )


def list_anomalies(base: DataFrame, acks: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row per stored amount anomaly of an invoice with a vendor, with texts and history.

    `base` is the joined relation of invoices, current extractions and vendors.
    """
    flagged = promote(base, "total_amount", "currency").where(F.col("vendor_id").isNotNull()).select(
        "invoice_id", "vendor_id", "uploaded_at", F.col("vendor_table_name").alias("vendor"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("value"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")).alias("currency"),
        F.explode("reasons").alias("r"),
    ).where((F.col("r.type") == "anomaly") & (F.col("r.field") == FIELD_NAME))
    keyed_acks = acks.where((F.col("subtype") == SUBTYPE) & (F.col("field") == FIELD_NAME)).select(
        "invoice_id", "acknowledged_at", "user_id", F.lit(True).alias("__acked")
    )
    rows = flagged.join(keyed_acks, "invoice_id", "left").join(
        vendor_history(base), "vendor_id", "left"
    )
    if users is not None:
        rows = rows.join(users.select("user_id", F.col("email").alias("acknowledged_by")), "user_id", "left")
    else:
        rows = rows.withColumn("acknowledged_by", F.lit(None).cast("string"))
    rows = rows.withColumns({
        "prior": prior_values(F.col("recent"), F.col("invoice_id")),
        "z_score": F.coalesce(F.col("r.z_score"), F.lit(0.0)),
        "mean": F.coalesce(F.col("r.vendor_mean"), F.lit(0.0)),
    })
    point = lambda v, now: F.struct(v.alias("value"), F.lit(now).alias("current"))
    return rows.select(
        anomaly_id(F.col("invoice_id")).alias("id"),
        F.lit(SUBTYPE).alias("type"),
        F.when(F.col("__acked"), "acknowledged").otherwise("unreviewed").alias("status"),
        "vendor", "vendor_id", "invoice_id", F.col("uploaded_at").alias("detected_at"),
        headline(F.col("value"), F.col("currency")).alias("headline"),
        explanation(F.col("value"), F.col("mean"), F.col("currency"), F.size("prior")).alias("sub"),
        "z_score", severity(F.col("z_score")).alias("severity"), "value", "currency",
        F.concat(
            F.transform(F.reverse("prior"), lambda v: point(v, False)),
            F.array(point(F.col("value"), True)),
        ).alias("history"),
        "mean", "acknowledged_at", "acknowledged_by",
    )


def by_newest(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(F.desc("detected_at"), F.asc("id"))


def tab_conditions() -> dict[str, Column]:
    unreviewed = F.col("status") == "unreviewed"
    return {
        "all": F.lit(True),
        "unreviewed": unreviewed,
        "acknowledged": F.col("status") == "acknowledged",
        "amount": unreviewed & (F.col("type") == SUBTYPE),
    }


def anomaly_tab(anomalies: DataFrame, tab: str) -> DataFrame:
    """Rows of one tab; an unknown tab is empty."""
    return anomalies.where(tab_conditions().get(tab, F.lit(False)))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    unreviewed = F.col("status") == "unreviewed"
    zero = F.lit(0).cast("bigint")
    return anomalies.agg(
        F.count("*").alias("all"),
        F.count_if(unreviewed).alias("unreviewed"),
        F.count_if(unreviewed & (F.col("type") == SUBTYPE)).alias("amount"),
        F.count_if(F.col("status") == "acknowledged").alias("acknowledged"),
    ).withColumns({"frequency": zero, "pattern": zero})


def anomaly_aggregates(anomalies: DataFrame) -> DataFrame:
    """Dominant currency and its sum, vendors touched and the strongest outlier, unreviewed only."""
    open_rows = anomalies.where(F.col("status") == "unreviewed")
    # Few currencies remain after the first step, each with its own best outlier.
    per_currency = open_rows.groupBy("currency").agg(
        F.sum(F.col("value").cast(MONEY)).alias("amount"),
        # Of equally strong outliers the newest.
        F.max(F.struct("z_score", F.unix_micros("detected_at").alias("t"), "id")).alias("top"),
        F.max_by("vendor", F.struct("z_score", F.unix_micros("detected_at"), "id")).alias("v"),
    )
    best = per_currency.agg(
        F.min_by(
            F.struct("currency", "amount"), F.struct((-F.col("amount")).alias("a"), F.col("currency"))
        ).alias("dominant"),
        F.max("top").alias("top"),
        F.max_by("v", "top").alias("vendor"),
    )
    vendors = open_rows.agg(F.countDistinct("vendor").alias("vendors_affected"))
    # Both sides are single-row aggregates.
    return best.crossJoin(vendors).select(
        F.coalesce(F.round(F.col("dominant.amount").cast("double"), 2), F.lit(0.0)).alias("total_flagged_amount"),
        F.coalesce(F.col("dominant.currency"), F.lit("USD")).alias("total_flagged_currency"),
        "vendors_affected",
        F.col("top.z_score").alias("highest_severity_z"),
        F.col("vendor").alias("highest_severity_vendor"),
    )


# --- acknowledgement ------------------------------------------------------

def check_requests(requests: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Requests (id, requested_at, user_id, notes) with the anomaly they name and an error text.

    error is null for one that can be acknowledged, the parse message for a bad id, and
    `not_found` where no current anomaly has that id.
    """
    parsed = requests.withColumn("p", parse_anomaly_id(F.col("id")))
    known = anomalies.select(
        F.col("id").alias("__id"), F.col("value").alias("__value"), "vendor_id"
    )
    full = F.lower(F.concat_ws(":", "p.invoice_id", "p.subtype", "p.field"))
    return parsed.join(known, full == F.col("__id"), "left").select(
        "id", "requested_at", "user_id", "notes",
        F.col("p.invoice_id").alias("invoice_id"), F.col("p.subtype").alias("subtype"),
        F.col("p.field").alias("field"), F.col("__value").alias("value"), "vendor_id",
        F.coalesce(F.col("p.error"), F.when(F.col("__id").isNull(), "not_found")).alias("error"),
    )


def acknowledge(acks: DataFrame, checked: DataFrame) -> DataFrame:
    """All acks after the accepted requests; the first ack of a key stays."""
    new = checked.where(F.col("error").isNull()).select(
        "invoice_id", "subtype", "field", F.col("requested_at").alias("acknowledged_at"),
        "user_id", "notes", F.lit(1).alias("__new"),
    )
    both = acks.select(
        "invoice_id", "subtype", "field", "acknowledged_at", "user_id", "notes", F.lit(0).alias("__new")
    ).unionByName(new)
    keys = ["invoice_id", "subtype", "field"]
    kept = both.groupBy(*keys).agg(
        F.min(F.struct("__new", "acknowledged_at", "user_id", "notes")).alias("a")
    )
    return kept.select(*keys, "a.acknowledged_at", "a.user_id", "a.notes")


def failed_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).select("id", "error")


def append_outliers(outliers: DataFrame, checked: DataFrame) -> DataFrame:
    """Acked values (vendor_id, field, value, acked_at, invoice_id), near-equal ones kept once.

    Values within 1e-6 count as the same; the earliest is kept. Values sit in cells of
    1e-6, and only neighbouring cells can clash, so a value is compared with the earliest
    row of its own and of the two adjoining cells. Cells are numbered by doubles: where
    those lie further apart than a cell, so do the values.
    """
    new = checked.where(F.col("error").isNull()).select(
        "vendor_id", "field", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.col("requested_at").alias("acked_at"), "invoice_id",
    )
    keys = ["vendor_id", "field", "cell"]
    both = outliers.select(*new.columns).unionByName(new).withColumn(
        "cell", F.round(F.col("value") / 1e-6 - 0.5)
    )
    firsts = both.groupBy(*keys).agg(
        F.min(F.struct("acked_at", "invoice_id", "value")).alias("f")
    )
    near = firsts.select(
        "vendor_id", "field", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"),
        F.col("f").alias("g"),
    )
    clash = (
        firsts.join(near, keys)
        .where((F.col("g") < F.col("f")) & (F.abs(F.col("g.value") - F.col("f.value")) < 1e-6))
        .select(*keys).distinct()
    )
    return firsts.join(clash, keys, "left_anti").select(
        "vendor_id", "field", "f.value", "f.acked_at", "f.invoice_id"
    )
