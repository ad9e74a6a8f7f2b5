"""Vendor resolution and the running statistics of confirmed totals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions.amounts import MONEY
from ledgerwright.functions.text import display_name, normalize_name
from ledgerwright.operators.ordered import running_totals, time_buckets


def resolve_vendors(
    documents: DataFrame, vendors: DataFrame, ts: str = "uploaded_at", order_id: str = "invoice_id"
) -> tuple[DataFrame, DataFrame]:
    """(documents with vendor_id, all vendors): match on the normalised name, else create.

    The first spelling seen of a new name becomes its display name. Ids of new vendors are
    a hash of the normalised name, so a re-run task makes the same id.
    """
    named = documents.withColumn(
        "__name", F.coalesce(F.nullif(F.col("vendor_name"), F.lit("")), F.lit("Unknown"))
    ).withColumn("normalized_name", normalize_name(F.col("__name")))
    first = named.groupBy("normalized_name").agg(
        F.min_by("__name", F.struct(ts, order_id, "__name")).alias("__name"),
        F.min(ts).alias("first_seen_at"),
    )
    new = first.join(vendors.select("normalized_name"), "normalized_name", "left_anti").select(
        F.substring(F.sha2("normalized_name", 256), 1, 32).alias("vendor_id"),
        display_name(F.col("__name")).alias("name"),
        "normalized_name", "first_seen_at",
    )
    known = vendors.unionByName(new, allowMissingColumns=True)
    # Names are not guaranteed unique, so one id is chosen per name before the join back.
    keys = known.groupBy("normalized_name").agg(F.min("vendor_id").alias("vendor_id"))
    placed = named.drop("vendor_id").join(keys, "normalized_name", "left")
    return placed.drop("__name", "normalized_name"), known


def moments(x: Column) -> dict[str, Column]:
    """Count, sum and sum of squares in decimals, which add up the same in any order."""
    known = x.isNotNull()
    return {
        "n": F.when(known, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")),
        "s1": x.cast("decimal(28,4)"),
        "s2": (x * x).cast("decimal(36,8)"),
    }


def mean_and_std(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from the sums; the deviation of a single row is 0."""
    mean = F.try_divide(s1.cast("double"), n.cast("double"))
    # n*s2 - s1^2 stays in decimals: a vendor with equal totals gets exactly 0.
    top = n.cast("decimal(18,0)") * s2.cast("decimal(38,8)") - (
        s1.cast("decimal(28,4)") * s1.cast("decimal(28,4)")
    )
    var = F.try_divide(top.cast("double"), (n * (n - 1)).cast("double"))
    return mean, F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0))


def vendor_stats(totals: DataFrame, key: str = "vendor_id", x: str = "total") -> DataFrame:
    """(key, n, avg, std) of confirmed totals; null totals do not count."""
    known = totals.where(F.col(x).isNotNull())
    return known.groupBy(key).agg(
        F.count(x).alias("n"),
        F.avg(F.col(x).cast("double")).alias("avg"),
        F.coalesce(F.stddev_samp(F.col(x).cast("double")), F.lit(0.0)).alias("std"),
    )


def point_in_time_stats(
    rows: DataFrame,
    confirmed: Column,
    key: str = "vendor_id",
    ts: str = "uploaded_at",
    order_id: str = "invoice_id",
    x: str = "total",
    units: tuple[str, ...] = ("day", "hour"),
) -> DataFrame:
    """`rows` plus (n, avg, std) over the vendor's confirmed totals strictly earlier in (ts, id)."""
    value = F.when(confirmed, F.col(x).cast(MONEY))
    parts = moments(value)
    summed = running_totals(
        rows, [key], time_buckets(ts, *units), [ts, order_id],
        {f"__{k}": v for k, v in parts.items()},
    )
    mean, std = mean_and_std(F.col("__n"), F.col("__s1"), F.col("__s2"))
    return summed.withColumns({"n": F.col("__n"), "avg": mean, "std": std}).drop(
        "__n", "__s1", "__s2"
    )


FOLD_SCHEMA = "{key} {kind}, n bigint, avg double, std double, m2 double"


def step(n: int, mean: float, m2: float, x: float) -> tuple[int, float, float, float]:
    """Add one total: the mean kept is rounded to 4 places and feeds the next step."""
    n += 1
    exact = mean + (x - mean) / n
    m2 += (x - mean) * (x - exact)
    std = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
    return n, round(exact, 4), round(std, 4), m2


def fold_confirms(
    state: DataFrame | None,
    confirms: DataFrame,
    key: str = "vendor_id",
    ts: str = "uploaded_at",
    order_id: str = "invoice_id",
    x: str = "total",
) -> DataFrame:
    """Advance the exact statistics (n, avg, std, m2) by one increment of confirmed totals.

    Rounding at each step makes this fold order-bound: it has no partial form, so a key's
    new rows pass one task in order. Rows stream through with a state of four numbers and
    are never gathered, and what was folded before comes in as `state`, so the work is the
    size of the increment. `vendor_stats` is the form to use on whole tables.
    """
    kind = confirms.schema[key].dataType.simpleString()
    events = confirms.where(F.col(x).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key), F.col(ts).cast("timestamp").alias("__ts"), F.col(order_id).cast("string").alias("__id"),
        F.col(x).cast("double").alias("__x"), F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("double").alias("avg"), F.lit(None).cast("double").alias("std"),
        F.lit(None).cast("double").alias("m2"),
    )
    if state is not None:
        nothing = {"__ts": "timestamp", "__id": "string", "__x": "double"}
        events = events.unionByName(
            state.select(
                key, *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
                "n", "avg", "std", "m2",
            )
        )
    # The state row has no time, and nulls sort first, so it leads its key.
    ordered = events.repartition(key).sortWithinPartitions(key, "__ts", F.length("__id"), "__id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, acc, out = None, (0, 0.0, 0.0, 0.0), []
        for batch in batches:
            for k, xv, n, avg, std, m2 in zip(
                batch[key], batch["__x"], batch["n"], batch["avg"], batch["std"], batch["m2"]
            ):
                if k != current:
                    if current is not None:
                        out.append((current, *acc))
                    current, acc = k, (0, 0.0, 0.0, 0.0)
                if n == n and n is not None:
                    acc = (int(n), float(avg), float(std), float(m2))
                else:
                    acc = step(acc[0], acc[1], acc[3], float(xv))
            if out:
                yield pd.DataFrame(out, columns=[key, "n", "avg", "std", "m2"])
                out = []
        if current is not None:
            yield pd.DataFrame([(current, *acc)], columns=[key, "n", "avg", "std", "m2"])

    return ordered.mapInPandas(fold, FOLD_SCHEMA.format(key=key, kind=kind))
