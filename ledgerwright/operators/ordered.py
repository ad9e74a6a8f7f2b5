"""Ordered per-key work that does not put a whole key into one task.

A window over (key order by time) sends every row of a key to one task, which a key
holding a third of the data does not survive. Here each key is cut into consecutive
buckets of its order (day, hour, ...). Sums are taken per bucket with map-side combine,
carried forward over the few buckets, and only the rows of one bucket are ordered
together. Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_buckets(ts: str, *units: str) -> list[Column]:
    return [F.date_trunc(unit, F.col(ts)) for unit in units]


def _known(names: list[str]) -> Column:
    """Are all the named columns set?"""
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(name).isNotNull()
    return cond


def running_totals(
    df: DataFrame,
    keys: list[str],
    buckets: list[Column],
    order: list[str],
    measures: dict[str, Column],
) -> DataFrame:
    """`df` plus, for each measure, its sum over the key's rows strictly before the row.

    `buckets` go from coarse to fine and must grow with `order`. With no keys the order
    is global. Null measures count as zero, and a row without a key or time has nothing
    before it. The rows are shuffled once, by key and bucket, for the join and the window.
    """
    marks = [f"__b{i}" for i in range(len(buckets))]
    sums = list(measures)
    base = df.withColumns(
        {m: b for m, b in zip(marks, buckets)}
        | {f"__m_{s}": F.coalesce(measures[s], F.lit(0)) for s in sums}
    )
    fine = base.groupBy(*keys, *marks).agg(*[F.sum(f"__m_{s}").alias(f"__t_{s}") for s in sums])
    carried = None
    for depth in range(len(marks)):
        part = keys + marks[:depth]
        level = fine.groupBy(*part, marks[depth]).agg(
            *[F.sum(f"__t_{s}").alias(f"__t_{s}") for s in sums]
        )
        before = Window.partitionBy(*part).orderBy(marks[depth]).rowsBetween(
            Window.unboundedPreceding, -1
        )
        level = level.select(
            *part, marks[depth],
            *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__c_{s}") for s in sums],
        )
        if carried is not None:
            coarse = carried.withColumnsRenamed({f"__c_{s}": f"__o_{s}" for s in sums})
            level = level.join(coarse, part).select(
                *part, marks[depth],
                *[(F.col(f"__c_{s}") + F.col(f"__o_{s}")).alias(f"__c_{s}") for s in sums],
            )
        carried = level
    inside = Window.partitionBy(*keys, *marks).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = base.join(carried, keys + marks, "left")
    total = lambda s: F.col(f"__c_{s}") + F.coalesce(F.sum(f"__m_{s}").over(inside), F.lit(0))
    return joined.select(
        *df.columns,
        *[F.coalesce(F.when(_known(keys + marks), total(s)), F.lit(0)).alias(s) for s in sums],
    )


def previous_row(
    df: DataFrame, keys: list[str], buckets: list[Column], order: list[str], payload: list[str], name: str
) -> DataFrame:
    """`df` plus struct `name`: the payload of the key's row just before, null for its first
    and for rows without a key. `buckets` go from coarse to fine and must grow with `order`."""
    marks = [f"__b{i}" for i in range(len(buckets))]
    base = df.withColumns({m: b for m, b in zip(marks, buckets)} | {"__o": F.struct(*order), "__p": F.struct(*payload)})
    last = base.groupBy(*keys, *marks).agg(F.max_by("__p", "__o").alias("__l"), F.max("__o").alias("__m"))
    carried = None
    for depth, mark in enumerate(marks):
        part = keys + marks[:depth]
        level = last.groupBy(*part, mark).agg(F.max_by("__l", "__m").alias("__l"))
        level = level.select(*part, mark, F.lag("__l").over(Window.partitionBy(*part).orderBy(mark)).alias("__e"))
        if carried is not None:
            coarse = carried.withColumnRenamed("__e", "__c")
            level = level.join(coarse, part).select(*part, mark, F.coalesce("__e", "__c").alias("__e"))
        carried = level
    inside = Window.partitionBy(*keys, *marks).orderBy(*order)
    joined = base.join(carried, keys + marks, "left")
    found = F.coalesce(F.lag("__p").over(inside), F.col("__e"))
    return joined.select(*df.columns, F.when(_known(keys + marks), found).alias(name))


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key in `order`.

    The filter sits directly on row_number, so Spark keeps at most n rows per key and
    map task before the shuffle (window group limit).
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(over)).where(F.col(name) <= n)
