"""Stored pages: rows in ranges of their order, and a directory that says how many rows each range holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


class PageDirectory:
    """Rows below one folder by a key, descending and nulls last, then by an id ascending.

    Each of `ranges` folders holds consecutive rows, and path/directory their numbers, so
    any page is found by adding up the directory and reads the one or two ranges it lies in.
    Ties of the key are spread by the id; a key that all rows share makes no large range.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, id_col: str):
        self.spark, self.path, self.schema, self.key, self.id_col = spark, path.rstrip("/"), schema, key, id_col

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(self.key), F.asc(self.id_col)]

    def write(self, rows: DataFrame, ranges: int = 200) -> None:
        placed = rows.select(*self.schema.names).repartitionByRange(ranges, *self._order())
        placed.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/rows")
        # Counted on what was written, which the footers of the files tell.
        self._rows().groupBy("range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("range", IntegerType())).parquet(f"{self.path}/rows")

    def sizes(self) -> list[tuple[int, int]]:
        """(range, rows) in order: as many as there are ranges, however many rows."""
        rows = self.spark.read.schema("range int, n bigint").parquet(f"{self.path}/directory").collect()
        return sorted((r["range"], r["n"]) for r in rows)

    def page(self, number: int, size: int) -> DataFrame:
        """One page; a number outside 1..last is clamped. An empty table has one empty page."""
        sizes = self.sizes()
        last = max(1, -(-sum(n for _, n in sizes) // size))
        start = (min(max(1, number), last) - 1) * size
        needed, skipped, before = [], 0, 0
        for which, n in sizes:
            if before + n <= start:
                skipped = before + n
            elif before < start + size:
                needed.append(which)
            before += n
        found = self._rows().where(F.col("range").isin(needed)).drop("range")
        return found.orderBy(*self._order()).offset(start - skipped).limit(size)
