"""A stored table of extractions that batches change in place, a few buckets at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ledgerwright.operators.scan import promote_current
from ledgerwright.session import materialised


class ExtractionStore:
    """Extractions below one folder, split by a hash of invoice_id into a fixed number of buckets.

    All rows of an invoice lie in one bucket, so a batch reads and rewrites the buckets of
    its own invoices and no others. What a bucket shall hold is written aside first and then
    takes the bucket's place; a batch that broke off is simply run again, as rows are known
    by extraction_id and replace themselves.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 256):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("invoice_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _rows(self) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("bucket", IntegerType())
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows().drop("bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' invoices: no more numbers than there are buckets."""
        return sorted(r["bucket"] for r in rows.select(self._bucket()).distinct().collect())

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        if not buckets:
            return
        aside = materialised(rows.select(*self.schema.names, self._bucket()).repartition("bucket"), "buckets")
        aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def append(self, new: DataFrame) -> list[int]:
        """Add rows; of the invoices among them the newest row becomes current. Gives the buckets that were rewritten.

        Rows of other invoices stay as they are, what was promoted by hand included.
        """
        new = materialised(new.select(*self.schema.names), "batch")
        buckets = self.touched(new)
        old = self._rows().where(F.col("bucket").isin(buckets)).drop("bucket")
        old = old.join(new.select("extraction_id").distinct(), "extraction_id", "left_anti").select(*self.schema.names)
        rows = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
        # The newest row of each invoice, and whether the batch brought any: one join by invoice tells what changes.
        newest = rows.groupBy("invoice_id").agg(
            F.max(F.struct("created_at", "extraction_id"))["extraction_id"].alias("__newest"), F.bool_or("__new").alias("__ours")
        )
        ours = F.col("__new") | F.coalesce("__ours", F.lit(False))
        current = F.when(ours, F.coalesce(F.col("extraction_id") == F.col("__newest"), F.lit(False))).otherwise(F.col("is_current"))
        self._replace(rows.join(newest, "invoice_id", "left").withColumn("is_current", current), buckets)
        return buckets

    def promote(self, chosen: DataFrame) -> list[int]:
        """Make chosen rows (invoice_id, extraction_id, and promoted_at where it matters) current instead of their siblings."""
        chosen = materialised(chosen, "chosen")
        buckets = self.touched(chosen)
        old = self._rows().where(F.col("bucket").isin(buckets)).drop("bucket")
        self._replace(promote_current(old, chosen.drop("invoice_id")), buckets)
        return buckets
