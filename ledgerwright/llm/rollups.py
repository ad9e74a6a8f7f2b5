"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) is turned into signed rows: what a
document counted before is taken out, what it counts now is put in. The signed rows of a
batch go to the ledger, their sums per key to the deltas, each in a folder of the batch.
Totals are the sum of all deltas; nothing that was written is ever changed. A batch is in
once its name stands among the commits, which is written last; delivered again it changes
nothing, and one that broke off before is not read and is computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerwright.llm.common import WORD
from ledgerwright.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer_version"]
CHANGES = "doc_id bigint, op string, seq bigint, source string, lang string, tokenizer_version string, tokens bigint"
LEDGER = "doc_id bigint, source string, lang string, tokenizer_version string, documents bigint, tokens bigint, batch bigint"
DELTAS = "source string, lang string, tokenizer_version string, documents bigint, tokens bigint, batch bigint"


def bpe_count(ranks_path: str | None = None):
    """Column function: number of byte-level BPE ids of a whole text; null counts 0."""

    @pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks_path)
        for batch in texts:
            yield batch.map(lambda t: len(encode.ids(t)), na_action=None).astype("int64")

    return count


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class TokenRollup:
    """Totals below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of the batches that are in."""
        where, files = self._files()
        return sorted(int(f.getPath().getName()) for f in files.listStatus(where)) if files.exists(where) else []

    def is_in(self, batch: int) -> bool:
        return batch in self.batches()

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows of the batches that are in; folders of others are not looked at."""
        own = self.batches()
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in own])

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Take in a batch of `CHANGES`; False if it was in before.

        Batches are committed in the order of their numbers: a new one below the last that is
        in is refused (ValueError), as later ones were computed without it. In a batch the change with the
        largest `seq` of a document and tokenizer version holds (ties: by op, then counts).
        `insert` and `revise` set the document's source, language and count, whether it is
        known or not; `delete` takes out what is known. A null count is 0; null source and
        language are keys of their own; changes without a doc_id or tokenizer version, or
        with another op, are ignored. An empty batch is committed as empty.
        """
        own = self.batches()
        if batch in own:
            return False
        if own and batch < own[-1]:
            raise ValueError(f"batch {batch} comes after batch {own[-1]} is in")
        valid = changes.where("doc_id IS NOT NULL AND tokenizer_version IS NOT NULL AND op IN ('insert', 'delete', 'revise')")
        last = valid.groupBy("doc_id", "tokenizer_version").agg(F.max(F.struct(
            "seq", "op", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang",
        )).alias("c"))
        now = last.select(
            "doc_id", "tokenizer_version", "c.source", "c.lang", F.lit(1).cast("long").alias("documents"), "c.tokens", "c.op",
        )
        # Only what the batch touches is summed up.
        known = self._read("ledger", LEDGER).join(now.select("doc_id", "tokenizer_version"), ["doc_id", "tokenizer_version"], "left_semi")
        taken_out = known.groupBy("doc_id", *KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        ).where("documents > 0").select("doc_id", *KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
        put_in = now.where("op <> 'delete'").select("doc_id", *KEYS, "documents", "tokens")
        signed = taken_out.unionByName(put_in).groupBy("doc_id", *KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        ).where("documents <> 0 OR tokens <> 0")
        ledger = f"{self.path}/ledger/batch={batch}"
        signed.write.mode("overwrite").parquet(ledger)
        rows = self.spark.read.schema(LEDGER.rsplit(",", 1)[0]).parquet(ledger)
        rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/deltas/batch={batch}")
        where, files = self._files()
        files.create(self.spark._jvm.org.apache.hadoop.fs.Path(where, str(batch)), True).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, documents, tokens of all that is counted now."""
        return self._read("deltas", DELTAS).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        ).where("documents <> 0 OR tokens <> 0")


def counted(docs: DataFrame, op: str, seq: int, ranks_path: str | None = None) -> DataFrame:
    """Changes that count `docs` (doc_id, source, lang, text) under both tokenizer versions."""
    both = F.array(
        F.struct(F.lit("byte_bpe_50k").alias("tokenizer_version"), F.col("bpe").alias("tokens")),
        F.struct(F.lit("words-1").alias("tokenizer_version"), F.col("words").alias("tokens")),
    )
    return docs.select(
        "doc_id", "source", "lang", bpe_count(ranks_path)("text").alias("bpe"), word_count(F.col("text")).alias("words")
    ).select("doc_id", F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "source", "lang", F.inline(both))


def removed(ids: DataFrame, seq: int) -> DataFrame:
    """Changes that delete the documents of `ids` under both tokenizer versions."""
    return ids.select(
        "doc_id", F.lit("delete").alias("op"), F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("words-1"))).alias("tokenizer_version"),
        F.lit(0).cast("long").alias("tokens"),
    )
