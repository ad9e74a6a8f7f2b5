"""Exact deduplication as a stream with disk-backed keyed state that never expires.

Documents arrive in micro-batches. For each content the state (RocksDB, kept under the
stream's checkpoint) holds the digest as key and the identifier, length and locator of the
row that stays, and how many rows came. The state is read back with Spark's state reader.
Rows that hit a content then have their full bytes compared with those of the row that
stays; were two contents ever to share a digest, they are told apart by their text.
Only DataFrame functions are used.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm.common import SPACE, keep_keys, stored, unpacked, whole
from ledgerwright.session import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Many small stores must not each set aside megabytes of disk.
RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


@contextmanager
def _rocksdb(spark: SparkSession):
    """State on disk while a stream of ours starts; the caller's settings come back after."""
    wanted = {PROVIDER: ROCKSDB, CHANGELOG: "true", RESERVE: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_state(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keyed state of the stream: per digest the row that stays and the number of rows.

    `stream` has digest, n_chars, doc_id and locator. The row with most characters, then
    the smallest doc_id (null last), then the smallest locator stays.
    """
    rank = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"
    )
    return stream.groupBy(*(keys or ["digest"])).agg(F.min(rank).alias("keeper"), F.count("*").alias("rows"))


def run_stream(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Take in all that the source has, then read the state: digest, keeper, rows.

    Run again with the same checkpoint, the stream goes on where it stopped.
    """
    spark = stream.sparkSession
    with _rocksdb(spark):
        query = (
            digest_state(stream).writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        fields = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"), F.col("value")[fields[0]].alias("keeper"), F.col("value")[fields[1]].alias("rows")
    )


def document_stream(spark: SparkSession, sf_dir: str, schema, batch_bytes: int | None = None) -> DataFrame:
    """The documents as a file stream; a trigger takes about `batch_bytes` (all, if None)."""
    reader = spark.readStream.schema(schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    return reader.parquet(f"{sf_dir}/documents.parque[t]")  # as a pattern, it may name a file or a folder


def described(docs: DataFrame, digest_of=digest) -> DataFrame:
    """doc_id, digest, n_chars and a locator (the file) of each row."""
    return docs.select(
        "doc_id", digest_of(normalised(F.col("text"))).alias("digest"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), F.input_file_name().alias("locator"),
    )


def _labelled(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's keeper and size; of rows alike in all the keeper has, the first stays."""
    met = rows.join(groups, keys).withColumn(
        "same", F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
        .eqNullSafe(F.col("keeper")),
    )
    firsts = met.where("same").groupBy(*keys).agg(F.min("row").alias("keep_row"))
    return met.join(firsts, keys).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, stream: DataFrame, checkpoint: str | None = None, digest_of=digest) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `stream` brings the same rows (`described`) as a stream. Texts are equal when they are
    after deleting white space. Null text counts as empty, and all empty texts are one
    group. A null doc_id loses against any other. Of rows that repeat a doc_id with the same
    text, one stays. Further columns are not read. An empty table gives an empty result.

    Full bytes are compared by grouping the texts of all rows that hit a content; equal ones
    are combined before the shuffle, however many there are.
    """
    spark = docs.sparkSession
    state = stored(run_stream(stream, checkpoint or new_path(spark, "dedup-state")), "dedup-groups")
    rows = stored(described(docs, digest_of).withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    hits = state.where("rows > 1").select(F.xxhash64("digest").alias("key"))
    # Rows of other contents fall out before the shuffle; the few that share a key by chance do no harm.
    texts = keep_keys(described_texts(docs, digest_of).withColumn("key", F.xxhash64("digest")), hits, "key")
    contents = texts.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("contents"))
    collided = stored(contents.where("contents > 1").select("digest"), "dedup-collided")
    result = _labelled(rows, state, ["digest"])
    if collided.isEmpty():
        return result
    # Texts that share a digest but not their bytes: told apart by the bytes.
    apart = stored(
        described_texts(docs, digest_of).join(collided, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()),
        "dedup-apart",
    )
    groups = digest_state(apart, ["digest", "norm"])
    return _labelled(rows.join(collided, "digest", "left_anti"), state, ["digest"]).unionByName(
        _labelled(apart, groups, ["digest", "norm"])
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose text another row keeps; all columns as they are.

    The digests of the rows are written and taken in by the stream in their turn, so `docs`
    may come from anywhere.
    """
    spark = docs.sparkSession
    path = new_path(spark, "dedup-arrivals")
    described(docs).write.parquet(path)
    arrivals = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    verdicts = deduplicate(docs, arrivals).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")
    )
    verdicts = stored(verdicts.where("NOT kept OR n > 1"), "dedup-verdicts")
    marked = whole(docs, "doc_id", "text").withColumn("digest", digest(normalised(F.col("text"))))
    keys = verdicts.select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    left = keep_keys(marked, keys, "doc_id", "digest", how="left_anti")
    again = keys.where("kept")
    if not again.isEmpty():
        # Rows that repeat their doc_id with the text that stays: one of them, the longest.
        repeated = keep_keys(marked, again, "doc_id", "digest")
        longest = F.struct(F.length("text").alias("n"), F.col("text"))
        one = repeated.groupBy("doc_id", "digest").agg(F.max_by("row", longest).alias("row"))
        left = left.select("row").unionByName(one.select("row"))
    return unpacked(left, docs)


def described_texts(docs: DataFrame, digest_of=digest) -> DataFrame:
    """`described` with the normalised text itself."""
    norm = normalised(F.col("text"))
    return docs.select(
        "doc_id", digest_of(norm).alias("digest"), norm.alias("norm"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), F.input_file_name().alias("locator"),
    )


def oracle() -> str:
    return r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER g = 1 AS kept, sha256(norm) AS text_sha256 FROM d WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""
