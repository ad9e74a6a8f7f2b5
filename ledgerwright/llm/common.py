"""What the operators of this subpackage share: tables, words, written intermediates."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwright.session import new_path

#: White space of the word rule `[^\x20\x09-\x0D]+`; Python's bytes.split() cuts at the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path may be a file, a folder or lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its name, which may hold dots and back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, *needed: str) -> DataFrame:
    """`row`, a struct of all columns of `df`, beside the columns `needed`: names of the caller's meet none of ours."""
    return df.select(F.struct(*map(column, df.columns)).alias("row"), *map(column, needed))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` from the struct `row`."""
    return rows.select(*[F.col("row").getField(name).alias(name) for name in like.columns])


def free_names(df: DataFrame, stem: str, n: int) -> list[str]:
    """`n` column names that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while any(f"{stem}_{i}" in taken for i in range(n)):
        stem += "_"
    return [f"{stem}_{i}" for i in range(n)]


def first_by_hash(rows: DataFrame, group: str, key: str, most: Column) -> DataFrame:
    """At most `most` rows of each group: the first in the order of a hash of `key`, with `group`, `key` and their rank.

    Groups are counted first, and rows whose hash lies beyond four times the share that is
    wanted fall out before the shuffle, so that the rows ranked together follow the sample
    and not the table.
    """
    sizes = rows.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("size"))
    share = (F.xxhash64(key) / F.lit(2.0**63) + 1) / 2
    near = rows.join(sizes, F.col(group).eqNullSafe(F.col("of"))).where(share * F.col("size") <= 4 * most)
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(group, key, "rank")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver as a local relation, whose size Spark knows."""
    kinds = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], kinds)

    def cell(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f.name for f in kinds)})")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else that matters to ASCII words.

    `lower` maps only two characters outside ASCII to ASCII letters; texts with one of them
    take the slower character map.
    """
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo `modulus`: the rule by which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    acc = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        acc = mix((acc + words[k:k + n]) * _ODD[k % len(_ODD)])
    return np.unique(acc)


#: Keys of up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def keep_keys(wide: DataFrame, keys: DataFrame, *names: str, how: str = "left_semi") -> DataFrame:
    """The rows of `wide` whose columns `names` (nulls included) are in `keys`, or with left_anti are not.

    The keys are written and measured first. While they are few enough for every executor
    to hold, wide rows are filtered where they are read; beyond that both sides are shuffled.
    """
    names_of = free_names(wide, "key", len(names))
    keys = stored(keys.select(*[F.col(n).alias(k) for n, k in zip(names, names_of)]), "keys")
    width = sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) + 8 for k in names_of), F.lit(0))
    few = (keys.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES
    same = F.lit(True)
    for n, k in zip(names, names_of):
        same = same & F.col(n).eqNullSafe(F.col(k))
    return wide.join(F.broadcast(keys) if few else keys, same, how)


def map_columns(df: DataFrame, make, schema: str, release: bool = False) -> DataFrame:
    """Rows made from `df` by Python, a batch of columns at a time.

    `make` takes an iterator of dicts of lists (one per Arrow batch) and yields dicts of
    lists or arrays with the columns of `schema`. Integers stay exact next to nulls. With
    `release`, a task gives its memory back when it is done.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def rows(batches):
        for made in make(b.to_pydict() for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            if release:
                give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system.

    Spark keeps Python workers for the stages that follow, and they would hold on to the
    most that an earlier one ever took.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
