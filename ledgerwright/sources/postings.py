"""An inverted index of texts: lexeme -> ids, for searches that read the lists of their own terms only."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerwright import fixed
from ledgerwright.functions.stemming import query_lexemes, stem
from ledgerwright.functions.text import word_tokens
from ledgerwright.session import materialised

BUCKETS = 64


@F.pandas_udf(StringType())
def _stem_of(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_table(words: DataFrame) -> DataFrame:
    """(word, lexeme) of the distinct words, written once: Python sees each word of the vocabulary one time."""
    vocabulary = words.select("word").distinct().where(~F.col("word").isin(*fixed.STOP_WORDS))
    return materialised(vocabulary.select("word", _stem_of("word").alias("lexeme")), "stems")


def _pairs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lexeme, id), more than once where words of a text share a lexeme. Numbers are their own lexemes: they need no stem,
    and without them the vocabulary is small."""
    words = texts.select(id_col, F.explode(F.array_distinct(word_tokens(F.col(text_col)))).alias("word"))
    number = F.col("word").rlike("^[0-9]+$")
    stemmed = words.where(~number).join(stem_table(words.where(~number)), "word").select("lexeme", id_col)
    return stemmed.unionByName(words.where(number).select(F.col("word").alias("lexeme"), id_col))


def postings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lexeme, id), each pair once, for texts with one row an id."""
    return _pairs(texts, id_col, text_col).distinct()


def write_postings(texts: DataFrame, path: str, id_col: str, text_col: str, buckets: int = BUCKETS) -> None:
    """Postings in folders by the crc32 of the lexeme, sorted by lexeme and id.

    A row is one pair, so the list of a frequent lexeme is many rows over many files and no
    array of any length; sorted, a lexeme takes little space and its row groups are found by
    their statistics. The texts are written once, as they are read several times; pairs are
    shuffled once, by ranges, in which equal ones meet.
    """
    texts = materialised(texts.select(id_col, text_col), "texts")
    placed = _pairs(texts, id_col, text_col).withColumn("bucket", (F.crc32(F.col("lexeme").cast("binary")) % buckets).cast("int"))
    order = ["bucket", "lexeme", id_col]
    # Sorted by the window, which needs no more than the sort that the files need as well.
    nth = F.row_number().over(Window.partitionBy(*order).orderBy(id_col))
    once = placed.repartitionByRange(*order).withColumn("nth", nth).where(F.col("nth") == 1).drop("nth")
    once.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def search_postings(spark: SparkSession, path: str, phrase: str, id_col: str, id_type: str = "string", buckets: int = BUCKETS) -> DataFrame:
    """The ids of texts that hold every lexeme of the phrase; none for a phrase without any.

    Reads the folders and row groups of those lexemes, and counts pairs an id; no Python.
    """
    wanted = query_lexemes(phrase)
    rows = spark.read.schema(f"lexeme string, {id_col} {id_type}, bucket int").parquet(path)
    folders = sorted({zlib.crc32(w.encode()) % buckets for w in wanted})
    found = rows.where(F.col("bucket").isin(folders) & F.col("lexeme").isin(wanted)) if wanted else rows.where(F.lit(False))
    return found.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(id_col)
