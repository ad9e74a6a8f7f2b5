"""Registered queries of this subpackage, one per operator, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm import (
    curriculum, exact_stream, filter_audit, fingerprints, hard_negatives, language, licenses, neardup, packing, rollups, snapshots, toxicity, tree_bpe,
)
from ledgerwright.llm.common import keep_keys, table
from ledgerwright.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of licenses in all documents."""
    return licenses.license_report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


QUERIES["op9_license_scan"] = op9_license_scan
SQL["op9_license_scan"] = licenses.oracle()


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return curriculum.mix_report(curriculum.mix(table(spark, sf_dir, "documents")))


QUERIES["op3_curriculum_mix"] = op3_curriculum_mix
SQL["op3_curriculum_mix"] = curriculum.oracle()


def op6_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one of equal texts that stays, by a stream with keyed state."""
    docs = table(spark, sf_dir, "documents")
    stream = exact_stream.described(exact_stream.document_stream(spark, sf_dir, docs.schema, 256 << 20))
    return exact_stream.deduplicate(docs, stream)


QUERIES["op6_exact_stream"] = op6_exact_stream
SQL["op6_exact_stream"] = exact_stream.oracle()


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES["op10_vector_packing"] = op10_vector_packing


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches over all documents, the second of them delivered twice.

    All documents come in; those labelled toxic are deleted; those labelled of low quality
    are counted again with runs of blanks squeezed.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = rollups.TokenRollup(spark, new_path(spark, "token-rollup"))
    store.commit(1, rollups.counted(docs, "insert", 1))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    store.commit(2, rollups.removed(toxic, 2))
    store.commit(2, rollups.removed(toxic, 2))
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    again = keep_keys(docs, poor, "doc_id").withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    store.commit(3, rollups.counted(again, "revise", 3))
    return store.totals()


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations that no longer one continues, in chat markup."""
    return snapshots.render_conversations(table(spark, sf_dir, "conversations"))


QUERIES["op2_token_rollup"] = op2_token_rollup
QUERIES["op7_chat_snapshots"] = op7_chat_snapshots
SQL["op7_chat_snapshots"] = snapshots.oracle()


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts."""
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


QUERIES["op4_fingerprints"] = op4_fingerprints


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents by four-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


QUERIES["op1_near_duplicates"] = op1_near_duplicates


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, *language.learn(docs))


QUERIES["op8_language_id"] = op8_language_id


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


QUERIES["op5_toxicity"] = op5_toxicity


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op11_filter_audit"] = op11_filter_audit
SQL["op11_filter_audit"] = filter_audit.oracle()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES["op12_hard_negatives"] = op12_hard_negatives
SQL["op12_hard_negatives"] = hard_negatives.oracle()


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents' texts and the texts decoded from them, as digests."""
    return tree_bpe.encode_report(table(spark, sf_dir, "documents"))


QUERIES["op13_tree_bpe"] = op13_tree_bpe
