"""What steps write and shuffle."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import SMALL

from ledgerwright import fixed
from ledgerwright.plans import process
from ledgerwright.session import materialised
from ledgerwright.sources import hash_index, postings

READING = (
    "invoice_id string, tier int, model string, fields map<string,string>, self_confidence map<string,double>, extraction_failed boolean, "
    "failure_reason string, usage struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>"
)


def noted(monkeypatch, module):
    written = {}

    def write(df, name):
        written[name] = df
        return materialised(df, name)

    monkeypatch.setattr(module, "materialised", write)
    return written


def test_texts_of_postings_meet_no_invoices_and_vendors(spark, monkeypatch):
    from registry.search import QUERIES

    written = noted(monkeypatch, postings)
    QUERIES["posted_fts_all_terms"](spark, SMALL)
    plan = written["texts"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 5  # orders, customer, line items for sums and for texts, parts


def test_processing_shuffles_wide_rows_once_and_keeps_traces_only(spark, monkeypatch):
    at = datetime(2024, 1, 1)
    values = {"vendor_name": "Acme", "invoice_number": "7", "invoice_date": "2024-01-01", "total": "3.00", "currency": "EUR", "subtotal": "2.00", "tax": "1.00"}
    documents = spark.createDataFrame(
        # An id that comes twice, and one that is null, keep their rows.
        [(i, f"f{n}", f"s{n}", f"{n:016x}", at + timedelta(minutes=n), True, None) for n, i in enumerate(["a", "b", "b", None])],
        "invoice_id string, file_hash string, storage_key string, perceptual_hash string, uploaded_at timestamp, has_text boolean, force_tier int",
    )
    tiers = spark.createDataFrame([(i, 1, "m1", values, {"total": 0.9}, False, None, (1, 2, 3, 4)) for i in ("a", "b")], READING)
    stored = process.Stored(
        spark.createDataFrame([], process.INVOICES), spark.createDataFrame([], "vendor_id string, name string, normalized_name string, tax_id string"),
        spark.createDataFrame([], "vendor_id string, n long, avg double, std double"),
    )
    written = noted(monkeypatch, process)
    none = spark.createDataFrame([("b", "a", "both", 1.0)], "invoice_id string, duplicate_id string, match_method string, similarity double")
    result = process.process(documents, tiers, stored, duplicates=none)
    assert not set(fixed.HEADER_FIELDS) & set(written["readings"].columns)
    assert written["triaged"].schema["t1"].dataType.names == ["model", "usage", "self_confidence"]
    rows = result.extractions.collect()
    assert sorted((r.invoice_id or "", r.state) for r in rows) == [("", "needs_review"), ("a", "confident"), ("b", "likely_duplicate"), ("b", "likely_duplicate")]
    assert {r.fields["total"].value for r in rows if r.invoice_id} == {"3.00"} and {r.tiers[0].model for r in rows if r.invoice_id} == {"m1"}
    assert {(r.invoice_id, r.storage_key) for r in result.invoices.collect()} == {("a", "s0"), ("b", "s1"), ("b", "s2"), (None, "s3")}


def test_a_probe_writes_a_hash_once_and_not_once_a_key(spark, monkeypatch, tmp_path):
    written = noted(monkeypatch, hash_index)
    at = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(f"u{i}", at + timedelta(minutes=i), i // 2) for i in range(6)], "invoice_id string, uploaded_at timestamp, hash_bits bigint")
    index = hash_index.HashIndex(spark, str(tmp_path / "index"), buckets=4)
    found = {r.invoice_id: (r.near_id, r.distance) for r in index.probe_and_add(batch, 0).collect()}
    assert found == {"u1": ("u0", 0), "u2": ("u0", 1), "u3": ("u2", 0), "u4": ("u0", 1), "u5": ("u4", 0)}
    assert set(written) == {"uploads", "firsts", "near"} and written["firsts"].count() == 3
