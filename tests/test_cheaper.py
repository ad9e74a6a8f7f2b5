"""Steps that were made cheaper: the work they leave out, and results that stay as they were."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SMALL
from ledgerwright import fixed
from ledgerwright.functions import stemming
from ledgerwright.operators import fields, rollup
from ledgerwright.operators.triage import rederive, triage_state
from ledgerwright.plans import process as processing
from ledgerwright.plans import testmodel as tm
from ledgerwright.plans.query import StructuredQuery, filtered
from ledgerwright.sources import hash_index, store
from ledgerwright.sources.ingest import annotation_rows
from test_operators import invoice_base


def noted(monkeypatch, module):
    """The (name, plan) of what `module` writes aside from now on."""
    written, real = [], module.materialised

    def write(df, name):
        written.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(module, "materialised", write)
    return written


def test_field_diff_takes_the_values_once(spark, monkeypatch):
    written = noted(monkeypatch, fields)
    kind = "struct<value:string,bbox:array<double>,page:int,confidence:double,source:string,iso_from:string,iso_to:string>"
    entry = lambda name, value: f"'{name}', CAST(struct({value}, NULL, 0, 1D, 's', NULL, NULL) AS {kind})"
    rows = spark.sql(f"""SELECT 'a' AS invoice_id, map({entry('total', "'1.00'")}, {entry('currency', "' EUR'")}, {entry('tax', "'x'")}) AS fields
        UNION ALL SELECT 'b', map({entry('total', "'1.009'")}, {entry('currency', "'EUR '")}, {entry('tax', "'x'")}) UNION ALL SELECT 'c', NULL""")
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "c"), ("a", "none")], "invoice_id string, against_id string")
    found = {(r.invoice_id, r.against_id, r.field): (r.original_value, r.current_value, r.matches) for r in fields.field_diff(pairs, rows).collect()}
    assert len(found) == 21 and [name for name, _ in written] == ["values"]
    assert found["a", "b", "total"] == ("1.009", "1.00", True) and found["a", "b", "currency"] == ("EUR ", " EUR", True)
    assert found["a", "b", "tax"] == ("x", "x", False) and found["a", "b", "subtotal"] == (None, None, True)
    assert found["c", "a", "total"] == ("1.00", None, False) and found["c", "c", "total"] == (None, None, True)


def test_a_rederived_state_needs_no_reasons(spark):
    stats = spark.createDataFrame([("1", 4, 100.0, 1.0), ("2", 1, 5.0, 0.0)], "vendor_id string, n long, avg double, std double")
    done = rederive(tm.base(spark, SMALL), stats)
    same = F.col("state") == triage_state(F.col("reasons"))
    states = {r.state: (r.n, r.same) for r in done.groupBy("state").agg(F.count("*").alias("n"), F.count_if(same).alias("same")).collect()}
    assert len(states) == 3 and all(n == equal > 0 for n, equal in states.values())
    assert "below_threshold" not in done.select("state", "changed")._jdf.queryExecution().optimizedPlan().toString()


def test_an_append_joins_the_stored_rows_twice(spark, tmp_path, monkeypatch):
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    row = "extraction_id string, invoice_id string, created_at timestamp, is_current boolean"
    table = store.ExtractionStore(spark, str(tmp_path / "store"), spark.createDataFrame([], row).schema, buckets=4)
    table.append(spark.createDataFrame([("a1", "a", at(1), True), ("a2", "a", at(2), True), ("b1", "b", at(1), True), ("n1", None, at(1), True)], row))
    table.promote(spark.createDataFrame([("b", "b1")], "invoice_id string, extraction_id string"))
    written = noted(monkeypatch, store)
    # a1 comes again and later, c is new; b stays promoted, rows without an invoice are never current.
    table.append(spark.createDataFrame([("a1", "a", at(9), False), ("c1", "c", None, False), ("n2", None, at(1), True)], row))
    assert {r.extraction_id: r.is_current for r in table.read().collect()} == {
        "a1": True, "a2": False, "b1": True, "c1": True, "n1": False, "n2": False
    }
    plan = dict(written)["buckets"]
    assert plan.count("Join ") <= 3  # replaced rows go once before the newest is told and once before it is joined


def test_packing_of_the_pipeline_keeps_no_encoder(spark):
    import corpus_pipeline

    def kept(batches):
        import pyarrow as pa

        from ledgerwright.llm.tokens import encoder

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder.cache_info().currsize], pa.int64())], ["kept"])

    corpus_pipeline.pack(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()
    assert spark.range(0, 64, 1, 8).mapInArrow(kept, "kept long").agg(F.sum("kept")).first()[0] == 0


def test_an_index_probe_writes_its_keys_once(spark, tmp_path, monkeypatch):
    written = noted(monkeypatch, hash_index)
    index = hash_index.HashIndex(spark, str(tmp_path / "index"), buckets=8, fan=2)
    uploads = lambda rows: spark.createDataFrame(rows, "invoice_id string, uploaded_at timestamp, hash_bits long")
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    first = index.probe_and_add(uploads([("a", at(1), 0), ("b", at(2), 3), ("c", at(3), -1), ("d", at(4), 0)]), 0)
    assert {tuple(r) for r in first.collect()} == {("b", "a", 2), ("d", "a", 0)}
    # More stored than asked for, and fewer: both ways of joining.
    assert {tuple(r) for r in index.probe_and_add(uploads([("e", at(9), -2)]), 1).collect()} == {("e", "c", 1)}
    many = [(f"m{i}", at(20 + i), 1 << 20 | 1 << 40 | 1 << 41 | 1 << 50 | 1 << 60 | 1 << (i + 1)) for i in range(12)] + [("f", at(0), 1)]
    found = {r.invoice_id: (r.near_id, r.distance) for r in index.probe_and_add(uploads(many), 2).collect()}
    assert found == {f"m{i}": ("m0", 2) for i in range(1, 12)}
    assert "candidates" not in [name for name, _ in written]


def test_a_retry_gathers_the_readings_of_its_invoices(spark, monkeypatch):
    monkeypatch.setattr(processing, "process", lambda again, tiers, stored, **tables: (again, tiers))
    invoices = spark.createDataFrame([(i, i, i, None) for i in "abc"], "invoice_id string, file_hash string, storage_key string, perceptual_hash string")
    chosen = spark.createDataFrame([("b", 2, True, datetime(2024, 1, 1))], "invoice_id string, force_tier int, has_text boolean, retried_at timestamp")
    tiers = spark.createDataFrame([(i, t) for i in "abc" for t in (1, 2, 3)], "invoice_id string, tier int")
    again, readings = processing.retry(chosen, invoices, tiers, None)
    assert [r.invoice_id for r in again.collect()] == ["b"]
    assert sorted(map(tuple, readings.collect())) == [("b", 1), ("b", 2), ("b", 3)]


def test_annotations_are_shuffled_before_they_are_sorted(spark):
    kind = "doc_id string, field_extractions array<struct<fieldtype:string,text:string>>"
    rows = spark.createDataFrame([
        ("a", [("note", "x"), ("vendor_name", None), ("vendor_name", "second"), None, (None, "y"), ("amount_total_tax", "1")]),
        ("b", None), ("c", []), ("d", [("note", "x"), ("date_issue", "late")]), ("d", [("date_issue", "early"), ("document_id", "7")]),
    ], kind)
    found = annotation_rows(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "tax", "1"), ("a", "vendor_name", ""), ("d", "invoice_date", "early"), ("d", "invoice_number", "7")]
    assert plan.rindex("Aggregate") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_a_rollup_reads_its_invoices_once(spark, monkeypatch):
    written = noted(monkeypatch, rollup)
    many = [(f"{k:04d}-m", "m", "Many", 5, "pending", str(100 if k < 7 else 200), None) for k in range(14)]
    rows = many + [("m-neg", "m", " Many", 5, "pending", "-1", None), ("m-old", "m", "Many ", 1, "pending", "100", None), ("0-nan", "m", "Many", 5, "confirmed", "x", None),
                   ("n1", "n", "None", 3, "pending", "0", None), ("n2", "n", "None", 4, "pending", None, None)]
    found = rollup.vendor_rollup(invoice_base(spark, rows))
    plans = [plan for _, plan in written] + [found._jdf.queryExecution().optimizedPlan().toString()]
    assert [name for name, _ in written] == ["rows", "cells"] and sum(plan.count("LogicalRDD") for plan in plans) == 1
    told = {r.name: (r.invoices, r.total_spent, r.avg_invoice, r.trend, r.last_seen, r.anomalies) for r in found.collect()}
    # Many: of 15 positive totals the older 7 are m-old and the first 6 of one day, 100 each; the recent 8 are 100 and 7 of 200.
    assert told == {"Many": (17, 2200.0, 2200.0 / 15, "rising", "2024-01-05", 16), "None": (2, 0.0, 0.0, "new", "2024-01-04", 2)}


def test_words_begin_as_their_stems_say():
    parts = ["", "a", "b", "e", "i", "o", "y", "st", "at", "bl", "iz", "ee", "ll", "ss", "ring", "gener", "ti"]
    ends = ["", "s", "es", "ies", "ied", "sses", "ed", "eed", "eedly", "ing", "ingly", "y", "ly", "li", "ation", "fulness", "ogi", "biliti", "e", "ement"]
    words = {a + b + c for a in parts for b in parts for c in ends} | set(stemming._WHOLE) | set(stemming._AFTER_PLURAL) | {"7", "12th", "éclairs"}
    words.discard("")
    assert len(words) > 2000
    assert [w for w in words if not any(w.startswith(b) for b in stemming.beginnings(stemming.stem(w)))] == []


def test_a_search_stems_only_words_that_begin_like_its_own(spark):
    texts = ["The BLUE rings", "blue, ring-shaped", "bluer rings", "blues and string", "ring", "", None, "dying sky", "Skies died", "it's 12 o'clock", "BLUE_RINGS 12"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "invoice_id string, raw_text string").selectExpr(
        "*", "map('total', named_struct('value', '1', 'iso_from', '')) AS fields")
    words = lambda text: {stemming.stem(w) for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in set(fixed.STOP_WORDS)}
    for phrase in ("the blue rings", "sky", "die", "skies dying", "12", "the", "o clock", "absent"):
        query = StructuredQuery.from_dict({"filters": [{"field": "raw_text", "op": "fts_matches", "value": phrase}]})
        found, wanted = filtered(rows, query), words(phrase)
        assert {r.invoice_id: set(r.lexemes) for r in found.collect()} == {str(i): words(t) for i, t in enumerate(texts) if wanted and wanted <= words(t)}, phrase
    query = StructuredQuery.from_dict({"filters": [{"field": "raw_text", "op": "fts_matches", "value": "blue"}]})
    plan = filtered(rows, query).select("invoice_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "bl" in plan[plan.index("ArrowEvalPython"):].split("Filter", 1)[1]


def test_texts_need_no_dates(spark):
    plan = tm.extractions(spark, SMALL).select("raw_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "iso_from" not in plan
