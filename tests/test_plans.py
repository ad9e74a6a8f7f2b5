"""Structured query, reconciliation, triage, word boxes, sources, sinks and streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.operators.reconcile import reconcile
from ledgerwright.operators.triage import rederive, rederive_counts, store_rederived, with_confidence, with_triage
from ledgerwright.operators.words import field_boxes
from ledgerwright.plans.process import Stored, new_documents, process
from ledgerwright.plans.query import QueryError, StructuredQuery, filtered, run_aggregate, run_query, search
from ledgerwright.schema import EXTRACTIONS, INVOICES, TIER_RESULTS
from ledgerwright.sources import ingest as src
from ledgerwright.sources.export import append_usage, read_extractions, write_export, write_extractions
from ledgerwright.streaming.ingest import document_stream, ingest, keep_new
from ledgerwright.streaming.vendor_stats import running_vendor_stats

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def field(value, iso=None):
    return (value, None, 0, 0.9, "s", iso, iso)


def base(spark, rows):
    """Base relation from (id, vendor, total, date, iso, status)."""
    made = [(i, v, at(k), s, {"vendor_name": field(v), "total": field(t), "currency": field("USD"), "invoice_date": field(d, iso)},
             [], "confident", f"{v} {t}") for k, (i, v, t, d, iso, s) in enumerate(rows)]
    types = {f.name: f.dataType.simpleString() for f in EXTRACTIONS.fields}
    return spark.createDataFrame(made, f"""invoice_id string, vendor_table_name string, uploaded_at timestamp, review_status string,
        fields {types['fields']}, reasons {types['reasons']}, state string, raw_text string""")


@pytest.mark.parametrize("bad", [
    {"filters": [{"field": "total", "op": "contains", "value": "1"}]},
    {"filters": [{"field": "nope", "op": "eq", "value": "1"}]},
    {"filters": [{"field": "total", "op": "between", "value": [1]}]},
    {"filters": [{"field": "total", "op": "eq", "value": 1, "extra": 2}]},
    {"limit": 0}, {"limit": 501}, {"sort": ["currency", "asc"]}, {"sort": ["total", "up"]}, {"extra": 1},
    {"aggregate": {"op": "count", "field": "total"}}, {"aggregate": {"op": "sum"}}, {"aggregate": {"op": "max", "field": "total"}},
    {"aggregate": {"op": "count", "group_by": "total"}},
])
def test_queries_outside_the_whitelist_are_refused(bad):
    with pytest.raises(QueryError):
        StructuredQuery.from_dict(bad)


def test_query_rows(spark):
    rows = base(spark, [("a", "Acme", "500", "x", "2020-09-21", "pending"), ("b", "Beta", "5000", "x", "2020-09-26", "pending"),
                        ("c", None, "50000", "x", None, "confirmed"), ("d", "50%", "n/a", "x", None, "pending")])
    ids = lambda q: [r.invoice_id for r in run_query(rows, StructuredQuery.from_dict(q)).collect()]
    clause = lambda f, o, v: {"filters": [{"field": f, "op": o, "value": v}]}
    assert ids(clause("total", "between", [1000, 10000])) == ["b"]
    assert ids({"sort": ["total", "desc"]}) == ["c", "b", "a", "d"]
    assert ids({"sort": ["total", "asc"], "limit": 2}) == ["a", "b"]
    assert ids({}) == ["d", "c", "b", "a"]
    assert ids(clause("vendor_name", "neq", "ACME")) == ["d", "c", "b"]
    assert ids(clause("vendor_name", "contains", "0%")) == ["d"]
    assert ids(clause("vendor_name", "in", "acme")) == ["a"]
    # A period is found by its start only.
    assert ids(clause("invoice_date", "between", ["2020-09-20", "2020-09-22"])) == ["a"]
    assert ids(clause("raw_text", "fts_matches", "the of")) == []
    with pytest.raises(QueryError):
        ids(clause("invoice_date", "eq", "soon"))
    count = StructuredQuery.from_dict({"aggregate": {"op": "count", "group_by": "vendor_name"}})
    assert search(rows, count).count() == 0
    assert [tuple(r) for r in run_aggregate(rows, count).collect()] == [("50%", 1.0), ("Acme", 1.0), ("Beta", 1.0), ("(unknown)", 1.0)]
    with pytest.raises(QueryError):
        run_aggregate(rows, StructuredQuery())


def test_filters_on_stored_columns_reach_the_reader(spark, tmp_path):
    from ledgerwright.operators.fields import promote

    rows = promote(base(spark, [("a", "Acme", "500", "x", "2020-09-21", "pending")]))
    rows.write.parquet(str(tmp_path / "t"))
    query = StructuredQuery.from_dict({"filters": [{"field": "total", "op": "gt", "value": 100}]})
    plan = filtered(spark.read.parquet(str(tmp_path / "t")), query).select("invoice_id")._jdf.queryExecution().toString()
    assert "GreaterThan(total_amount,100.000000000)" in plan
    assert "ReadSchema: struct<invoice_id:string,total_amount:decimal(38,9)>" in plan


def reading(inv, tier, conf=None, failed=False, **values):
    full = {"vendor_name": "Acme", "invoice_number": "1", "invoice_date": "2024-01-02", "total": "100", "currency": "USD",
            "subtotal": "85", "tax": "15"} | values
    return (inv, tier, f"m{tier}", full, conf or {}, failed, "broken" if failed else None, (10, 1, 0, 0))


def test_reconciliation_rules(spark):
    tiers = spark.createDataFrame([
        reading("agree", 1), reading("agree", 2), reading("agree", 3, total="7"),
        reading("optional", 1, tax=None), reading("optional", 2), reading("optional", 3, total="7"),
        reading("required", 1, currency="EUR"), reading("required", 2), reading("required", 3, currency="USD"),
        reading("overruled", 1, currency="EUR"), reading("overruled", 2), reading("overruled", 3, currency="GBP"),
        reading("math", 1, total="90"), reading("math", 2, total="90"), reading("math", 3),
        reading("no-third", 1, currency="EUR"), reading("no-third", 2),
        reading("calm", 1, currency="EUR"), reading("calm", 2),
        reading("image", 2, {"total": 0.5}), reading("image", 3, vendor_name="Beta"),
        reading("sure", 2, {"total": 0.9}), reading("sure", 3, vendor_name="Beta"),
        reading("forced", 2), reading("forced", 3, vendor_name="Beta"),
    ], TIER_RESULTS)
    starts = {"image": (2, True, False), "sure": (2, True, False), "forced": (2, False, True), "calm": (1, False, False)}
    names = ["agree", "optional", "required", "overruled", "math", "no-third", "calm", "image", "sure", "forced"]
    init = spark.createDataFrame([(n, *starts.get(n, (1, True, False))) for n in names], "invoice_id string, start_tier int, escalate boolean, forced boolean")
    out = {r.invoice_id: r for r in reconcile(init, tiers).collect()}
    look = lambda n, f: (out[n][f], out[n]["sources"][f], out[n]["overrides"].get(f), out[n]["used_tiers"])
    assert look("agree", "total") == ("100", "haiku", 1.0, [1, 2])
    assert look("optional", "tax") == ("15", "sonnet", 0.3, [1, 2])
    assert look("required", "currency") == ("USD", "opus", 1.0, [1, 2, 3])
    assert look("overruled", "currency") == ("GBP", "opus", 0.3, [1, 2, 3])
    assert look("math", "total") == ("100", "opus", 1.0, [1, 2, 3])
    assert look("no-third", "currency") == ("USD", "sonnet", 0.3, [1, 2])
    assert look("calm", "currency") == ("EUR", "haiku", None, [1])
    assert look("image", "vendor_name") == ("Beta", "opus", 0.3, [2, 3])
    assert look("sure", "vendor_name") == ("Acme", "sonnet", None, [2])
    assert look("forced", "vendor_name") == ("Beta", "opus", 0.3, [2, 3])


def triaged(spark, n=5, **values):
    row = {"vendor_name": "Acme", "invoice_number": "1", "invoice_date": "2024-01-02", "total": "100", "currency": "USD",
           "subtotal": "85", "tax": "15"} | values
    df = spark.createDataFrame([(*row.values(), n, 100.0, 10.0)], ", ".join(f"{f} string" for f in row) + ", n bigint, avg double, std double")
    r = with_triage(with_confidence(df)).collect()[0]
    return r.state, [(x.type, x.field) for x in r.reasons], r


def test_triage_rules(spark):
    assert triaged(spark)[:2] == ("confident", [])
    assert triaged(spark, n=0)[:2] == ("confident", [("unseen_vendor", None)])
    state, reasons, row = triaged(spark, total="120")
    assert state == "needs_review"
    assert reasons == [("math_fails", None), ("low_confidence", "subtotal"), ("low_confidence", "tax"), ("low_confidence", "total")]
    assert row.reasons[0].delta == 20.0
    # A missing value is reported as missing, not as low.
    assert triaged(spark, currency=None)[:2] == ("needs_review", [("missing_field", "currency")])
    assert triaged(spark, invoice_date="October 2020")[:2] == ("needs_review", [("low_confidence", "invoice_date")])
    assert triaged(spark, subtotal=None, total="90")[:2] == ("confident", [])


def test_process_documents(spark):
    stored = Stored(
        spark.createDataFrame([("old", "k", "h0", "00000000000000ff", "v1", at(0), "confirmed", [])], INVOICES),
        spark.createDataFrame([("v1", "Acme", "acme")], "vendor_id string, name string, normalized_name string"),
        spark.createDataFrame([("v1", 5, 100.0, 5.0)], "vendor_id string, n bigint, avg double, std double"),
    )
    docs = spark.createDataFrame([
        ("ok", "h1", "h1.pdf", "0f0f0f0f0f0f0f0f", at(1), True, None), ("dup", "h2", "h2.pdf", "00000000000000fe", at(2), True, None),
        ("odd", "h3", "h3.pdf", "f0f0f0f0f0f0f0f0", at(3), True, None), ("img", "h4", "h4.pdf", None, at(4), False, None),
        ("fail", "h5", "h5.pdf", None, at(5), True, None), ("blank", "h6", "h6.pdf", None, at(6), True, None),
    ], "invoice_id string, file_hash string, storage_key string, perceptual_hash string, uploaded_at timestamp, has_text boolean, force_tier int")
    none = {f: None for f in fixed.HEADER_FIELDS}
    tiers = spark.createDataFrame([
        reading("ok", 1), reading("dup", 1), reading("odd", 1, total="500", subtotal=None, tax=None), reading("odd", 2, total="500", subtotal=None, tax=None),
        reading("img", 2, vendor_name="NEW VENDOR HOUSE"), reading("fail", 1, failed=True), reading("fail", 2, failed=True, vendor_name=None),
        reading("blank", 1, **none), reading("blank", 2),
    ], TIER_RESULTS)
    words = spark.createDataFrame([("ok", 0, i, t, i * 10.0, 0.0, i * 10.0 + 9, 20.0) for i, t in enumerate(["Total:", "100", "ACME,"])],
                                  "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    result = process(docs, tiers, stored, words=words)
    out = {r.invoice_id: r for r in result.extractions.collect()}
    kinds = {k: (r.state, [x.type for x in r.reasons]) for k, r in out.items()}
    assert kinds == {
        "ok": ("confident", []),
        "dup": ("likely_duplicate", ["duplicate_of"]),
        "odd": ("needs_review", ["anomaly", "low_confidence"]),
        "img": ("confident", ["unseen_vendor"]),
        "fail": ("needs_review", ["extraction_failed"]),
        "blank": ("confident", []),
    }
    assert out["dup"].reasons[0].invoice_id == "old"
    assert out["odd"].reasons[0].z_score == 80.0
    assert out["fail"].fields == {} and out["fail"].reasons[0].detail == "broken"
    assert out["ok"].fields["vendor_name"].bbox == [20 / 29, 0.0, 1.0, 1.0]
    assert out["ok"].fields["total"].source == "pymupdf+haiku" and out["img"].fields["total"].source == "claude-vision"
    assert out["ok"].fields["invoice_date"].iso_from == "2024-01-02"
    assert [t.model for t in out["odd"].tiers] == ["m1", "m2"] and [t.model for t in out["blank"].tiers] == ["m2"]
    assert out["ok"].raw_text == "Acme 1 2024-01-02 100 USD 85 15"
    assert {r.name for r in result.vendors.collect()} == {"Acme", "New Vendor House", "Unknown"}
    assert {r.invoice_id for r in result.invoices.collect()} == set(out)


def test_new_documents_are_those_without_a_current_extraction(spark):
    stored = Stored(spark.createDataFrame([("a", "k", "h1", None, None, at(0), "pending", []), ("b", "k", "h2", None, None, at(0), "pending", [])], INVOICES), None, None)
    ext = spark.createDataFrame([("a", True), ("b", False)], "invoice_id string, is_current boolean")
    docs = spark.createDataFrame([("x", "h1", at(1)), ("y", "h2", at(2)), ("z", "h2", at(1)), ("w", "h3", at(1))], "invoice_id string, file_hash string, uploaded_at timestamp")
    assert {r.invoice_id for r in new_documents(docs, stored, ext).collect()} == {"z", "w"}


def test_rederive_and_store(spark):
    from registry.triage import _stats
    from ledgerwright.plans import testmodel as tm

    d = "/root/testdata/sf0.001"
    done = rederive(tm.base(spark, d), _stats(spark, d))
    counts = rederive_counts(done).collect()[0]
    assert counts.flipped + counts.unchanged == counts.total == 1500
    ext = tm.extractions(spark, d)
    new = store_rederived(ext, done)
    assert new.count() == ext.count()
    moved = new.where("is_current").alias("n").join(ext.where("is_current").alias("o"), "extraction_id").where("n.state <> o.state").count()
    assert moved == counts.flipped


def test_boxes_take_the_first_run_on_the_lowest_page(spark):
    words = [("d", 1, 0, "Acme", 0, 0, 5, 5), ("d", 1, 1, "Corp.", 5, 0, 10, 5), ("d", 0, 3, "acme", 0, 0, 5, 10), ("d", 0, 5, "CORP", 5, 0, 10, 10),
             ("d", 0, 7, "acme", 0, 10, 5, 20), ("d", 0, 9, "corp", 5, 10, 10, 20)]
    df = spark.createDataFrame([(a, b, c, t, *map(float, r)) for a, b, c, t, *r in words], "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame([("d", "vendor_name", "Acme  Corp:"), ("d", "total", "9"), ("d", "currency", " ")], "doc_id string, field string, value string")
    found = field_boxes(df, values).collect()
    assert [(r.field, r.page, r.bbox) for r in found] == [("vendor_name", 0, [0.0, 0.0, 1.0, 0.5])]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "doc1.json").write_text(json.dumps({"field_extractions": [
        {"fieldtype": "vendor_name", "text": "One"}, {"fieldtype": "vendor_name", "text": "Two"}, {"fieldtype": "other", "text": "x"},
        {"fieldtype": "amount_total_gross", "text": "$5"}]}))
    assert {tuple(r) for r in src.read_annotations(spark, str(tmp_path / "a")).collect()} == {("doc1", "vendor_name", "One"), ("doc1", "total", "$5")}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "doc1.json").write_text(json.dumps({"pages": [{"blocks": [{"text": " ab "}, {"text": " "}, {"text": None}]}, {"blocks": [{"text": "cd"}]}]}))
    assert src.read_ocr(spark, str(tmp_path / "o")).collect()[0].text == "ab cd"
    assert src.read_ocr(spark, str(tmp_path / "o"), 3).collect()[0].text == "ab ..."
    (tmp_path / "gt.json").write_text(json.dumps([{"invoice_id": "1", "case": {"label": "x", "expected_vendor": "A", "expected_total": 5, "expected_triage_state": "confident", "expected_reason_types": []}}]))
    truth = src.read_ground_truth(spark, str(tmp_path / "gt.json")).collect()[0]
    assert (truth.expected_total, truth.unprocessable) == (5.0, False)
    for name, body in (("x.pdf", b"1"), ("y.pdf", b"1"), ("z.pdf", b"2"), ("t.txt", b"3")):
        (tmp_path / name).write_bytes(body)
    files = src.read_documents(spark, str(tmp_path))
    assert files.count() == 3
    known = files.where(F.col("path").endswith("z.pdf"))
    kept = src.drop_known(files, known).collect()
    assert len(kept) == 1 and kept[0].storage_key.endswith(".pdf") and len(kept[0].file_hash) == 64
    ids = spark.range(100)
    assert [r.id for r in src.seeded_sample(ids, "id", 5, 1).collect()] == [r.id for r in src.seeded_sample(ids, "id", 5, 1).collect()]


def test_sinks(spark, tmp_path):
    rows = base(spark, [("a", 'Ac"me, x', "500", "x", None, "pending")])
    write_export(rows, str(tmp_path / "csv"), {"limit": 5}, "2024-01-01T00:00:00Z", "csv")
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv" / "rows")).collect()[0]
    assert (back.vendor_name, back.total, back.reasons) == ('Ac"me, x', "500", "[]")
    about = spark.read.json(str(tmp_path / "csv" / "query")).collect()[0]
    assert (about.row_count, json.loads(about.query)) == (1, {"limit": 5})
    write_export(rows, str(tmp_path / "json"), {}, "t", "json")
    assert spark.read.json(str(tmp_path / "json" / "rows")).count() == 1
    with pytest.raises(ValueError):
        write_export(rows, str(tmp_path / "x"), {}, "t", "xml")
    calls = spark.createDataFrame([("haiku", 1000, 0, None, 0)], "model string, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint")
    for _ in range(2):
        append_usage(calls, str(tmp_path / "usage"))
    assert [r.cost_usd for r in spark.read.parquet(str(tmp_path / "usage")).collect()] == [0.001, 0.001]
    ext = spark.createDataFrame([("e1", True), ("e2", False)], "extraction_id string, is_current boolean")
    write_extractions(ext, str(tmp_path / "ext"))
    current = read_extractions(spark, str(tmp_path / "ext"), ext.schema).where("is_current").select("extraction_id")
    assert [r.extraction_id for r in current.collect()] == ["e1"]
    assert "PartitionFilters: [isnotnull(is_current" in current._jdf.queryExecution().toString()


def test_stream_ingest_keeps_the_first_and_can_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.pdf", b"2")):
        (tmp_path / "in" / name).write_bytes(body)
    table = str(tmp_path / "table")

    def run():
        stream = document_stream(spark, str(tmp_path / "in"), per_trigger=1).select("file_hash", "storage_key", "path")
        query = ingest(stream, table, str(tmp_path / "offsets"), ["path"]).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(table)

    assert run().count() == 2
    (tmp_path / "in" / "d.pdf").write_bytes(b"2")
    (tmp_path / "in" / "e.pdf").write_bytes(b"3")
    assert run().count() == 3
    # The last batch again: the table stays as it is.
    last = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    stored = spark.read.parquet(table)
    rows = stored.where(F.col("batch") == last).drop("batch").collect()
    batch = spark.createDataFrame(rows, stored.drop("batch").schema)
    keep_new(table, ["path"])(batch, last)
    assert spark.read.parquet(table).count() == 3


def test_stream_vendor_stats_over_several_batches(spark, tmp_path):
    from ledgerwright.operators.vendors import step

    rows = [("v", f"i{k:02d}", at(k), float(100 + k % 3)) for k in range(9)] + [("v", "i09", at(9), 900.0)]
    for n, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "vendor_id string, invoice_id string, ts timestamp, total double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("vendor_id string, invoice_id string, ts timestamp, total double").parquet(str(tmp_path / "in"))
        query = running_vendor_stats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = {r.invoice_id: (r.n, r.avg, r["std"], r.outlier_z is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    acc = (0, 0.0, 0.0, 0.0)
    for _, i, _, x in rows:
        assert found[i][:3] == acc[:3]
        acc = step(acc[0], acc[1], acc[3], x)
    assert found["i09"][3] and not found["i08"][3]
