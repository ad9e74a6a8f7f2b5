"""Cases that once gave wrong answers or ended a query."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerwright.functions.amounts import agreement, amount, finite, round_exact
from ledgerwright.functions.scoring import hamming, hash_to_long
from ledgerwright.operators.anomalies import anomaly_aggregates, append_outliers, detect_anomalies, parse_anomaly_id
from ledgerwright.operators.scan import page_after, promote_current
from ledgerwright.operators.usage import usage_by_model
from ledgerwright.plans.query import Clause, QueryError, clause_column


def amounts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select("t", amount(F.col("t")).alias("total_amount"))


def test_large_amounts_and_long_literals(spark):
    rows = amounts(spark, "123456789012345.5", "5", "5.00005", "-3", "NaN", "Infinity", "ten", None, "1e16").cache()
    found = lambda op, value: {r.t for r in rows.where(clause_column(Clause("total", op, value))).collect()}
    assert found("gt", 1e14) == {"123456789012345.5", "1e16"}
    assert found("lt", 5.00004) == {"5", "-3"}
    assert found("lt", "1e40") == {"123456789012345.5", "5", "5.00005", "-3", "1e16"}
    assert found("gt", "1e40") == set() and found("gt", "-1e40") == found("lt", "1e40")
    assert found("eq", "5.00000000000001") == set() and found("neq", "5.00000000000001") == found("lt", "1e40")
    assert found("between", ["4.9999999999999", "5.0000000000001"]) == {"5"}
    for bad in ("ten", "NaN", None):
        with pytest.raises(QueryError):
            clause_column(Clause("total", "gt", bad))


def test_totals_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("a", "NaN"), ("b", "Infinity"), ("c", "ten"), ("d", "1e300"), ("e", "900")], "invoice_id string, total string")
    model = rows.withColumns({"vendor_id": F.lit("v"), "n": F.lit(5).cast("long"), "avg": F.lit(100.0), "std": F.lit(10.0)})
    assert {r.invoice_id for r in detect_anomalies(model).collect()} == {"d", "e"}
    values = spark.createDataFrame([(1e16,), (-1e16,), (float("nan"),), (float("inf"),), (2.5,), (9.5e14,)], "v double")
    got = [r[0] for r in values.select(round_exact(F.col("v"), 4)).collect()]
    assert got[:2] == [1e16, -1e16] and got[2] != got[2] and got[3:] == [float("inf"), 2.5, 9.5e14]
    assert [r[0] for r in values.select(finite(F.col("v"))).collect()][2:4] == [None, None]


def test_outliers_of_any_size(spark):
    at = dt.datetime(2024, 1, 1)
    new = [("v", "total", v, at + dt.timedelta(hours=i), str(i), None) for i, v in enumerate([1e13, 2e13, 3e13, 1e13, 5.0, 5.0000004, 5.1])]
    checked = spark.createDataFrame(new, "vendor_id string, field string, value double, requested_at timestamp, invoice_id string, error string")
    none = spark.createDataFrame([], "vendor_id string, field string, value double, acked_at timestamp, invoice_id string")
    first = append_outliers(none, checked)
    assert sorted(r.value for r in first.collect()) == [5.0, 5.1, 1e13, 2e13, 3e13]
    assert append_outliers(first, checked).count() == 5


def test_of_equal_outliers_the_newest_counts(spark):
    rows = [("a", "old", 1), ("b", "new", 2)]
    listed = spark.createDataFrame(rows, "id string, vendor string, day int").withColumns({
        "status": F.lit("unreviewed"), "currency": F.lit("USD"), "value": F.lit(5.0), "z_score": F.lit(4.0),
        "detected_at": F.timestamp_seconds(F.col("day") * 86400),
    })
    assert anomaly_aggregates(listed).first().highest_severity_vendor == "new"


def test_ids_without_dashes(spark):
    plain = "0123456789abcdef0123456789ABCDEF"
    got = spark.createDataFrame([(f"{plain}:amount:total",), ("x:amount:total",)], "t string").select(parse_anomaly_id(F.col("t")).alias("p")).collect()
    assert got[0].p.invoice_id == "01234567-89ab-cdef-0123-456789abcdef" and got[0].p.error is None
    assert got[1].p.invoice_id == "x" and got[1].p.error


def test_hashes_must_be_hex(spark):
    texts = ["zzzzzzzzzzzzzzzz", "12zzzzzzzzzzzzzz", "ffffffffffffffff", "00000000000000ff", "ff", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(hash_to_long(F.col("t")).alias("n"), hamming(F.col("t"), F.lit("0" * 16)).alias("d")).collect()
    assert [r.n for r in got] == [None, None, -1, 255, None, None]
    assert [r.d for r in got] == [None, None, 64, 8, None, None]


def test_paging_shows_every_row_once(spark):
    rows = [(5, "a"), (5, "b"), (5, "c"), (4, "d"), (None, "e"), (None, "f"), (None, "g")]
    df, last, seen = spark.createDataFrame(rows, "k int, id string"), None, []
    while page := page_after(df, "k", "id", last, 2).collect():
        seen += [r.id for r in page]
        last = (page[-1].k, page[-1].id)
    assert seen == list("abcdefg")


def test_the_last_promotion_holds(spark):
    rows = spark.createDataFrame([("x1", "x", True), ("x2", "x", False), ("x3", "x", False), ("y1", "y", True), ("z1", "z", False)],
                                 "extraction_id string, invoice_id string, is_current boolean")
    current = lambda chosen: {r.extraction_id for r in promote_current(rows, chosen).where("is_current").collect()}
    assert current(spark.createDataFrame([("x3", 1), ("x2", 2), ("x2", 0)], "extraction_id string, promoted_at int")) == {"x2", "y1"}
    assert current(spark.createDataFrame([("x2",), ("x3",), ("nobody",)], "extraction_id string")) == {"x3", "y1"}


def test_costs_by_tier(spark):
    calls = spark.createDataFrame([("big-Sonnet-4-20250514", 10), ("sonnet", 5), ("own-model", 1)], "model string, input_tokens long").withColumns(
        {c: F.lit(0).cast("long") for c in ("output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}
    )
    assert {r.model: (r.calls, r.input_tokens) for r in usage_by_model(calls).collect()} == {"sonnet": (2, 15), "own-model": (1, 1)}


def test_values_agree_but_for_any_white_space(spark):
    row = spark.createDataFrame([("Acme\n", "\tAcme")], "a string, b string")
    assert row.select(agreement(F.col("a"), F.col("b"), "vendor_name")).first()[0] == 1.0


def test_stored_columns_reach_the_reader(spark, tmp_path):
    from conftest import SMALL
    from ledgerwright.operators.scan import base_relation
    from ledgerwright.plans import testmodel as tm
    from ledgerwright.plans.query import StructuredQuery, filtered
    from ledgerwright.sources.export import read_extractions, write_extractions

    path = str(tmp_path / "ext")
    write_extractions(tm.extractions(spark, SMALL, True), path)
    stored = read_extractions(spark, path)
    clauses = [{"field": "total", "op": "gt", "value": 5}, {"field": "raw_text", "op": "fts_matches", "value": "blue rings"}]
    found = filtered(base_relation(tm.invoices(spark, SMALL), stored, tm.vendors(spark, SMALL)), StructuredQuery.from_dict({"filters": clauses}))
    plan = found.select("invoice_id")._jdf.queryExecution().executedPlan().toString()
    scan = next(part for part in plan.split("FileScan") if "lexemes" in part)
    assert "GreaterThan(total_amount,5.000000000)" in plan
    assert "Python" not in plan and "map<" not in scan.split("ReadSchema")[1].split("\n")[0]
    wanted = filtered(tm.base(spark, SMALL, True), StructuredQuery.from_dict({"filters": clauses}))
    assert {r.invoice_id for r in found.collect()} == {r.invoice_id for r in wanted.collect()}


def test_a_usage_batch_replaces_itself(spark, tmp_path):
    from ledgerwright.sources.export import append_usage

    calls = spark.createDataFrame([("haiku", 1000, 0, None, 0)], "model string, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint")
    for batch in ("1", "2", "2", "1"):
        append_usage(calls, str(tmp_path / "usage"), batch)
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 2


def test_previous_row_of_one_instant_in_one_content(spark):
    from ledgerwright.operators.ordered import previous_row, time_buckets

    rows = [("x" if i % 3 else "y", dt.datetime(2024, 1, 1, i // 200, 0, i % 2), f"{i * 7919 % 4096:04x}{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id string")
    buckets = [*time_buckets("ts", "hour", "second"), F.col("ts"), F.substring("id", 1, 2)]
    got = {r.id: r.p.id if r.p else None for r in previous_row(df, ["k"], buckets, ["ts", "id"], ["id"], "p").collect()}
    for key in "xy":
        ordered = [i for _, i in sorted((t, i) for k, t, i in rows if k == key)]
        assert [got[i] for i in ordered] == [None, *ordered[:-1]]
