"""Operators against plain Python on small tables."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerwright.operators import anomalies as an
from ledgerwright.operators.actions import apply_actions, confirm_events
from ledgerwright.operators.duplicates import detect_duplicates, near_duplicates, nearest_earlier_hash, pick_blocks
from ledgerwright.operators.ordered import previous_row, running_totals, time_buckets
from ledgerwright.operators.rollup import vendor_rollup
from ledgerwright.operators.usage import budget_cutoff
from ledgerwright.operators.vendors import fold_confirms, point_in_time_stats, resolve_vendors, step, vendor_stats

T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"v{rng.randrange(5)}", at(rng.randrange(600) // 7 * 7), i, rng.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, x int")
    out = running_totals(df, ["k"], time_buckets("ts", "day", "hour"), ["ts", "id"], {"before": F.col("x")})
    found = {r.id: r.before for r in out.collect()}
    for k, ts, i, _ in rows:
        assert found[i] == sum(x for k2, t2, i2, x in rows if k2 == k and (t2, i2) < (ts, i))


def test_previous_row(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), at(rng.randrange(500)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    out = previous_row(df, ["k"], [*time_buckets("ts", "hour", "second"), F.col("ts")], ["ts", "id"], ["id"], "p")
    found = {r.id: r.p.id if r.p else None for r in out.collect()}
    for k, ts, i in rows:
        earlier = [(t2, i2) for k2, t2, i2 in rows if k2 == k and (t2, i2) < (ts, i)]
        assert found[i] == (max(earlier)[1] if earlier else None)


def test_budget(spark):
    rows = [(f"c{i}", at(i * 13), 1.0) for i in range(20)]
    log = spark.createDataFrame(rows, "id string, created_at timestamp, cost_usd double")
    out = {r.id: (r.spent_before, r.refused) for r in budget_cutoff(log, 5.0).collect()}
    assert out == {f"c{i}": (float(i), i >= 5) for i in range(20)}


def brute_nearest(rows, errors=5):
    out = {}
    for i, (me, ts, h) in enumerate(rows):
        best = None
        for other, t2, h2 in rows:
            if (t2, other) < (ts, me):
                d = bin((h ^ h2) & (1 << 64) - 1).count("1")
                if d <= errors and (best is None or (d, t2, other) < best):
                    best = (d, t2, other)
        if best:
            out[me] = (best[2], best[0])
    return out


def hash_rows(n, seed, centres=4, spread=7):
    """Hashes around a few centres, so that copies, near copies and hot keys all occur."""
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centres)] + [0]
    rows = []
    for i in range(n):
        h = rng.choice(middle)
        for _ in range(rng.randrange(spread)):
            h ^= 1 << rng.randrange(64)
        rows.append((f"i{i:04d}", at(rng.randrange(n)), h - (1 << 64) if h >> 63 else h))
    return rows


@pytest.mark.parametrize("blocks,hot_key", [(6, 10_000), (8, 10_000), (6, 3), (7, 20), (None, 2048)])
def test_near_duplicates_are_exact(spark, blocks, hot_key):
    rows = hash_rows(300, 5)
    df = spark.createDataFrame(rows, "invoice_id string, uploaded_at timestamp, hash_bits bigint")
    found = {r.invoice_id: (r.near_id, r.distance) for r in near_duplicates(df, blocks=blocks, hot_key=hot_key).collect()}
    assert found == brute_nearest(rows)


def test_probe_restricts_the_rows_asked_for(spark):
    rows = hash_rows(120, 9)
    df = spark.createDataFrame(rows, "invoice_id string, uploaded_at timestamp, hash_bits bigint").withColumn(
        "asked", F.col("invoice_id") > "i0060"
    )
    found = {r.invoice_id: (r.near_id, r.distance) for r in near_duplicates(df, probe="asked").collect()}
    assert found == {k: v for k, v in brute_nearest(rows).items() if k > "i0060"}


def test_blocks_grow_with_the_table():
    assert [pick_blocks(n) for n in (10**4, 10**6, 10**8, 10**10)] == sorted(pick_blocks(n) for n in (10**4, 10**6, 10**8, 10**10))
    assert pick_blocks(1000) == 6 and pick_blocks(10**9) >= 8


def test_duplicate_rules(spark):
    rows = [
        ("a", at(0), "f1", "0000000000000000", []), ("b", at(1), "f2", "0000000000000003", []),
        ("c", at(2), "f1", "0000000000000000", []), ("d", at(3), "f1", "0000000000000000", ["c"]),
        ("e", at(4), "f3", "0000000000000001", ["a"]), ("g", at(5), "f4", None, []),
        ("h", at(6), "f5", "ffffffffffffffff", []),
    ]
    df = spark.createDataFrame(rows, "invoice_id string, uploaded_at timestamp, file_hash string, perceptual_hash string, duplicate_dismissals array<string>")
    found = {r.invoice_id: (r.duplicate_id, r.match_method, r.similarity) for r in detect_duplicates(df).collect()}
    # d has c dismissed and e has a dismissed: neither falls to its next best.
    assert found == {"b": ("a", "perceptual_hash", 1 - 2 / 64), "c": ("a", "both", 1.0)}


def test_vendor_statistics_and_outlier(spark):
    history = [34000.0, 34500.0, 34250.0]
    rows = [("v", f"i{k}", at(k), x) for k, x in enumerate(history)] + [("v", "new", at(9), 89000.0)]
    df = spark.createDataFrame(rows, "vendor_id string, invoice_id string, uploaded_at timestamp, total double")
    past = df.where("invoice_id <> 'new'")
    stats = vendor_stats(past).collect()[0]
    assert (stats.n, stats.avg, stats["std"]) == (3, 34250.0, 250.0)
    folded = fold_confirms(None, past).collect()[0]
    assert (folded.n, folded.avg, folded["std"]) == (3, 34250.0, 250.0)
    scored = point_in_time_stats(df, F.col("invoice_id") != "new")
    reason = an.detect_anomalies(scored).collect()[0]
    assert (reason.invoice_id, reason.anomaly.z_score, reason.anomaly.vendor_mean) == ("new", 219.0, 34250.0)


def test_equal_totals_have_no_deviation(spark):
    rows = [("v", f"i{k}", at(k * 50), 0.1) for k in range(40)]
    df = spark.createDataFrame(rows, "vendor_id string, invoice_id string, uploaded_at timestamp, total double")
    assert {r["std"] for r in point_in_time_stats(df, F.lit(True)).collect()} == {0.0}


def test_fold_continues_from_its_state(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"i{k:03d}", at(k), round(rng.uniform(1, 900), 2)) for k in range(120)]
    df = spark.createDataFrame(rows, "vendor_id string, invoice_id string, uploaded_at timestamp, total double")
    cut = F.col("uploaded_at") < at(70)
    found = {r.vendor_id: (r.n, r.avg, r["std"]) for r in fold_confirms(fold_confirms(None, df.where(cut)), df.where(~cut)).collect()}
    for v in "ab":
        acc = (0, 0.0, 0.0, 0.0)
        for _, _, _, x in (r for r in rows if r[0] == v):
            acc = step(acc[0], acc[1], acc[3], x)
        assert found[v] == acc[:3]
        assert abs(acc[1] - statistics.mean(r[3] for r in rows if r[0] == v)) < 0.05


def test_acked_outliers(spark):
    rng = random.Random(6)
    acked = [(rng.choice("abc"), 10 ** rng.uniform(-1, 6)) for _ in range(150)] + [("a", 0.0), ("a", -5.0)]
    rows = [(rng.choice("abcd"), f"i{k}", 10 ** rng.uniform(-1, 6)) for k in range(300)]
    rows += [("a", "edge-low", 90.0), ("a", "edge-high", 110.0)]
    acked += [("a", 100.0)]
    out = spark.createDataFrame(rows, "vendor_id string, invoice_id string, total double")
    ack = spark.createDataFrame(acked, "vendor_id string, value double")
    found = {r.invoice_id for r in an.drop_acked(out, ack).collect()}
    assert found == {i for v, i, x in rows if not any(w == v and a > 0 and abs(x - a) / a < 0.10 for w, a in acked)}


def test_vendor_resolution(spark):
    vendors = spark.createDataFrame([("v1", "Acme Inc", "acme inc")], "vendor_id string, name string, normalized_name string")
    docs = [("1", "ACME, INC.", at(5)), ("2", "NEW VENDOR LLC", at(2)), ("3", "new vendor llc", at(1)), ("4", "", at(3)), ("5", None, at(4))]
    placed, known = resolve_vendors(spark.createDataFrame(docs, "invoice_id string, vendor_name string, uploaded_at timestamp"), vendors)
    ids = {r.invoice_id: r.vendor_id for r in placed.collect()}
    names = {r.vendor_id: r.name for r in known.collect()}
    assert ids["1"] == "v1" and ids["2"] == ids["3"] and ids["4"] == ids["5"]
    assert names[ids["2"]] == "new vendor llc" and names[ids["4"]] == "Unknown" and len(names) == 3


def test_actions(spark):
    invoices = spark.createDataFrame(
        [("a", "v", "pending", ["x"]), ("b", "v", "pending", None), ("c", None, "pending", [])],
        "invoice_id string, vendor_id string, review_status string, duplicate_dismissals array<string>")
    acts = [("1", at(1), "a", "confirm", None), ("2", at(2), "a", "dismiss_duplicate", "y"), ("3", at(3), "a", "dismiss_duplicate", "x"),
            ("4", at(4), "a", "dismiss_duplicate", "y"), ("5", at(1), "b", "confirm", None), ("6", at(2), "b", "mark_unprocessable", None),
            ("7", at(5), "a", "confirm", None)]
    actions = spark.createDataFrame(acts, "action_id string, acted_at timestamp, invoice_id string, action string, against_id string")
    found = {r.invoice_id: (r.review_status, r.duplicate_dismissals) for r in apply_actions(invoices, actions).collect()}
    assert found == {"a": ("confirmed", ["x", "y"]), "b": ("unprocessable", []), "c": ("pending", [])}
    base = spark.createDataFrame([("a", "v", {"total": ("9",)})], "invoice_id string, vendor_id string, fields map<string,struct<value:string>>")
    events = confirm_events(actions, base).collect()
    assert [(e.invoice_id, e.total, e.confirmed_at) for e in events] == [("a", 9.0, at(1))]


def invoice_base(spark, rows):
    """Base relation from (id, vendor_id, vendor, minutes, status, total, reasons-z)."""
    made = [(i, v, n, at(m), s, {"total": (t,), "currency": ("USD",), "vendor_name": (n,), "invoice_date": (f"2024-01-{m:02d}",)},
             {"total": 0.9}, "needs_review", [("anomaly", "total", 7900.0, z)] if z else []) for i, v, n, m, s, t, z in rows]
    return spark.createDataFrame(made, """invoice_id string, vendor_id string, vendor_table_name string, uploaded_at timestamp,
        review_status string, fields map<string,struct<value:string>>, confidence map<string,double>, state string,
        reasons array<struct<type:string,field:string,vendor_mean:double,z_score:double>>""")


def test_anomaly_listing(spark):
    rows = [(f"p{k}", "v", "Acme", k, "confirmed", str(7900 + k), None) for k in range(1, 14)]
    rows += [("bad", "v", "Acme", 14, "confirmed", "n/a", None), ("odd", "v", "Acme", 20, "pending", "34062.50", 6.0)]
    acks = spark.createDataFrame([], "invoice_id string, subtype string, field string, acknowledged_at timestamp, user_id string, notes string")
    listed = an.list_anomalies(invoice_base(spark, rows), acks)
    row = listed.collect()[0]
    # The newest eleven are taken first, then the one without a number drops out.
    assert [h.value for h in row.history] == [7900.0 + k for k in range(4, 14)] + [34062.5]
    assert [h.current for h in row.history] == [False] * 10 + [True]
    assert (row.severity, row.headline, row.status) == ("high", "$34,062.50 invoice", "unreviewed")
    assert row["sub"] == "4.3× this vendor's average ($7,900 across 10 prior invoices)"
    empty = an.anomaly_aggregates(listed.where("false")).collect()[0]
    assert tuple(empty) == (0.0, "USD", 0, None, None)


def test_acks_keep_the_first(spark):
    uuid = "00000000-0000-0000-0000-00000000000a"
    listed = spark.createDataFrame([(f"{uuid}:amount:total", 5.0, "v")], "id string, value double, vendor_id string")
    asked = [(f"{uuid}:amount:total", at(2), "u2", None), (f"{uuid}:amount:total", at(1), "u1", None), ("zzz", at(1), "u", None),
             (uuid.replace("a", "b") + ":amount:total", at(1), "u", None), (f"{uuid}:pattern:total", at(1), "u", None)]
    checked = an.check_requests(spark.createDataFrame(asked, "id string, requested_at timestamp, user_id string, notes string"), listed)
    none = spark.createDataFrame([], "invoice_id string, subtype string, field string, acknowledged_at timestamp, user_id string, notes string")
    acks = an.acknowledge(none, checked)
    assert [(r.invoice_id, r.user_id) for r in acks.collect()] == [(uuid, "u1")]
    assert {r.error for r in an.failed_requests(checked).collect()} == {
        "malformed anomaly id: 'zzz'", "not_found", "unsupported anomaly subtype: 'pattern'"}
    values = spark.createDataFrame([("v", "total", 5.0000004, at(0), "old")], "vendor_id string, field string, value double, acked_at timestamp, invoice_id string")
    assert [r.invoice_id for r in an.append_outliers(values, checked).collect()] == ["old"]


def test_vendor_trend(spark):
    rows = [("a1", "a", "A", 1, "pending", "100", None), ("a2", "a", "A", 2, "pending", "100", None), ("a3", "a", "A", 3, "pending", "130", None),
            ("b1", "b", " B", 1, "confirmed", "10", None), ("c1", "c", "C", 1, "pending", "100", None), ("c2", "c", "C ", 2, "pending", "80", None),
            ("d1", "d", "D", 1, "pending", "100", None), ("d2", "d", "D", 2, "pending", "-7", None), ("d3", "d", "D", 3, "pending", "110", None)]
    found = {r.name: (r.invoices, r.total_spent, r.trend, r.last_seen, r.anomalies) for r in vendor_rollup(invoice_base(spark, rows)).collect()}
    # A: the older half is 100, the recent half (100 + 130) / 2.
    assert found == {"A": (3, 330.0, "stable", "2024-01-03", 3), "B": (1, 10.0, "new", "2024-01-01", 0),
                     "C": (2, 180.0, "declining", "2024-01-02", 2), "D": (3, 210.0, "stable", "2024-01-03", 3)}
