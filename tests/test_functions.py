"""Golden cases of the column functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerwright.functions import scoring
from ledgerwright.functions.amounts import agreement, amount, line_items_check, math_reconciles, round_exact, values_match
from ledgerwright.functions.compare import soft_match
from ledgerwright.functions.dates import is_valid_date, parse_period
from ledgerwright.functions.stemming import lexemes, matches_all, query_lexemes, stem
from ledgerwright.functions.text import clean_amount, display_name, normalize_date_text, normalize_name, normalize_token
from ledgerwright.functions.wording import explanation, headline, ratio_text, severity


def one(spark, rows, schema, **columns):
    """Values of the columns over literal rows."""
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


PERIODS = {
    "April 30, 1999": ("1999-04-30", "1999-04-30"), "Feb 28, 20": ("2020-02-28", "2020-02-28"),
    "7/26/99": ("1999-07-26", "1999-07-26"), "October 2020": ("2020-10-01", "2020-10-31"),
    "Feb-99": ("1999-02-01", "1999-02-28"), "9/21/20 - 9/26/20": ("2020-09-21", "2020-09-26"),
    "Jan 2020 — Mar 2020": ("2020-01-01", "2020-03-31"), "1 Jan 2020 to 5 Feb 2021": ("2020-01-01", "2021-02-05"),
    "13/02/2020": ("2020-02-13", "2020-02-13"), "12/31/68": ("2068-12-31", "2068-12-31"),
    "5-March-2020": ("2020-03-05", "2020-03-05"), "  May 5, 20 ": ("2020-05-05", "2020-05-05"),
    "Q3 2020 - 9/26/20": (None, None), "052199": (None, None), "n/a": (None, None), "": (None, None),
    "Feb 30, 2020": (None, None), "5 March 2020": (None, None), "31.12.2020": (None, None), None: (None, None),
}


def test_periods(spark):
    found = one(spark, [(t,) for t in PERIODS], "t string", t=F.col("t"), p=parse_period(F.col("t")))
    assert {t: tuple(p) if p else (None, None) for t, p in found} == PERIODS


def test_valid_dates_are_a_different_list(spark):
    cases = {
        "2020-01-02": True, "31.12.2020": True, "30-12-2020": True, "5 March 2020": True, "5-Mar-20": True,
        "October 2020": False, "5-March-2020": False, "March 5 2020": False, " 1/2/2020": False,
        "1/2.2020": False, "9/21/20 - 9/26/20": False, "": False,
    }
    found = dict(one(spark, [(t,) for t in cases], "t string", t=F.col("t"), v=F.coalesce(is_valid_date(F.col("t")), F.lit(False))))
    assert found == cases


def test_names(spark):
    t = F.col("t")
    rows = [("  ÁCMÉ, Inc.  ",), ("O'BRIEN-SMITH GROUP LLC.",), ("ABC",), ("Mixed CASE Corp",), ("MANAGEMENT SCIENCE ASSOCIATES, INC.",)]
    found = one(spark, rows, "t string", n=normalize_name(t), d=display_name(t))
    assert [r[0] for r in found] == ["ácmé inc", "obriensmith group llc", "abc", "mixed case corp", "management science associates inc"]
    assert [r[1] for r in found][1:] == [
        "O'brien-smith Group LLC.", "ABC", "Mixed CASE Corp", "Management Science Associates, INC.",
    ]


def test_reconciliation(spark):
    cases = [("85", "15", "100", True), ("85", "15", "100.02", True), ("85", "15", "100.03", False),
             (None, "15", "100", True), ("-1", "1", "0", False), ("x", "1", "5", True)]
    args = [amount(F.col(c)) for c in "abc"]
    found = one(spark, [c[:3] for c in cases], "a string, b string, c string", r=math_reconciles(*args))
    assert [r[0] for r in found] == [c[3] for c in cases]


def test_agreement_and_match(spark):
    cases = [(None, None, 1.0, True), ("1.00", "1.01", 1.0, True), ("1.00", "1.02", 0.3, False), ("x", "x", 0.3, False), ("1", None, 0.3, False)]
    found = one(spark, [c[:2] for c in cases], "a string, b string",
                s=agreement(F.col("a"), F.col("b"), "total"), m=values_match(F.col("a"), F.col("b"), "total"))
    assert found == [c[2:] for c in cases]
    assert one(spark, [(" A ", "A")], "a string, b string", s=agreement(F.col("a"), F.col("b"), "currency")) == [(1.0,)]


def test_line_items(spark):
    rows = [([("10.00",), ("5.5",)], "15.50"), ([("10.00",), (None,)], "15.50"), ([], "3"), ([("x",)], "3"), ([("1",)], None)]
    found = one(spark, rows, "items array<struct<line_total:string>>, sub string",
                c=line_items_check(F.col("items"), amount(F.col("sub"))))
    assert [(c["matches"], float(c["delta"])) for (c,) in found] == [(True, 0), (False, -5.5), (True, 0), (False, 0), (True, 0)]


def test_round_exact_is_pythons(spark):
    rng = random.Random(3)
    values = [rng.uniform(-500, 500) for _ in range(300)] + [k / 8 for k in range(-40, 40)] + [2.15, 0.65, 2.675, 1.005, 0.5, 1.5]
    for digits in (0, 1, 2, 4):
        found = one(spark, [(v,) for v in values], "v double", r=round_exact(F.col("v"), digits))
        assert [r[0] for r in found] == [round(v, digits) for v in values]


def test_wording(spark):
    v, m, c, n = (F.col(x) for x in "vmcn")
    rows = [(34062.5, 7900.0, "USD", 11), (0.0, 10.0, "EUR", 1), (5.0, 1000.0, "USD", 2), (9.0, 0.0, "USD", 3)]
    found = one(spark, rows, "v double, m double, c string, n int", h=headline(v, c), e=explanation(v, m, c, n))
    assert found[0] == ("$34,062.50 invoice", "4.3× this vendor's average ($7,900 across 11 prior invoices)")
    assert found[1] == ("EUR 0.00 invoice", "Zero or missing total against this vendor's EUR 10 average (1 prior invoice)")
    assert found[2][1] == "200× smaller than this vendor's average ($1,000 across 2 prior invoices)"
    assert found[3][1] == "No prior history for this vendor — first material extraction (3 prior invoices)"
    ratios = one(spark, [(1234.4,), (12.5,), (3.25,)], "r double", t=ratio_text(F.col("r")), s=severity(F.col("r")))
    assert ratios == [("1,234×", "high"), ("12×", "high"), ("3.2×", "medium")]


def test_history_buckets(spark):
    rows = [(str(t), n, 100.0, s) for t, n, s in ((105, 3, 10.0), (115, 3, 10.0), (125, 3, 10.0), (130, 3, 10.0), (105, 2, 10.0), (105, 3, 0.0))]
    found = one(spark, rows + [("x", 5, 100.0, 10.0)], "t string, n int, m double, s double",
                h=scoring.history_score(*[F.col(c) for c in "tnms"]))
    assert [r[0] for r in found] == [1.0, 0.85, 0.6, 0.3, None, None, None]


def test_hashes(spark):
    rows = [("ffffffffffffffff", "0000000000000000"), ("00000000000000ff", "00000000000000f0"), ("ff", "ffff")]
    found = one(spark, rows, "a string, b string", d=scoring.hamming(F.col("a"), F.col("b")))
    assert [r[0] for r in found] == [64, 4, None]
    kinds = one(spark, [(True, 3), (True, 9), (False, 5), (False, 6), (True, None)], "c boolean, d int",
                k=scoring.duplicate_class(F.col("c"), F.col("d")))
    assert [tuple(k) if k else None for (k,) in kinds] == [
        ("both", 1.0), ("content_fingerprint", 1.0), ("perceptual_hash", 1 - 5 / 64), None, ("content_fingerprint", 1.0)]


def test_cost(spark):
    usage = {k: F.col(k) for k in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}
    rows = [("x-Sonnet-y", 1_000_000, 1_000_000, 1_000_000, 1_000_000), ("local", 9, 9, 9, 9), ("haiku", 1000, None, None, None)]
    found = one(spark, rows, "model string, " + ", ".join(f"{k} bigint" for k in usage), c=scoring.usage_cost(F.col("model"), usage))
    assert [round(r[0], 6) for r in found] == [22.05, 0.0, 0.001]


def test_cleaning(spark):
    t = F.col("t")
    found = one(spark, [("US$ 1,234.50 -",), ("12 . 03 / 2020 |",)], "t string", a=clean_amount(t), d=normalize_date_text(t))
    assert found[0][0] == "1234.50"
    assert found[1][1] == "12/03/2020"
    assert one(spark, [(" Total:;. ",)], "t string", n=normalize_token(t)) == [("total",)]


@pytest.mark.parametrize("field,want,got,ok", [
    ("total", "$1,000", "1005", True), ("total", "1000", "1020", False), ("currency", "€", "eur", True),
    ("invoice_date", "12.03.2020", "12/03/2020 x", True), ("vendor_name", "Acme", "ACME Corp", True),
    ("vendor_name", "Acme", None, False), ("total", "abc", "1", False),
])
def test_soft_match(spark, field, want, got, ok):
    found = one(spark, [(field, want, got)], "f string, w string, g string", m=soft_match(F.col("f"), F.col("w"), F.col("g")))
    assert found == [(ok,)]


# Pairs from the published vocabulary of the Porter2 stemmer.
STEMS = {
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consignment": "consign",
    "knackeries": "knackeri", "knaves": "knave", "knightly": "knight", "generously": "generous",
    "communication": "communic", "ties": "tie", "cries": "cri", "hopping": "hop", "hoping": "hope",
    "luxuriated": "luxuri", "sky": "sky", "dying": "die", "news": "news", "exceed": "exceed",
    "relational": "relat", "national": "nation", "happily": "happili", "payments": "payment", "invoices": "invoic",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_full_text(spark):
    rows = [("The invoices were paid in full",), ("An invoice, unpaid",), ("Payment of the consignments",)]
    df = spark.createDataFrame(rows, "t string").withColumn("l", lexemes(F.col("t")))
    hits = lambda q: [r.t for r in df.where(matches_all(F.col("l"), q)).collect()]
    assert hits("invoicing paid") == [rows[0][0]]
    assert len(hits("an invoice")) == 2
    assert hits("the of in") == []
    assert query_lexemes("consignment payments") == ["consign", "payment"]
