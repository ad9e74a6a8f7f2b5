"""Scoring of results against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.compare import soft_match

FLAGS = ("vendor_ok", "total_ok", "state_ok", "reasons_ok")


def judge(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Correctness flags per invoice present on both sides.

    truth: invoice_id, expected_vendor, expected_total, expected_state, expected_reasons,
    unprocessable. results: invoice_id, vendor_name, total, state, reason_types, confidence_min.
    """
    both = truth.join(results, "invoice_id")
    gone = F.coalesce(F.col("unprocessable"), F.lit(False))
    vendor = F.col("vendor_name").eqNullSafe(F.col("expected_vendor")) | (
        gone & (F.col("vendor_name").isNull() | (F.col("vendor_name") == "Unknown"))
    )
    total = F.col("total").try_cast("double")
    total_ok = F.when(gone, F.coalesce(total, F.lit(0.0)) == 0).otherwise(
        F.coalesce(F.abs(total - F.col("expected_total")) <= 0.50, F.lit(False))
    )
    covered = F.size(F.array_except("expected_reasons", "reason_types")) == 0
    return both.withColumns({
        "vendor_ok": vendor,
        "total_ok": total_ok,
        "state_ok": F.coalesce(F.col("state"), F.lit("unknown")) == F.col("expected_state"),
        "reasons_ok": covered,
        "confidence_min": F.coalesce("confidence_min", F.lit(0.0)),
    })


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def accuracy(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count("*").alias("n"), _rate("vendor_ok").alias("vendor_accuracy"),
        _rate("total_ok").alias("total_accuracy"), _rate("state_ok").alias("state_accuracy"),
        _rate("reasons_ok").alias("reason_recall"),
    )


def accuracy_by_state(judged: DataFrame) -> DataFrame:
    return judged.groupBy("expected_state").agg(
        F.count("*").alias("n"), _rate("state_ok").alias("state_accuracy"),
        _rate("reasons_ok").alias("reason_recall"),
    )


def confusion(judged: DataFrame, states: list[str]) -> DataFrame:
    """Counts by expected (rows) and predicted (columns) state, 0 where none."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in states]
    return judged.groupBy("expected_state").agg(*counts)


def calibration(judged: DataFrame) -> DataFrame:
    """Share of wholly correct rows per tenth of confidence; failed extractions left out."""
    kept = judged.where(
        ~(
            (F.col("expected_state") == fixed.NEEDS_REVIEW)
            & F.array_contains("expected_reasons", "extraction_failed")
        )
    )
    right = F.col(FLAGS[0])
    for flag in FLAGS[1:]:
        right = right & F.col(flag)
    bucket = F.least(F.floor(F.col("confidence_min") * 10), F.lit(9)).cast("int")
    return (
        kept.groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("correct_rate"))
        .withColumn("confidence_mid", (F.col("bucket") + 0.5) / 10)
    )


def errors(judged: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows with any flag false."""
    wrong = ~F.col(FLAGS[0])
    for flag in FLAGS[1:]:
        wrong = wrong | ~F.col(flag)
    return judged.where(wrong).orderBy("invoice_id").limit(limit)


def membership(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two key sets with the flags expected and actual."""
    e = expected.select(*keys).distinct().withColumn("expected", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("actual", F.lit(True))
    joined = e.join(a, keys, "full_outer")
    return joined.na.fill(False, ["expected", "actual"])


def _set_counts(members: DataFrame, cases: DataFrame, case: str) -> DataFrame:
    counts = members.groupBy(case).agg(
        F.count_if(F.col("expected") & F.col("actual")).alias("tp"),
        F.count_if(~F.col("expected") & F.col("actual")).alias("fp"),
        F.count_if(F.col("expected") & ~F.col("actual")).alias("fn"),
    )
    return cases.join(counts, case, "left").na.fill(0, ["tp", "fp", "fn"])


def search_scores(
    cases: DataFrame, expected: DataFrame, actual: DataFrame, case: str = "case", item: str = "invoice_id"
) -> DataFrame:
    """Precision, recall and exactness of the ids found per case.

    Nothing found: precision 1 if nothing was expected, else 0. Nothing expected: recall 1.
    """
    counted = _set_counts(membership(expected, actual, [case, item]), cases, case)
    found, wanted = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return counted.withColumns({
        "precision": F.when(found > 0, F.try_divide(F.col("tp"), found))
        .when(wanted == 0, 1.0).otherwise(0.0),
        "recall": F.when(wanted > 0, F.try_divide(F.col("tp"), wanted)).otherwise(1.0),
        "exact": (F.col("fp") == 0) & (F.col("fn") == 0),
    })


def clause_scores(cases: DataFrame) -> DataFrame:
    """Precision and recall of filter clauses per case.

    cases: case, expected and actual (arrays of structs field, op, value),
    expect_untranslated, untranslated. With both sides empty both are 1; with one side
    empty precision is 0 if something was produced and recall is 0 if something was due.
    """
    e, a = F.array_distinct("expected"), F.array_distinct("actual")
    shared = F.size(F.array_intersect(e, a))
    both = (F.size(e) > 0) & (F.size(a) > 0)
    intent = F.col("untranslated") == F.col("expect_untranslated")
    return cases.withColumns({
        "precision": F.when(both, F.try_divide(shared, F.size(a)))
        .otherwise(F.when(F.size(a) > 0, 0.0).otherwise(1.0)),
        "recall": F.when(both, F.try_divide(shared, F.size(e)))
        .otherwise(F.when(F.size(e) > 0, 0.0).otherwise(1.0)),
        "intent_ok": intent,
        "exact": (F.size(F.array_except(e, a)) == 0) & (F.size(F.array_except(a, e)) == 0) & intent,
    })


def clause_recall_by_field(cases: DataFrame) -> DataFrame:
    rows = cases.select("actual", F.explode(F.array_distinct("expected")).alias("x"))
    return rows.groupBy(F.col("x.field").alias("field")).agg(
        F.count("*").alias("expected"),
        F.count_if(F.array_contains("actual", F.col("x"))).alias("recalled"),
    ).withColumn("rate", F.col("recalled") / F.col("expected"))


def macro(scores: DataFrame) -> DataFrame:
    """Unweighted means over the cases."""
    return scores.agg(
        F.count("*").alias("cases"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg(F.col("exact").cast("double")).alias("exact_rate"),
    )


def compare_fields(truth: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, field, expected, actual, ok) of annotated fields; a missing value is wrong.

    truth: doc_id, field, text. results: doc_id, values (map of field to text). Documents
    without a result are left out.
    """
    return truth.join(results, "doc_id").select(
        "doc_id", "field", F.col("text").alias("expected"),
        F.try_element_at("values", F.col("field")).alias("actual"),
    ).withColumn("ok", soft_match(F.col("field"), F.col("expected"), F.col("actual")))


def field_accuracy(compared: DataFrame) -> DataFrame:
    """ok, total and rate per field, with an `(all)` row over everything."""
    rolled = compared.rollup("field").agg(
        F.count_if("ok").alias("ok"), F.count("*").alias("total"), F.grouping("field").alias("__g")
    )
    return rolled.select(
        F.when(F.col("__g") == 1, "(all)").otherwise(F.col("field")).alias("field"),
        "ok", "total", F.try_divide("ok", "total").alias("rate"),
    )


def documents_with_mismatch(compared: DataFrame) -> DataFrame:
    return compared.agg(F.countDistinct(F.when(~F.col("ok"), F.col("doc_id"))).alias("documents"))
