"""The filter audit against counting by hand over all orders, and against its SQL."""

from __future__ import annotations

import re
from itertools import permutations

import pandas as pd
import pytest

from ledgerwright.llm import filter_audit
from tests.llm.conftest import same_rows

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (0, LONG, "en", "a"), (1, LONG, "en", "a"), (2, LONG, "en", "b"), (3, None, "en", "a"), (4, "", "en", None), (5, "same " * 60, "en", ""),
    (6, "SHOUT " * 10, "en", "a"), (7, LONG + " #", "en", "a"), (8, LONG + " $ " + "X" * 40, "en", "b"), (9, " " + "w " * 80 + "\t\n", "en", "b"),
    (None, LONG, "en", "a"), (None, LONG, "en", "a"), (12, "é" * 19 + "A", "en", "c"), (13, "é" * 19 + "AA", "en", "c"), (14, " \t ", "en", "c"),
    (15, "very long " * 20_000, "en", "c"), (2, LONG, "en", "b"), (1, LONG, "en", "b"), (16, "x", "en", "Z"), (17, "same " * 60, "en", "a"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (7, 1, 1), (17, 0, 1), (99, 1, 1)]


def by_hand(rows, labels):
    def fails(i):
        doc_id, text, *_ = rows[i]
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = set()
        if len(words) < 50:
            out.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            out.add("C")
        if re.search(r"[#$%&*|]", text):
            out.add("D")
        if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows):
            out.add("E")
        return out

    failed = [fails(i) for i in range(len(rows))]
    has = lambda doc_id, k: doc_id is not None and any(x[0] == doc_id and x[k] == 1 for x in labels)
    out = []
    for part in {r[3] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[3] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        at = len(out)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in failed[i]]
                before = set(own) - set(left)
                left = [i for i in left if letter not in failed[i]]
                shapley[letter] += len(gone)
                out.append({
                    "part": part, "filter_order": "".join(order), "step": step, "kept": len(left), "removed": len(gone),
                    "redundant": sum(letter in failed[i] for i in before), "unique_fails": sum(failed[i] == {letter} for i in own),
                    "good_lost": sum(has(rows[i][0], 1) for i in gone), "toxic_lost": sum(has(rows[i][0], 2) for i in gone),
                })
        for row in out[at:]:
            row["shapley"] = shapley[row["filter_order"][row["step"] - 1]]
    return pd.DataFrame(out)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_audit_against_counting_by_hand(documents, labels, duck):
    docs, marks = documents(ROWS), labels(LABELS)
    got = filter_audit.audit(docs, marks).toPandas()
    assert len(got) == 600 * 5
    same_rows(got, by_hand(ROWS, LABELS))
    same_rows(got, duck(filter_audit.oracle(), documents=docs.toPandas(), labels=marks.toPandas()))


def test_audit_of_tables_without_rows_or_labels(documents, labels, spark):
    assert filter_audit.audit(documents([]), labels(LABELS)).count() == 0
    got = filter_audit.audit(documents(ROWS), labels([])).toPandas()
    same_rows(got, by_hand(ROWS, []))
    assert spark.conf.get(filter_audit.ROW_LIMIT) == "1000000"


def test_more_parts_than_the_standing_row_limit_allows(spark):
    cells = spark.range(3200).selectExpr("cast(id as string) AS part", "array(named_struct('mask', 3, 'n', 2L, 'good', 1L, 'toxic', 0L)) AS cells")
    steps = filter_audit.prefix_steps(cells)
    assert steps.count() == 3200 * 325
    assert steps.where("prefix = 'BA' AND kept = 0 AND removed = 0 AND redundant = 2").count() == 3200
