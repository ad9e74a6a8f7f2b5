from __future__ import annotations

import duckdb
import pytest

#: Columns of documents, with names that operators use themselves.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, row int, score double"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:4]) + ["en", "s"][len(r) - 2:]), len(r[1] or ""), 7, "k", 1, 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def duck():
    """Runs SQL over pandas tables given by name."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        return con.execute(sql).df()

    return run


def same_rows(left, right):
    """Equal tables but for the order of rows and columns."""
    left, right = left[sorted(left.columns)], right[sorted(right.columns)]
    assert list(left.columns) == list(right.columns)
    key = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).map(lambda v: v.item() if hasattr(v, "item") else v).map(
        lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).itertuples(index=False, name=None)))
    assert key(left) == key(right)
