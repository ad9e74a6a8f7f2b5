"""Hard negatives against brute force and against their SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from ledgerwright.llm import hard_negatives as hn
from tests.llm.conftest import same_rows

#: Columns of embeddings, with names that the operator uses itself.
FIELDS = "vec_id bigint, embedding array<float>, label int, row string, bits int, i int, rank int"


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], FIELDS)


def by_hand(rows):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], moved))
    out = []
    order = lambda p: (-p[0], p[1] is None, p[1])
    for k, (anchor, a, label) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, c)), vec_id, own) for i, (vec_id, c, own) in enumerate(used) if i != k]
        near = sorted((s for s in scored if s[2] == label), key=order)[:5]
        for score, positive, _ in near:
            far = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(anchor, positive, r, s[1], score, s[0]) for r, s in enumerate(far, 1)]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def sample(n=260, dims=11, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    rows = [(int(i) * 20, (centre + rng.normal(size=dims)).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(i, [0.5] * dims, i % 2) for i in range(1000, 1030)]  # ties
    rows += [rows[0], rows[0], (200, rows[1][1], 1), (None, [1.0] * dims, 2), (None, [1.0] * dims, 0), (-700, [-0.3] * dims, 9)]
    rows += [(300, None, 1), (400, [1.0] * (dims - 1) + [None], 1), (500, [float("nan")] * dims, 1), (600, [float("inf")] * dims, 1), (700, [1.0] * dims, None)]
    return rows + [(800, [], 1), (801, [2.0, -1.0], 1), (900, [0.0] * dims, 0), (1100, [-1.0] * dims, 2)]


@pytest.mark.parametrize("blocks", [(hn.ANCHOR_BLOCK, hn.CANDIDATE_BLOCK), (5, 37)])
def test_against_brute_force(embeddings, blocks):
    rows = sample()
    got = hn.mine(embeddings(rows), anchor_block=blocks[0], candidate_block=blocks[1]).toPandas()
    want = by_hand(rows)
    assert len(want) > 300 and want["positive_id"].isna().any()
    same_rows(got, want)


def test_against_sql_and_wide_components(embeddings, duck):
    wide = [(i * 50, [float(x) * 10.0**(i % 6) for x in (1, -2, 3.5)], i % 4) for i in range(60)]
    df = embeddings([(v, x, y) for v, x, y in sample() if x is None or len(x) == 11])
    same_rows(hn.mine(df).toPandas(), duck(hn.oracle(), embeddings=df.select("vec_id", "embedding", "label").toPandas()))
    same_rows(hn.mine(embeddings(wide)).toPandas(), by_hand(wide))


def test_tables_without_rows_or_anchors(embeddings):
    assert hn.mine(embeddings([])).count() == 0
    assert hn.mine(embeddings([(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert hn.mine(embeddings([(100, [1.0], 1), (2, [0.5], 2)])).count() == 0
    assert hn.mine(embeddings([(100, [1.0], 1), (101, [1.0], 1), (2, [0.5], 2)])).collect() == [(100, 101, 1, 2, 65536, 32768)]


def test_scores_that_do_not_fit_are_refused(embeddings):
    with pytest.raises(Exception, match="64 bits"):
        hn.mine(embeddings([(100, [1e12, 1.0], 1), (101, [1e12, 1.0], 1)])).collect()


def test_planes_and_subset_sums_give_inner_products():
    rng = np.random.default_rng(1)
    for least, most in ((0, 0), (-1, 0), (0, 1), (-300, 255), (-(2**31), 2**31)):
        planes = hn.plane_count(least, most)
        rows = rng.integers(least, most, (9, 21), endpoint=True)
        bits = hn.packed(rows, planes)
        assert (hn.unpacked(bits)[:, :21] == rows).all()
        other = rng.integers(-5, 5, (4, 24))
        assert (hn.scores(hn.subset_sums(other), bits) == other[:, :21] @ rows.T).all()


def test_best_breaks_ties_by_column():
    score = np.array([[3, 5, 5, 5, 1], [0, 0, 0, 0, 0]], np.int32)
    there = np.array([[True, True, False, True, True], [False, True, False, False, False]])
    r, c = hn.best(score, there, 3)
    assert list(zip(r, c)) == [(0, 1), (0, 3), (0, 0), (1, 1)]
