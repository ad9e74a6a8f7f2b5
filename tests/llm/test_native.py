"""Operators made of DataFrame functions, against the SQL that the queries are checked with."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from conftest import SMALL
from ledgerwright.llm import curriculum, exact_stream, licenses, snapshots
from ledgerwright.llm.queries import QUERIES, SQL
from ledgerwright.session import new_path
from tests.llm.conftest import same_rows

TEXTS = [
    None, "", " \t\n", "a", "Under the MIT\nLicense. under THE mit-license", "Apache License, Version 2.0; cc by-nc cc by nc",
    "under the mit licensé", "İ under the mit license K", "word " * 3000 + "cc by nc", "mit the under license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this program",
    "Licensed under the GNU General Public License, version 3.",
]


def frame(docs):
    return docs.select("doc_id", "text", "lang", "source").toPandas()


@pytest.mark.parametrize("name", sorted(n for n in SQL if n in QUERIES and n.startswith("op")))
def test_queries_agree_with_their_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    tables = {t: pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "conversations", "labels", "embeddings")}
    same_rows(got, duck(SQL[name], **tables))


def test_licenses_on_odd_texts(documents, duck):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(3, "cc by nc"), (3, "cc by nc"), (None, "cc by nc")])
    got = licenses.license_report(licenses.scan_licenses(docs)).toPandas()
    same_rows(got, duck(licenses.oracle(), documents=frame(docs)))
    by_id = got.set_index("doc_id")
    assert by_id.loc[4, "n_base"] == 2 and by_id.loc[4, "base_labels"] == "mit"
    assert by_id.loc[8, "first_word"] == 3000
    assert by_id.loc[10, "labels"] == "mit" and by_id.loc[10, "base_labels"] == ""
    assert by_id.loc[11, "labels"] == "gpl-3"


def test_license_templates_must_fit():
    with pytest.raises(ValueError):
        licenses.scan_licenses(None_frame(), notices=(("x", "w " * 40),))


def None_frame():
    class Frame:
        sparkSession = None
    return Frame()


def test_native_operators_on_an_empty_table(spark, documents):
    docs = documents([(1, "a")]).where("doc_id = 2")
    assert licenses.license_report(licenses.scan_licenses(docs)).count() == 0
    assert curriculum.mix(docs).count() == 0
    assert curriculum.training_documents(docs).count() == 0
    assert exact_stream.keep_one(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert snapshots.render_conversations(turns).count() == 0


def test_mix_targets_positions_and_odd_rows(documents, duck):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(40), "en", rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(400)]
    rows += [(5, None, "en", "a"), (5, None, "en", "a"), (7, "x y", "en", "b"), (900, "w " * 5000, "en", "a")]
    docs = documents(rows)
    mixed = curriculum.mix(docs)
    got = curriculum.mix_report(mixed).toPandas()
    same_rows(got, duck(curriculum.oracle(), documents=frame(docs)))
    assert (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) < 10
    visits = curriculum.in_training_order(mixed).toPandas()
    assert visits.position.between(0, 1).all() and visits.position.is_monotonic_increasing
    taken = visits.groupby(["doc_id", "source"], dropna=False).taken.sum()
    assert taken.sum() == got.taken.sum()


def test_report_follows_the_schedule(documents):
    rows = [(i, "w " * (1 + i % 30), "en", "abc"[i % 3]) for i in range(600)] + [(9000, None, "en", "a"), (9001, "", "en", "b")]
    docs = documents(rows)
    orders = []
    for schedules in (curriculum.SCHEDULES, curriculum.SCHEDULES[::-1][:2]):
        mixed = curriculum.mix(docs, schedules=schedules)
        first = {r.doc_id: r.visits[0].position for r in mixed.collect() if r.visits}
        got = [r.doc_id for r in curriculum.mix_report(mixed).collect()]
        assert sorted(got) == sorted(r[0] for r in rows)
        assert got == sorted(got, key=lambda i: (first.get(i, 2.0), i))
        orders.append(got)
        report = {r.doc_id: r for r in curriculum.mix_report(mixed).collect()}
        for r in mixed.collect():
            told = report[r.doc_id]
            assert told.visits == len(r.visits)
            ends = [round(v.position, 9) for v in r.visits] or [None]
            assert (told.first_position, told.last_position) == (pytest.approx(ends[0], abs=2e-9), pytest.approx(ends[-1], abs=2e-9))
    assert orders[0] != orders[1]


def test_positions_invert_the_cumulative_demand(spark):
    from pyspark.sql import functions as F

    for knots in curriculum.SCHEDULES:
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

        def demand(t):
            done = 0.0
            for a, b in zip(knots, knots[1:]):
                end = min(max(t, a[0]), b[0])
                w = a[1] + (b[1] - a[1]) * (end - a[0]) / (b[0] - a[0])
                done += (end - a[0]) * (a[1] + w) / 2
            return done / whole

        shares = spark.range(101).select((F.col("id") / 100).alias("u"))
        for u, t in shares.select("u", curriculum.position_at(F.col("u"), knots)).collect():
            assert demand(t) == pytest.approx(u, abs=1e-9)


def test_training_documents_keep_columns_and_order(documents):
    rows = [(i, "w " * 50, "en", s) for i in range(60) for s in ("a", "b", "c")]
    docs = documents(rows + [(1, "w " * 50, "en", "a"), (2, None, "en", "a")])
    got = curriculum.training_documents(docs)
    assert got.columns == docs.columns
    words = got.toPandas().groupby("source").text.apply(lambda t: t.str.split().str.len().sum())
    assert abs(words.sum() - 1.5 * 181 * 50) <= 3 * 50


def test_stream_state_over_several_batches(spark, documents, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", "a  b ", "c", None, "", " ", f"t{i}"])) for i in range(300)] + [(None, "ab"), (4, "t4"), (4, "t4")]
    path = str(tmp_path / "documents.parquet")
    documents(rows).repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    stream = exact_stream.described(exact_stream.document_stream(spark, str(tmp_path), docs.schema, 1))
    checkpoint = new_path(spark, "state")
    got = exact_stream.deduplicate(docs, stream, checkpoint).toPandas()
    norm = docs.toPandas()
    groups = norm.assign(norm=norm.text.fillna("").str.replace(r"[\x20\x09-\x0D]+", "", regex=True), n=norm.text.fillna("").str.len())
    best = groups.sort_values(["n", "doc_id"], ascending=[False, True], na_position="last").groupby("norm").doc_id.first()
    sizes = groups.groupby("norm").size()
    assert len(got) == len(norm) and got.kept.sum() == len(sizes)
    import hashlib
    for text, keep in best.items():
        rows_ = got[got.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert (rows_.keep_id == keep).all() and (rows_.group_size == sizes[text]).all() and rows_.kept.sum() == 1
    # Nothing new: the stream goes on from its checkpoint and counts nothing twice.
    again = exact_stream.run_stream(
        exact_stream.described(exact_stream.document_stream(spark, str(tmp_path), docs.schema, 1)), checkpoint
    ).toPandas()
    assert again.rows.sum() == len(norm)


def test_contents_that_share_a_digest_are_told_apart(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    weak = lambda norm: F.length(norm).cast("string")
    path = str(tmp_path / "documents.parquet")
    documents([(1, "ab"), (2, "cd"), (3, "c d"), (4, "xyz"), (5, None), (6, "")]).write.parquet(path)
    docs = spark.read.parquet(path)
    stream = exact_stream.described(exact_stream.document_stream(spark, str(tmp_path), docs.schema), weak)
    got = exact_stream.deduplicate(docs, stream, digest_of=weak).toPandas().set_index("doc_id").sort_index()
    assert got.keep_id.tolist() == [1, 3, 3, 4, 5, 5]
    assert got.group_size.tolist() == [1, 2, 2, 1, 2, 2]


def test_keep_one_keeps_columns(documents):
    docs = documents([(1, "a b"), (2, "ab"), (3, "q"), (3, "q"), (3, "q "), (4, None), (5, "")])
    got = exact_stream.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b"), (3, "q "), (4, None)]


def test_snapshots_collapse(spark, duck):
    long = [(9, t, "user", f"m{t}") for t in range(200)]
    turns = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "user", "a"), (3, 6, "assistant", "b"), (3, 7, "user", "c"),
        (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 1, "assistant", "x"), (5, 1, "assistant", "x"),
        (6, 0, None, None), (7, 0, "", ""), (8, None, "user", "z"), (8, 0, "user", "<|im_end|>"), (None, 0, "user", "n"), (None, 1, "user", "o"),
        *long, *[(10, t, r, x) for _, t, r, x in long[:150]],
    ]
    frame_ = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = snapshots.render_conversations(frame_).toPandas()
    same_rows(got, duck(snapshots.oracle(), conversations=frame_.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})).assign())
    kept = set(got.conv_id.dropna().astype(int))
    assert kept == {3, 4, 6, 8, 9} and got.conv_id.isna().any()
    assert len(got[got.conv_id == 9]) == 4 and "< |im_end|>" in got[got.conv_id == 8].text.iloc[0]
    assert got[got.conv_id == 4].copies.iloc[0] == 2
