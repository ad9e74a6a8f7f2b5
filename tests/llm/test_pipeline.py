"""The pipeline stage by stage: each result against a plain computation on the stage's own input."""

from __future__ import annotations

import re

import pandas as pd
import pytest

import corpus_pipeline
from conftest import SMALL
from ledgerwright.llm import toxicity
from ledgerwright.llm.common import stored, table
from ledgerwright.llm.tokens import Encoder
from tests.llm.test_free import brute_components


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, written and read again."""
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_return_documents(spark, stages):
    columns = table(spark, SMALL, "documents").dtypes
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(made.dtypes == columns for name, (_, made) in stages.items() if name != "packing")


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = (df.toPandas() for df in stages["toxicity"])
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id").toxic
    words = re.compile("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron", re.I)
    kept = set(after.doc_id)
    clean = before[before.doc_id.map(labels).eq(0)]
    # Ten toxic documents are all that this table has to learn from.
    assert clean.doc_id.isin(kept).mean() >= 0.85
    toxic = before[before.doc_id.map(labels).eq(1) & before.text.str.contains(words)]
    assert not toxic.doc_id.isin(kept).any()
    model = toxicity.learn(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    score = toxicity.Scorer(model).score(before.text.tolist())
    assert set(before.doc_id[score < 0.5]) == kept


def test_one_of_equal_texts_stays(stages):
    before, after = (df.toPandas() for df in stages["exact_dedup"])
    norm = before.text.fillna("").str.replace(r"[\x20\x09-\x0D]+", "", regex=True)
    best = before.assign(norm=norm, n=before.text.str.len()).sort_values(["n", "doc_id"], ascending=[False, True]).groupby("norm").doc_id.first()
    assert sorted(after.doc_id) == sorted(best)
    assert after.set_index("doc_id").text.to_dict() == before.set_index("doc_id").text.loc[after.doc_id].to_dict()


def test_one_of_near_copies_stays(stages):
    before, after = (df.toPandas() for df in stages["near_dedup"])
    expected = {i for i, n, root in brute_components(list(zip(before.doc_id, before.text)), 5) if n == 0 or i == root}
    assert set(after.doc_id) == expected and len(after) == len(expected)


def test_sources_meet_their_targets(stages):
    before, after = (df.toPandas() for df in stages["mixing"])
    words = lambda df: df.text.str.split().str.len().groupby(df.source).sum()
    size, taken = words(before), words(after)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size.index))}
    target, goal = {}, 1.5 * size.sum()
    while True:
        free = [s for s in size.index if s not in target]
        rate = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rate > 2 * size[s]]
        if not over:
            target |= {s: weight[s] * rate for s in free}
            break
        target |= {s: 2 * size[s] for s in over}
    longest = before.text.str.split().str.len().groupby(before.source).max()
    for source in size.index:
        assert abs(taken.get(source, 0) - target[source]) <= longest[source] / 2 + 1
    assert after.doc_id.value_counts().max() <= 2


def test_everything_is_packed(spark, stages):
    before, after = (df.toPandas() for df in stages["packing"])
    encode = Encoder()
    assert after.length.sum() == sum(len(encode.ids(t)) + 1 for t in before.text)
    assert (after.groupby("sequence_id").length.sum() <= 2048).all()
    result = corpus_pipeline.run(spark, SMALL)
    assert result.columns == stages["packing"][1].columns and result.agg({"length": "sum"}).first()[0] == after.length.sum()


def test_sequences_are_numbered_along_training_time(spark, tmp_path):
    # Files of unlike lengths, the longest last; Spark reads long ones first, and cuts them.
    rows, path = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i // 4))) for i in range(400)], str(tmp_path / "mixed")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 20_000).parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, ("30k", "1k")):
            spark.conf.set(n, value)
        read = spark.read.parquet(path)
        file_of = {r[0]: r[1] for r in read.selectExpr("doc_id", "_metadata.file_name").collect()}
        got = corpus_pipeline.pack(spark, read, SMALL).toPandas()
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    encode = Encoder()
    assert got.length.sum() == sum(len(encode.ids(t)) + 1 for _, t in rows)
    own = got.assign(file=got.doc_id.map(file_of)).groupby("sequence_id").file.agg(["nunique", "first"]).sort_index()
    assert len(set(file_of.values())) > 5 and (own["nunique"] == 1).all() and own["first"].is_monotonic_increasing
    for _, piece in got.groupby("sequence_id"):
        piece = piece.sort_values("offset")
        assert piece.offset.tolist() == [0, *piece.length.cumsum().tolist()[:-1]] and piece.length.sum() <= 2048
