"""Operators with Python inside their tasks, against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from conftest import SMALL
from ledgerwright.llm import components, fingerprints, gru, language, neardup, packing, rollups, toxicity
from ledgerwright.llm.common import keep_keys, shingle_hashes, table, word_hashes
from ledgerwright.llm.queries import QUERIES
from ledgerwright.llm.tokens import Encoder, encoder, vocabulary_path
from ledgerwright.session import new_path

BIG = 2**62 + 1  # an id that a double cannot hold
ODD = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "one"), (None, "two words"), (BIG, "ünïcode ﬁ 中文字 😀 text"), (7, "x " * 30_000)]


def collected(df):
    """The rows as pandas columns, ids as exact integers next to nulls."""
    rows = df.collect()
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object if c == "doc_id" else None) for c in df.columns})


def shingles(text, size):
    words = (text or "").encode().lower().split()
    n = max(len(words) - size + 1, 1) if words else 0
    return {tuple(words[i:i + size]) for i in range(n)}


def brute_components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def families(seed, groups, copies, words=120, edits=6):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_near_duplicates_equal_brute_force(documents):
    rows = families(1, 5, 30) + [(1000 + i, t) for i, t in ODD[:5]] + [(None, None), (None, "two words"), (1004, "one")]
    got = neardup.near_duplicates(documents(rows), size=4)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=repr) == brute_components(rows, 4)


@pytest.mark.parametrize("small, block", [(2, 2_048), (2, 16)])
def test_large_buckets_lose_no_link(documents, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = families(2, 2, 70, edits=8)
    got = neardup.near_duplicates(documents(rows), size=4, star_rounds=0)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=repr) == brute_components(rows, 4)


def test_bayesian_bounds():
    need = neardup.needed_matches(0.8)
    rng = np.random.default_rng(0)
    n = neardup.BATCH * neardup.BATCHES
    a = rng.integers(0, 256, (4000, n), dtype=np.uint8)
    at = lambda s: np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(neardup.surviving(a, at(0.8), need)[0]) == 4000
    assert len(neardup.surviving(a, at(0.4), need)[0]) == 0
    assert (1 - 0.8**neardup.ROWS) ** neardup.bands_for(0.8) <= neardup.MISS


def test_keep_one_keeps_columns_and_clean_rows(documents):
    docs = documents(families(4, 3, 6, edits=2) + [(100, None), (101, ""), (BIG, "alone")])
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {0, 6, 12, 100, 101, BIG}


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    roots = spark.range(300).selectExpr("id AS node", "id AS root")
    got = {r.node: r.root for r in components.merge(roots, spark.createDataFrame(edges + [(None, 3), (5, 9999)], "a bigint, b bigint")).collect()}
    parent = list(range(300))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[find(a)] = find(b)
    assert len(got) == 300
    for a, b in itertools.combinations(range(300), 2):
        assert (find(a) == find(b)) == (got[a] == got[b])


def test_keep_keys_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    import ledgerwright.llm.common as common

    docs, keys = documents([(1, "a"), (None, "b"), (3, "c")]), spark.createDataFrame([(None,), (3,)], "doc_id bigint")
    for bound in (0, 1 << 20):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        assert sorted(r.text for r in keep_keys(docs, keys, "doc_id").collect()) == ["b", "c"]
        assert [r.text for r in keep_keys(docs, keys, "doc_id", how="left_anti").collect()] == ["a"]


def test_rollup_equals_recount(spark):
    docs, labels = (table(spark, SMALL, t).toPandas() for t in ("documents", "labels"))
    encode = Encoder()
    toxic = set(labels[labels.toxic == 1].doc_id)
    poor = set(labels[labels.quality == 0].doc_id)
    expected: dict = {}
    for d in docs.itertuples():
        if d.doc_id in toxic:
            continue
        text = re.sub(r"[\x20\x09-\x0D]+", " ", d.text) if d.doc_id in poor else d.text
        for version, n in (("byte_bpe_50k", len(encode.ids(text))), ("words-1", len(text.split()))):
            have = expected.setdefault((d.source, d.lang, version), [0, 0])
            have[0] += 1
            have[1] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.documents, r.tokens] for r in QUERIES["op2_token_rollup"](spark, SMALL).collect()}
    assert got == expected


def test_rollup_refuses_batches_out_of_order(spark):
    store = rollups.TokenRollup(spark, new_path(spark, "rollup"))
    batch = lambda *rows: spark.createDataFrame(list(rows), rollups.CHANGES)
    one = batch((1, "insert", 1, "a", "en", "v", 7))
    assert store.commit(2, one)
    with pytest.raises(ValueError, match="batch 1"):
        store.commit(1, one)
    # Deltas of a batch that broke off are not read.
    one.selectExpr("source", "lang", "tokenizer_version", "tokens AS documents", "tokens").write.parquet(f"{store.path}/deltas/batch=3")
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 1, 7)] and store.batches() == [2]
    assert store.commit(3, batch((1, "delete", 1, None, None, "v", 0))) and store.totals().count() == 0


def test_rollup_commits(spark):
    store = rollups.TokenRollup(spark, new_path(spark, "rollup"))
    batch = lambda *rows: spark.createDataFrame(list(rows), rollups.CHANGES)
    totals = lambda: {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in store.totals().collect()}
    assert totals() == {}
    first = batch((1, "insert", 1, "a", "en", "v", 10), (2, "insert", 1, "a", None, "v", None), (1, "insert", 0, "b", "en", "v", 99),
                  (None, "insert", 1, "a", "en", "v", 5), (3, "other", 1, "a", "en", "v", 5), (3, "insert", 1, "a", "en", None, 5))
    assert store.commit(1, first) and not store.commit(1, first)
    assert totals() == {("a", "en", "v"): (1, 10), ("a", None, "v"): (1, 0)}
    # A batch that broke off after its ledger rows is computed again, not added to.
    first.limit(0).selectExpr("doc_id", "source", "lang", "tokenizer_version", "tokens AS documents", "tokens").write.parquet(f"{store.path}/ledger/batch=2")
    assert store.commit(2, batch((1, "revise", 1, "b", "en", "v", 7), (2, "delete", 1, None, None, "v", 0), (8, "delete", 1, "a", "en", "v", 3)))
    assert totals() == {("b", "en", "v"): (1, 7)}
    assert store.commit(3, batch()) and store.commit(4, batch((1, "delete", 2, None, None, "v", 0), (1, "insert", 1, "a", "en", "v", 4)))
    assert totals() == {}


def test_fingerprints_follow_the_contract(documents):
    rows = families(7, 3, 4) + [(100 + i, t) for i, (_, t) in enumerate(ODD)] + [(BIG, "same"), (BIG, "same"), (None, "nobody")]
    docs = documents(rows)
    got = collected(fingerprints.edit_report(docs, partitions=5))
    assert len(got) == len(rows) and set(got.doc_id.dropna()) == {r[0] for r in rows if r[0] is not None}
    unique = sorted((r for r in rows if r[0] is not None and r[0] != BIG), reverse=True)
    by_id = got.set_index("doc_id")
    for (doc_id, text), (_, following) in zip(unique, unique[1:]):
        text, following = text or "", following or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        row = by_id.loc[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = shingles(text, 5), shingles(other, 5)
            assert abs(row[name] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.08
    same = collected(docs).assign(text=lambda d: d.text.fillna("")).merge(got.drop_duplicates("doc_id"), on="doc_id")
    assert (same.groupby("text").fingerprint.nunique() == 1).all()
    single = fingerprints.edit_report(documents([(5, "a b c")]), partitions=3).toPandas()
    assert single.near_next.tolist() == [1.0]
    assert fingerprints.edit_report(documents([(5, "a")]).where("doc_id = 1")).count() == 0


def test_densification_is_unbiased():
    rng = np.random.default_rng(2)
    for n, shared in ((3, 1), (40, 20), (3000, 1500)):
        found = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - shared:])
            found.append(fingerprints.likeness(*(fingerprints.packed(fingerprints.signature(s)) for s in (a, b))))
        assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.03


def test_encoder_equals_the_tokenizers_file():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [t or "" for _, t in ODD] + ["a  b", "a \n b", " lead", "trail ", "don't 's", "a\n\nb c\n d", "<|endoftext|> a", "\x1c b", "é 　 z"]
    texts += pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()
    encode = Encoder()
    for text in texts:
        assert encode.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found_in_texts(documents):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))  # with its defaults
    mark = "<|endoftext|>"
    texts = [t or "" for _, t in ODD] + [f"hello {mark} world", mark, mark * 3, f" {mark} \n", f"a  {mark}  b\n\n{mark}", "<|endoftext|", f"<{mark}>"]
    texts += pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()
    expected = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    for text, ids in zip(texts, expected):
        assert encoder().ids(text).tolist() == ids
    assert encoder().ids(texts[len(ODD)]).tolist() == [31373, 220, 50256, 995]
    rows = list(enumerate(texts[len(ODD):len(ODD) + 7]))
    got = collected(packing.pack_documents(documents(rows), ids=True))
    counts = rollups.counted(documents(rows), "insert", 1).where("tokenizer_version LIKE '%bpe%'").collect()
    for i, _ in rows:
        own = got[got.doc_id == i].sort_values("start")
        assert np.concatenate(own.ids.tolist()).tolist() == [*expected[len(ODD) + i], 1]
        assert [r.tokens for r in counts if r.doc_id == i] == [len(expected[len(ODD) + i])]


def test_packing_round_trip(documents):
    rng = random.Random(9)
    rows = [(1000 + i, "word " * rng.choice([0, 1, 5, 300, 3000])) for i in range(300)] + ODD
    got = collected(packing.pack_documents(documents(rows), ids=True))
    encode = Encoder()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    for _, piece in got.groupby("sequence_id"):
        piece = piece.sort_values("offset")
        assert piece.offset.tolist() == [0, *piece.length.cumsum().tolist()[:-1]] and len(piece) <= packing.Limits().segments
    fill = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill)
    assert padding <= 0.01 * fill.sum()
    for i, text in rows:
        if i is None:
            continue
        own = got[got.doc_id == i].sort_values("start")
        ids = np.concatenate([np.array(x, "<u4") for x in own.ids])
        assert ids.tolist() == [*encode.ids(text).tolist(), 1] and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    assert got.doc_id.isna().sum() == 1


@pytest.mark.parametrize("limits", [packing.Limits(100, 5, 60), packing.Limits(100, 100, 100), packing.Limits(64, 2, 10)])
@pytest.mark.parametrize("cut", [True, False])
def test_all_three_limits_hold(limits, cut):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 300 if cut else limits.tokens, 400)
    loss = rng.integers(0, (sizes if cut else np.minimum(sizes, limits.loss_tokens)) + 1)
    sequences = packing.pack_group(sizes, loss, limits, cut)
    seen = np.zeros(len(sizes), int)
    for sequence in sequences:
        assert sum(n for *_, n in sequence) <= limits.tokens and len(sequence) <= limits.segments
        assert sum(max(0, s + n - max(s, sizes[i] - loss[i])) for i, s, n in sequence) <= limits.loss_tokens
        for i, s, n in sequence:
            assert cut or (s == 0 and n == sizes[i])
            seen[i] += n
    assert (seen == sizes).all()
    if cut:
        starts = sorted((i, s, n) for q in sequences for i, s, n in q)
        for (i, s, n), (j, t, _) in zip(starts, starts[1:]):
            assert j != i or t == s + n


def test_instruction_examples(spark):
    rows = [(i, i % 90, i % 50) for i in range(500)] + [(900, None, None), (901, 5, 50), (902, 0, 0)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id bigint, tokens bigint, loss_tokens bigint"), packing.Limits(100, 4, 60)).toPandas()
    assert sorted(got.example_id) == sorted(r[0] for r in rows)
    frame = got.merge(pd.DataFrame(rows, columns=["example_id", "t", "l"]).fillna(0))
    sums = frame.assign(l=np.minimum(frame.l, frame.t)).groupby("sequence_id").agg(t=("t", "sum"), l=("l", "sum"), n=("t", "size"))
    assert (sums.t <= 100).all() and (sums.l <= 60).all() and (sums.n <= 4).all()


def test_gradients_of_the_recurrent_networks():
    rng = np.random.default_rng(0)
    model = language.new_model(["a", "b", "c"], hidden=4)
    model = {k: {q: w.astype(np.float64) for q, w in v.items()} if isinstance(v, dict) else v.astype(np.float64) for k, v in model.items()}
    ids, lengths, labels = rng.integers(0, 256, (7, 5)), np.array([7, 7, 5, 3, 1]), np.array([0, 1, 2, 1, 0])
    before = gru.F32
    gru.F32 = np.float64
    try:
        _, grads = language.loss_and_grads(model, ids, lengths, labels)
        for path in (("fo",), ("bo",), ("o",), ("f", "u"), ("b", "u"), ("f", "c"), ("fx",), ("bx",)):
            weights, grad = model, grads
            for p in path:
                weights, grad = weights[p], grad[p]
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if path[-1] in ("fx", "bx"):
                at = (int(ids[0, 0]), 3)
            kept, found = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                found.append(language.loss_and_grads(model, ids, lengths, labels)[0])
            weights[at] = kept
            assert (found[0] - found[1]) / 2e-5 == pytest.approx(grad[at], rel=1e-3, abs=1e-8)
    finally:
        gru.F32 = before


def test_language_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "lang"]])
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_of_odd_texts(documents):
    model = language.train(["hello there my friend", "bonjour mes amis chers"] * 5, ["en", "fr"], [0, 1] * 5)
    got = {r.doc_id: r for r in language.identify(documents(ODD + [(9, "12 34"), (10, "é")]), ["en", "fr"], model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[10].lang_pred in ("en", "fr")
    assert got[BIG].lang_pred in ("en", "fr") and None in got
    # The parts of a text that windows cut are pooled by their length.
    one, two = "bonjour " * 100, "hello " * 40
    pooled = language.score_texts(model, [one, two, one + two])
    assert pooled.shape == (3, 2) and np.allclose(pooled.sum(axis=1), 1)
    assert language.identify(documents(ODD), [], model).where("lang_pred <> 'und'").count() == 0


def test_toxicity_finds_planted_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    bad = lambda: [*plain(rng.randrange(80)), rng.choice(["zorkan", "zorkel", "zorkum"]), *plain(rng.randrange(80))]
    texts = [" ".join(bad()) for _ in range(150)] + [" ".join(plain(rng.randrange(1, 160))) for _ in range(400)]
    model = toxicity.train(texts, [1] * 150 + [0] * 400)
    scorer = toxicity.Scorer(model)
    unseen = [" ".join([*plain(3000), "zorkib", *plain(900)]), " ".join(plain(4000)), " ".join(plain(20)), "", None]
    score = scorer.score(unseen)
    assert score[0] > 0.5 and (score[1:] < 0.5).all()
    assert np.allclose(scorer.score(unseen[::-1])[::-1], score, atol=1e-5)
    toxicity_windows = toxicity.windows_of(100)
    assert toxicity_windows[-1][0] + toxicity_windows[-1][1] == 100 and toxicity.windows_of(0) == [(0, 0)]


def test_toxicity_reads_long_words_to_their_end():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    bad = lambda: [*plain(rng.randrange(80)), rng.choice(["zorkan", "zorkel", "zorkum"]), *plain(rng.randrange(80))]
    texts = [" ".join(bad()) for _ in range(150)] + [" ".join(plain(rng.randrange(1, 160))) for _ in range(400)]
    scorer = toxicity.Scorer(toxicity.train(texts, [1] * 150 + [0] * 400))
    for glue in ("_", ""):
        # The same length and the same letters up to the 64th and beyond; only what lies behind differs.
        clean = [glue.join(plain(n)) + "hhhhhh"[:k] for n in (20, 60, 400) for k in range(4)]
        toxic = [t + glue + "zorkan" + glue + "abcde" * 9 for t in clean]
        clean = [t + glue + "abcabc" + glue + "abcde" * 9 for t in clean]
        assert (scorer.score(toxic) > 0.5).all() and (scorer.score(clean) < 0.5).all()
    for n in (1, 63, 64, 65, 66, 67, 68, 69, 200, 1001):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.words_of(run)
        assert set("".join(parts)) == set(run) and all(len(p) <= toxicity.LETTERS for p in parts)
        assert n <= toxicity.LETTERS and parts == [run] or all(any(run[i:i + 7] in p for p in parts) for i in range(n - 6))
    assert toxicity.words_of("a_b " + "c_" * 40 + " " + "_" * 70)[:42] == ["a_b", *["c"] * 40, "_" * 8]


def test_toxicity_query(spark, documents):
    got = QUERIES["op5_toxicity"](spark, SMALL).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    model = toxicity.new_model()
    odd = toxicity.score_documents(documents(ODD), model).collect()
    assert len(odd) == len(ODD) and {r.doc_id for r in odd} == {i for i, _ in ODD}
    clean = toxicity.keep_clean(documents(ODD), model, threshold=2.0)
    assert clean.columns == documents(ODD).columns and clean.count() == len(ODD)
    assert toxicity.keep_clean(documents(ODD), model, threshold=0.0).count() == 0
