"""Ids by the tree against the tokenizers library, over the cluster and in one place."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from ledgerwright.llm import tokens, tree_bpe
from ledgerwright.llm.queries import QUERIES

PARTS = [
    "a", "b", "ab", "aaaa", " ", "  ", "\n", "\n\n", "'s", "'t", "'", "''ll", "1", "23", "!", "!!", "é", "日本語", "　", "😀", "\x1c", "\x85",
    "<|endoftext|>", "<|end", "oftext|>", "the", " and", "ing", " ",
]


@lru_cache(maxsize=1)
def loaded():
    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return loaded()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120), st.sampled_from([1, 3, 7, 20]), st.sampled_from([2, 6, 40]), st.sampled_from([1, 2, 8]))
def test_tree_gives_the_ids_of_the_library(parts, leaf, unsplit, window):
    text, before = "".join(parts), (tree_bpe.UNSPLIT, tree_bpe.WINDOW)
    try:
        tree_bpe.UNSPLIT, tree_bpe.WINDOW = unsplit, window
        ids = tree_bpe.encode_whole(text, leaf)
    finally:
        tree_bpe.UNSPLIT, tree_bpe.WINDOW = before
    assert ids.tolist() == loaded().encode(text, add_special_tokens=False).ids
    assert tree_bpe.tree_encoder().decode(ids).decode() == text


@pytest.mark.parametrize("text", [
    "a" * 100_001, "x" + " " * 1_000_001 + "b", "a" + "\n" * 999_999 + "b", "'" * 40_000 + "s", "a" + "　" * 50_000 + "b", "0123456789" * 9_000,
    " " * 30_000, "b" + " " * 30_000 + "<|endoftext|>" + "\n" * 20_000 + "<|endoftext|>x", ("word " * 20 + "x" * 5_000 + "  \n\n ") * 20, "日本語" * 20_000,
    "z" + "\t " * 20_000 + "a " + " " * 12_000 + "'s",
])
def test_long_stretches(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert tree_bpe.encode_whole(text).tolist() == want
    assert tokens.encoder().ids(text).tolist() == want  # white space beyond what the pattern can go back over
    assert depth_holds(len(text))


def depth_holds(n):
    depth = tree_bpe.depth_of(n)
    return -(-n >> depth) <= tree_bpe.LEAF + 1 and (depth == 0 or n / (1 << depth - 1) > tree_bpe.LEAF)


def report_of(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_over_the_cluster(documents, library):
    texts = [None, "", "a", "Some words, and 's.", "long " * 3000, "unsplit" * 4000, "b" + " " * 20_000 + "c", "é<|endoftext|>" * 900, "日本 語" * 700]
    rows = list(enumerate(texts)) + [(4, "long " * 3000), (None, "unsplit" * 4000), (None, None)]
    order = lambda r: (r[0] is None, r)
    for leaf in (100, tree_bpe.LEAF):
        got = [tuple(r) for r in tree_bpe.encode_report(documents(rows), leaf=leaf).collect()]
        assert sorted(got, key=order) == sorted((report_of(library, *r) for r in rows), key=order)
    encoded = tree_bpe.encode_documents(documents(rows), leaf=1000)
    back = [tuple(r) for r in tree_bpe.decode_documents(encoded).collect()]
    assert sorted(back, key=order) == sorted(((i, t or "") for i, t in rows), key=order)
    assert tree_bpe.encode_report(documents([])).count() == 0


def test_decoding_of_ids_that_are_no_text(spark, library):
    ids = [[447], [447, 50256, 11], [220, 220], []]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, np.uint32).tobytes())) for i, x in enumerate(ids)] + [(9, None)], "doc_id bigint, ids binary")
    got = dict(tuple(r) for r in tree_bpe.decode_documents(rows).collect())
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {9: None}


def test_query(spark, library):
    got = QUERIES["op13_tree_bpe"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert sorted(tuple(r) for r in got) == sorted(report_of(library, d["doc_id"], d["text"]) for d in docs)
