"""License scans: exact set-similarity join of text blocks with license templates (containment).

A text is cut into overlapping blocks of words. Template tokens are put in one global
order, rarest in the corpus first. A template needs `alpha = ceil(threshold * size)` of its
tokens in a block, so the first shared token (in that order) lies in the template's first
`size - alpha + 1` tokens (prefix filter), in the block's first `n - alpha + 1` known tokens,
of which it must have `alpha` (length filter), and both must have enough tokens left from
there (positional filter). What passes is counted exactly. No block that reaches the
threshold is missed.

Phrases are templates with threshold 1; a block that holds all words of a phrase is then
searched for the places where they stand one after another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.common import ascii_lower, values

# Phrases, and wording of license notices.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
)

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STEP, BLOCK = 32, 64  # words between block starts, and in a block
THRESHOLD = 0.8


def license_words(text: Column) -> Column:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text; null counts as empty."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def token_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each token of the templates occurs, over all documents.

    The result has one entry per template token, whatever the size of the corpus.
    """
    known = words.select(F.explode(F.array_intersect(_strings(vocabulary), "words")).alias("token"))
    return {r["token"]: r["n"] for r in known.groupBy("token").agg(F.count("*").alias("n")).collect()}


def template_index(templates: list[dict], frequency: dict[str, int]) -> list[tuple]:
    """Prefix tokens of each template: (token, template, position, size, alpha)."""
    rows = []
    for number, t in enumerate(templates):
        tokens = sorted(t["tokens"], key=lambda x: (frequency.get(x, 0), x))
        alpha = math.ceil(t["threshold"] * len(tokens) - 1e-9)
        rows += [(tok, number, pos, len(tokens), alpha) for pos, tok in enumerate(tokens[:len(tokens) - alpha + 1])]
    return rows


def scan_licenses(
    docs: DataFrame,
    phrases=PHRASES,
    notices=NOTICES,
    threshold: float = THRESHOLD,
    step: int = STEP,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, and `hits`.

    A hit is struct<label, kind, start, containment, places>: kind 'phrase' with the word
    positions at which the phrase stands, or kind 'notice' for a block (from word `start`)
    that holds at least `threshold` of the notice's distinct words. Hits of a document are
    at most its blocks times the templates.

    Null or empty text: no words, no hits. Null doc_id stays. Repeated rows each get a row.
    Further columns of `docs` are not read.
    """
    spark = docs.sparkSession
    templates = [
        {"label": label, "kind": "phrase", "words": text.split(), "tokens": set(text.split()), "threshold": 1.0}
        for label, text in phrases
    ] + [
        {"label": label, "kind": "notice", "words": text.split(), "tokens": set(text.split()), "threshold": threshold}
        for label, text in notices
    ]
    longest = max(len(t["words"]) for t in templates)
    if longest > block - step:
        raise ValueError("a template must fit where two blocks overlap")
    words = docs.select("doc_id", license_words(F.col("text")).alias("words"))
    vocabulary = sorted({x for t in templates for x in t["tokens"]})
    frequency = token_frequencies(words, vocabulary)
    ordered = sorted(vocabulary, key=lambda x: (frequency.get(x, 0), x))
    rows = template_index(templates, frequency)
    index = values(spark, rows, "token string, template int, t_pos int, t_size int, alpha int")
    prefixes = sorted({r[0] for r in rows})

    # A row's number ties its blocks together again; it never leaves this one pass over the rows.
    numbered = words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "words",
    )
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, block).alias("words")))
    reached = F.when(F.arrays_overlap("words", _strings(prefixes)), cut)
    blocks = numbered.select("row", "doc_id", "n_words", F.explode_outer(reached).alias("b")).select(
        "row", "doc_id", "n_words", "b.start", "b.words",
        F.array_intersect(_strings(ordered), "b.words").alias("known"),
    )
    probes = blocks.select(
        "row", "doc_id", "n_words", "start", "words", "known", F.posexplode_outer("known").alias("b_pos", "token")
    )
    n = F.size("known")
    joined = probes.join(F.broadcast(index), "token", "left").withColumn(
        "candidate",
        (n >= F.col("alpha")) & (F.col("b_pos") <= n - F.col("alpha"))
        & (F.least(n - F.col("b_pos"), F.col("t_size") - F.col("t_pos")) >= F.col("alpha")),
    )

    def checked(number: int, t: dict) -> Column:
        """The hit of template `number` at this row, or null."""
        tokens = sorted(t["tokens"], key=lambda x: (frequency.get(x, 0), x))
        shared = F.array_intersect(_strings(tokens), "known")
        alpha = math.ceil(t["threshold"] * len(tokens) - 1e-9)
        k = len(t["words"])
        last = F.least(F.lit(step - 1), F.size("words") - k)
        places = (
            F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, k) == _strings(t["words"])))
            if t["kind"] == "phrase" else F.array(F.lit(0))
        )
        where = F.transform(places, lambda i: (i + F.col("start")).cast("long"))
        hit = F.struct(
            F.lit(t["label"]).alias("label"), F.lit(t["kind"]).alias("kind"), F.col("start").cast("long").alias("start"),
            (F.size(shared) / F.lit(len(tokens))).alias("containment"), where.alias("places"),
        )
        # One candidate per block and template: the one at their first shared token.
        first = F.element_at(shared, 1) == F.col("token")
        return F.when(
            F.col("candidate") & (F.col("template") == number),
            F.when((F.size(shared) >= alpha) & first & (F.size(F.coalesce(places, F.array().cast("array<int>"))) > 0), hit),
        )

    hit = F.coalesce(*[checked(i, t) for i, t in enumerate(templates)])
    return joined.select("row", "doc_id", "n_words", hit.alias("hit")).groupBy("row", "doc_id", "n_words").agg(
        F.collect_list("hit").alias("hits")
    ).drop("row")


def license_report(scan: DataFrame) -> DataFrame:
    """Digest of `scan_licenses`: places and positions of phrases, labels, best containment."""
    base = F.filter("hits", lambda h: h["kind"] == "phrase")
    places = F.flatten(F.transform("base", lambda h: h["places"]))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return scan.withColumn("base", base).withColumn("places", places).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def oracle(phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD, step: int = STEP, block: int = BLOCK) -> str:
    """The same by trying every block against every template."""
    rows = [(lab, "phrase", t, 1.0) for lab, t in phrases] + [(lab, "notice", t, threshold) for lab, t in notices]
    listed = ", ".join(
        f"({i}, '{lab}', '{kind}', {_sql_list(t.split())}, {_sql_list(sorted(set(t.split())))}, {math.ceil(th * len(set(t.split())) - 1e-9)})"
        for i, (lab, kind, t, th) in enumerate(rows)
    )
    return rf"""WITH templates(id, label, kind, words, tokens, alpha) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}',
  '{"abcdefghijklmnopqrstuvwxyz"}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT r, s AS start, w[s + 1:s + {block}] AS w FROM (SELECT r, w, unnest(range(0, len(w), {step})) AS s FROM d)),
m AS (SELECT r, start, label, kind, w, words, len(list_intersect(tokens, w)) / len(tokens)::DOUBLE AS containment
  FROM b, templates WHERE len(list_intersect(tokens, w)) >= alpha),
h AS (SELECT r, label, kind, containment, CASE WHEN kind = 'phrase' THEN
  [i + start FOR i IN range(0, {step}) IF w[i + 1:i + len(words)] = words] ELSE [0] END AS places FROM m),
g AS (SELECT r, sum(len(places)) FILTER (kind = 'phrase') AS n_base, min(list_min(places)) FILTER (kind = 'phrase') AS first_word,
  max(list_max(places)) FILTER (kind = 'phrase') AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (kind = 'phrase'))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(containment) AS score FROM h WHERE len(places) > 0 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""
