"""Tables that batches change in place, postings, keyed state, and the plans of processing."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SMALL
from ledgerwright.functions import stemming
from ledgerwright.functions.stemming import query_lexemes
from ledgerwright.operators.anomalies import ack_map, within_acked
from ledgerwright.operators.words import field_boxes
from ledgerwright.plans import process as processing
from ledgerwright.plans import testmodel as tm
from ledgerwright.session import materialised, open_writers
from ledgerwright.sources.export import write_extractions
from ledgerwright.sources.postings import search_postings, stem_table, write_postings
from ledgerwright.sources.store import ExtractionStore
from ledgerwright.streaming.ingest import ingest
from ledgerwright.streaming.state import SETTINGS, state_on_disk


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


ROW = "extraction_id string, invoice_id string, created_at timestamp, is_current boolean, note string"


def files_of(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_store_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    made = spark.createDataFrame([("x", "x", at(0), True, None)], ROW)
    store = ExtractionStore(spark, path, made.schema, buckets=32)
    batch = lambda *rows: spark.createDataFrame(list(rows), ROW)
    current = lambda: {r.invoice_id: r.extraction_id for r in store.read().where("is_current").collect()}
    assert store.read().count() == 0 and store.append(batch()) == [] and store.read().count() == 0
    store.append(batch(*[(f"e{i}", f"i{i}", at(i), False, "first") for i in range(60)]))
    assert current() == {f"i{i}": f"e{i}" for i in range(60)}
    before = files_of(path)
    again = batch(("n5", "i5", at(99), False, "second"), ("old5", "i5", at(1), True, "late"))
    touched = store.append(again)
    assert len(touched) == 1 and all(f"bucket={touched[0]}/" in f for f in before ^ files_of(path))
    assert current()["i5"] == "n5" and store.read().count() == 62
    # The batch once more: rows replace themselves.
    store.append(again)
    assert store.read().count() == 62 and current()["i5"] == "n5"
    assert store.promote(batch(("old5", "i5", None, None, None)).select("invoice_id", "extraction_id")) == touched
    assert current()["i5"] == "old5" and len(current()) == 60
    # A batch of another invoice of the same bucket leaves what was promoted.
    spread = {i: ExtractionStore.touched(store, spark.createDataFrame([(f"i{i}",)], "invoice_id string")) for i in range(60)}
    other = next((i for i, b in spread.items() if b == touched and i != 5), None)
    if other is not None:
        store.append(batch((f"z{other}", f"i{other}", at(500), False, None)))
        assert current()["i5"] == "old5" and current()[f"i{other}"] == f"z{other}"


def test_searches_read_the_postings_of_their_terms(spark, tmp_path):
    rng = random.Random(2)
    words = ["blue", "ring", "rings", "the", "running", "ran", "runs", "metal", "metals", "Ünïcode", "x1", "of"]
    rows = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [("none", None), ("empty", "")]
    path = str(tmp_path / "postings")
    write_postings(spark.createDataFrame(rows, "id string, body string"), path, "id", "body", buckets=8)
    for phrase in ("blue rings", "the running metals of", "ring", "ünïcode X1", "nothing", "blue nothing"):
        wanted = query_lexemes(phrase)
        expected = {i for i, t in rows if set(wanted) <= set(query_lexemes(t or ""))}
        found = search_postings(spark, path, phrase, "id", buckets=8)
        assert {r.id for r in found.collect()} == expected, phrase
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
        assert "In(lexeme" in plan or "EqualTo(lexeme" in plan
    for phrase in ("", "the of"):
        assert search_postings(spark, path, phrase, "id", buckets=8).count() == 0


def test_each_word_is_stemmed_once(spark):
    words = spark.createDataFrame([("rings",), ("rings",), ("the",), ("ring",)], "word string")
    assert sorted(tuple(r) for r in stem_table(words).collect()) == [("ring", "ring"), ("rings", "ring")]


def test_ingest_knows_its_keys_from_state_over_twenty_triggers(spark, tmp_path):
    rng = random.Random(7)
    arrivals, seen, expected = str(tmp_path / "in"), {}, []
    table, offsets = str(tmp_path / "table"), str(tmp_path / "offsets")
    for part in range(20):
        rows = [(f"h{rng.randrange(40) + part}", part * 100 + i, rng.random()) for i in range(50)]
        spark.createDataFrame(rows, "file_hash string, doc_id bigint, size double").coalesce(1).write.mode("append").parquet(arrivals)
        first = {}
        for h, i, x in rows:
            first.setdefault(h, (h, i, x))
        fresh = [r for h, r in first.items() if h not in seen]
        seen |= {r[0]: part for r in fresh}
        expected += fresh
        before = spark.conf.get(next(iter(SETTINGS)), None)
        with state_on_disk(spark):
            stream = spark.readStream.schema("file_hash string, doc_id bigint, size double").parquet(arrivals)
            query = ingest(stream, table, offsets, ["doc_id"]).trigger(availableNow=True).start()
            query.awaitTermination()
        assert spark.conf.get(next(iter(SETTINGS)), None) == before
        state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
        # A trigger touches the keys it brings, however many are known.
        assert state[-1]["numRowsUpdated"] == len(first) and state[-1]["numRowsTotal"] == len(seen)
    got = [(r.file_hash, r.doc_id, r["size"]) for r in spark.read.parquet(table).collect()]
    assert sorted(got) == sorted(expected)


def test_streams_take_tables_of_many_files(spark, tmp_path):
    from registry.streams import QUERIES

    for name, key in (("documents", "doc_id"), ("events", "event_id")):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.repartition(3, key).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_ingest", "stream_vendor_stats"):
        whole, parts = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (SMALL, str(tmp_path)))
        assert whole and whole == parts


def test_postings_read_their_texts_once(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        met.add(1)
        return text

    texts = spark.createDataFrame([(str(i), f"blue rings {i} ring 17") for i in range(50)], "id string, text string")
    write_postings(texts.select("id", counted("text").alias("text")), str(tmp_path), "id", "text")
    assert met.value == 50
    got = sorted((r.lexeme, r.id) for r in spark.read.parquet(str(tmp_path)).collect())
    assert got == sorted((w, str(i)) for i in range(50) for w in {"blue", "ring", str(i), "17"})


def test_stored_folders_need_no_sort(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    with open_writers(spark, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name, None) == before
    flags = spark.range(90).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False).alias("is_current"))
    rows = flags.withColumns({c: F.lit(None).cast("string") for c in ("vendor_text", "currency", "total_amount", "subtotal_amount", "tax_amount", "period_start")})
    write_extractions(rows.withColumn("fields", F.create_map().cast("map<string,string>")), f"{tmp_path}/x")
    got = spark.read.parquet(f"{tmp_path}/x").groupBy("is_current").count().collect()
    assert {r.is_current: r["count"] for r in got} == {"true": 30, "false": 30, None: 30}


def test_words_are_shuffled_once(spark):
    words = spark.createDataFrame([("d", 0, i, w, i * 10.0, 0.0, i * 10.0 + 9, 15.0) for i, w in enumerate("a Blue, ring a blue ring".split())],
                                  "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    values = spark.createDataFrame([("d", "f", "blue ring"), ("d", "g", "a blue"), ("d", "h", "ring blue")], "doc_id string, field string, value string")
    boxes = field_boxes(words, values)
    assert {r.field: r.bbox for r in boxes.collect()} == {"f": [10 / 59, 0.0, 29 / 59, 1.0], "g": [0.0, 0.0, 19 / 59, 1.0]}
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    # Once numbered, once for the extent of pages.
    assert sum("word_no" in line and "LogicalRDD" in line for line in plan.splitlines()) <= 2


def test_items_are_gathered_narrow(spark):
    plan = tm.extractions(spark, SMALL, True)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(" in line]
    assert gathered and all("0.9" not in x[x.index("collect_list("):x.index("collect_list(") + 300].split("),")[0] for x in gathered)


def test_numbers_are_not_stemmed():
    before = stemming._stem.cache_info().misses
    assert [stemming.stem(w) for w in ("98765432101", "rings")] == ["98765432101", "ring"]
    assert stemming._stem.cache_info().misses <= before + 1


def test_processing_reads_no_source_twice(spark, monkeypatch):
    from registry.processing import _inputs
    from registry.triage import tier_rows

    relations = []

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        relations.append((name, plan.count("Relation ") + plan.count("LogicalRDD")))
        return materialised(df, name)

    monkeypatch.setattr(processing, "materialised", counted)
    documents, stored, _ = _inputs(spark, SMALL)
    stored = processing.Stored(
        materialised(stored.invoices, "i"), materialised(stored.vendors, "v"), materialised(stored.stats, "s"),
        spark.createDataFrame([("1", 100.0)], "vendor_id string, value double"),
    )
    result = processing.process(materialised(documents, "d"), materialised(tier_rows(spark, SMALL).drop("k"), "t"), stored)
    for name, df in (("extractions", result.extractions), ("invoices", result.invoices), ("vendors", result.vendors)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        relations.append((name, plan.count("Relation ") + plan.count("LogicalRDD")))
    counts = dict(relations)
    assert counts["readings"] == 2 and counts["uploads"] == 4 and counts["duplicates"] <= 16 and counts["triaged"] <= 10
    assert counts["extractions"] == 1 and counts["invoices"] == 2 and counts["vendors"] <= 3
    assert result.extractions.count() == documents.count()


def test_acked_values_within_a_tenth(spark):
    rng = random.Random(1)
    acked = [("v", rng.uniform(0.5, 2000)) for _ in range(40)] + [("v", 0.0), ("v", -5.0), ("w", 100.0)]
    values = [(who, x) for who in ("v", "w", "none") for x in [*(rng.uniform(0.1, 3000) for _ in range(300)), 0.0, -3.0, None, 110.0, 109.9, 90.0, 90.1, 1e9]]
    ranges = ack_map(spark.createDataFrame(acked, "vendor_id string, value double"))
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, vendor_id string, x double").join(ranges, "vendor_id", "left")
    got = {r.i: r.hit for r in rows.select("i", within_acked(F.col("x"), F.col("acked")).alias("hit")).collect()}
    for i, (who, x) in enumerate(values):
        near = x is not None and any(a > 0 and abs(x - a) / a < 0.1 for w, a in acked if w == who)
        assert got[i] == near, (who, x)
