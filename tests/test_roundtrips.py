"""Stored pages and exports in sections."""

from __future__ import annotations

import csv
import glob
import io
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerwright.sources.export import EXPORT_COLUMNS, read_export, write_export, write_export_file
from ledgerwright.sources.pages import PageDirectory
from test_plans import base


def test_any_page_reads_the_ranges_it_lies_in(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    # A third of the rows share one time, some have none.
    rows = [(f"i{i:04d}", rng.choice([start, None, *[start + timedelta(hours=rng.randrange(500)) for _ in range(4)]])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, at timestamp")
    pages = PageDirectory(spark, str(tmp_path / "pages"), df.schema, "at", "id")
    pages.write(df, ranges=24)
    dated = sorted((r for r in rows if r[1]), key=lambda r: (-r[1].timestamp(), r[0]))
    expected = [r[0] for r in dated + sorted(r for r in rows if not r[1])]
    sizes = pages.sizes()
    assert sum(n for _, n in sizes) == 900 and max(n for _, n in sizes) < 120
    for size in (7, 50, 1000):
        last = -(-900 // size)
        for number in {-3, 1, 2, last // 2, last, last + 9}:
            at = (min(max(number, 1), last) - 1) * size
            assert [r.id for r in pages.page(number, size).collect()] == expected[at:at + size], (size, number)
    read = pages.page(10**6, 7)
    assert "range" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    last = [r.id for r in read.collect()]
    assert pages._rows().where(F.col("id").isin(last)).select("range").distinct().count() <= 2


def test_pages_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id string, at timestamp")
    pages = PageDirectory(spark, str(tmp_path / "pages"), df.schema, "at", "id")
    pages.write(df)
    assert pages.page(1, 10).count() == 0 and pages.page(9, 10).count() == 0


ODD = [("a", 'Ac"me, x', "500", "x", None, "pending"), ("b", "  spaced  ", "", "x", None, "pending"), ("c", "two\nlines", None, "x", None, "pending"),
       ("d", "# no comment", "1", "x", None, "pending")]


def test_export_in_sections_is_one_csv(spark, tmp_path):
    rows = base(spark, ODD).repartition(3).orderBy(F.desc("invoice_id"))
    path = str(tmp_path / "export")
    for _ in range(2):
        write_export_file(rows, path, {"limit": 5}, "2024-01-01T00:00:00Z")
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{path}/section=*/part-*")))
    lines = text.split("\n")
    assert lines[:3] == ["# Exported at: 2024-01-01T00:00:00Z", "# Rows: 4", '# Query: {"limit": 5}']
    parsed = list(csv.DictReader(io.StringIO("\n".join(lines[3:]))))
    assert list(parsed[0]) == list(EXPORT_COLUMNS)
    assert [(r["invoice_id"], r["vendor_name"], r["total"]) for r in parsed] == [(i, v, t or "") for i, v, t, *_ in ODD[::-1]]
    back = {r.invoice_id: (r.vendor_name, r.total) for r in read_export(spark, f"{path}/section=1").collect()}
    assert back == {r[0]: (r[1], r[2]) for r in ODD}


def test_empty_export_has_no_header(spark, tmp_path):
    write_export_file(base(spark, ODD).where("false"), str(tmp_path / "e"), {}, "t")
    assert [r.value for r in spark.read.text(str(tmp_path / "e" / "section=0")).collect()] == ["# Exported at: t", "# Rows: 0", "# Query: {}"]
    assert read_export(spark, str(tmp_path / "e" / "section=1")).count() == 0


def test_plain_export_keeps_blanks_around_values(spark, tmp_path):
    write_export(base(spark, ODD), str(tmp_path / "x"), {}, "t", "csv")
    back = {r.invoice_id: r.vendor_name for r in read_export(spark, str(tmp_path / "x" / "rows"), header=True).collect()}
    assert back == {r[0]: r[1] for r in ODD}
