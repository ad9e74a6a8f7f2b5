"""The model tables derived from the generated star schema.

Orders stand for invoices, customers for vendors, line items for invoice lines, events for
vendor histories and usage, documents for uploaded texts. All figures are sums of decimals,
so they are the same whatever the order rows are added in.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.functions.dates import parse_period
from ledgerwright.functions.text import normalize_name
from ledgerwright.operators.fields import raw_text
from ledgerwright.schema import FIELD, LINE_ITEM, REASON, TAX_ROW


KEYS = {
    "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
    "conversations": "conv_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One kept in a single file has a single split and would be worked on by
    one task, so its rows are spread by key; a table of many files is read as it is."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name in KEYS and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism, KEYS[name])
    return df


def uuid_of(key: Column) -> Column:
    """Id in UUID form; its text order is the order of the keys."""
    return F.concat(
        F.lit("00000000-0000-0000-0000-"), F.lpad(F.lower(F.hex(key.cast("bigint"))), 12, "0")
    )


def uuid_sql(key: str) -> str:
    return f"concat('00000000-0000-0000-0000-', lpad(lower(hex({key})), 12, '0'))"


def choose(key: Column, *options: Column | str) -> Column:
    """Option number key mod n."""
    n = len(options)
    chain = F.when(key % n == 0, options[0])
    for i in range(1, n):
        chain = chain.when(key % n == i, options[i])
    return chain


def line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, subtotal, tax) per order."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    net = price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    tax = net.cast("decimal(17,4)") * F.col("l_tax").cast("decimal(4,2)")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.round(F.sum(net), 2).cast("decimal(18,2)").alias("subtotal"),
        F.round(F.sum(tax), 2).cast("decimal(18,2)").alias("tax"),
    )


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("vendor_id"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("tax_id"),
        normalize_name(F.col("c_name")).alias("normalized_name"),
    )


def order_rows(spark: SparkSession, sf_dir: str, amounts: bool = True) -> DataFrame:
    """One row per order with the raw values of its invoice; the basis of the model tables."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), F.col("c_name").alias("cname"), F.col("c_nationkey").alias("nat")
    )
    rows = o.join(cust, "c", "left")
    if amounts:
        rows = rows.join(line_sums(spark, sf_dir), "k", "left")
    else:
        rows = rows.withColumns({x: F.lit(None).cast("decimal(18,2)") for x in ("subtotal", "tax")})
    # SQL text: one call per column keeps planning short.
    return rows.selectExpr(
        "k", f"{uuid_sql('k')} AS invoice_id", "ts", "cname",
        "if(k % 17 = 0, NULL, CAST(c AS STRING)) AS vendor_id",
        "CASE s WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'unprocessable' ELSE 'pending' END AS review_status",
        """CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN '' ELSE CASE k % 4 WHEN 0 THEN cname
            WHEN 1 THEN upper(cname) WHEN 2 THEN concat(' ', cname, ' ')
            ELSE replace(cname, '#', ' #') END END AS vendor_name""",
        "if(k % 19 = 0, NULL, concat('INV-', k)) AS invoice_number",
        """CASE k % 8 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'MM/dd/yyyy')
            WHEN 2 THEN date_format(ts, 'MMMM dd, yyyy') WHEN 3 THEN date_format(ts, 'dd-MMM-yy')
            WHEN 4 THEN date_format(ts, 'MMMM yyyy')
            WHEN 5 THEN concat(date_format(ts, 'MM/dd/yy'), ' - ', date_format(date_add(CAST(ts AS DATE), 5), 'MM/dd/yy'))
            WHEN 6 THEN 'n/a' ELSE date_format(ts, 'MMM dd, yy') END AS invoice_date""",
        "CAST(subtotal AS STRING) AS subtotal", "CAST(tax AS STRING) AS tax",
        """CASE WHEN k % 31 = 0 THEN 'N/A' WHEN k % 5 = 0 OR subtotal IS NULL THEN CAST(price AS STRING)
            ELSE CAST(CAST(subtotal + tax AS DECIMAL(18,2)) AS STRING) END AS total""",
        """if(k % 37 = 0, NULL, CASE nat % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
            WHEN 3 THEN 'XXX' WHEN 4 THEN 'usd' END) AS currency""",
        """CASE WHEN k % 10 = 0 THEN 'likely_duplicate' WHEN k % 10 < 4 THEN 'needs_review'
            ELSE 'confident' END AS state""",
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir, amounts=False).select(
        "invoice_id", F.concat(F.sha2("invoice_id", 256), F.lit(".pdf")).alias("storage_key"),
        F.sha2("invoice_id", 256).alias("file_hash"), F.lit(None).cast("string").alias("perceptual_hash"),
        "vendor_id", F.col("ts").alias("uploaded_at"), "review_status",
        F.array().cast("array<string>").alias("duplicate_dismissals"),
    )


def _field(name: str, score: str) -> str:
    period = name == "invoice_date"
    ends = "period.iso_from, period.iso_to" if period else "NULL, NULL"
    return f"'{name}', CAST(struct({name}, NULL, 0, {score}, 'pymupdf+haiku', {ends}) AS {FIELD.simpleString()})"


def _reason(kind: str, **members: str) -> str:
    listed = ", ".join(
        f"CAST({members.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in REASON.fields if f.name != "type"
    )
    return f"CAST(struct('{kind}', {listed}) AS {REASON.simpleString()})"


def extractions(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """Extractions, a third of the invoices having an older, superseded one as well.

    `texts` adds line items and the searchable text.
    """
    rows = order_rows(spark, sf_dir).withColumn("period", parse_period(F.col("invoice_date")))
    scores = {
        "vendor_name": "(k % 7) / 7D", "invoice_number": "(k % 11) / 11D", "invoice_date": "(k % 13) / 13D",
        "total": "(k % 10) / 10D", "currency": "1D", "subtotal": "0.9D", "tax": "0.9D",
    }
    fields = ", ".join(_field(name, score) for name, score in scores.items())
    # The text needs the values alone, so a plan that reads no field parses no date.
    values = ", ".join(f"'{name}', struct({name} AS value)" for name in scores)
    kept = ", ".join(f"'{name}', {scores[name]}" for name in ("total", "vendor_name", "invoice_date"))
    double = _reason(
        "duplicate_of", invoice_id=uuid_sql("greatest(k - 1, 0)"), similarity="1", match_method="'perceptual_hash'"
    )
    odd = _reason("anomaly", field="'total'", vendor_mean="k % 1000 * 100", vendor_std="100", z_score="(k % 60) / 10D")
    items = f"array<{LINE_ITEM.simpleString()}>"
    if texts:
        li = table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"
        )
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        # What is gathered is narrow; the members that are the same everywhere come after the shuffle.
        listed = f"""transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_extendedprice, p_name, l_quantity))), x ->
            CAST(struct(x.p_name, x.l_quantity, NULL, x.l_extendedprice, NULL, 0, 0.9D) AS {LINE_ITEM.simpleString()})) AS line_items"""
        nested = li.join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.expr(listed))
        rows = rows.join(nested, "k", "left")
    else:
        rows = rows.withColumn("line_items", F.expr(f"CAST(NULL AS {items})"))
    rows = rows.selectExpr("*", "explode(if(k % 3 = 0, array(0, 1), array(0))) AS version")
    made = rows.selectExpr(
        "k", "concat(invoice_id, if(version = 1, '-old', '')) AS extraction_id", "invoice_id",
        "if(version = 1, 'haiku-a', 'sonnet-b') AS model", f"map({fields}) AS fields", f"map({kept}) AS confidence",
        "state", f"filter(array(if(k % 10 = 0, {double}, NULL), if(k % 7 = 0, {odd}, NULL)), r -> r IS NOT NULL) AS reasons",
        f"coalesce(line_items, CAST(array() AS {items})) AS line_items",
        f"CAST(array() AS array<{TAX_ROW.simpleString()}>) AS tax_rows",
        "version = 0 AS is_current", "if(version = 1, ts - interval 1 day, ts) AS created_at",
        # The typed columns that are stored next to the map.
        "vendor_name AS vendor_text", "currency", "try_cast(total AS DECIMAL(18,4)) AS total_amount",
        "try_cast(subtotal AS DECIMAL(18,4)) AS subtotal_amount", "try_cast(tax AS DECIMAL(18,4)) AS tax_amount",
        "CAST(period.iso_from AS DATE) AS period_start", f"map({values}) AS __values",
    )
    return made.withColumn("raw_text", raw_text(F.col("__values"), F.col("line_items"), F.col("tax_rows"))).drop("__values")


def base(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    from ledgerwright.operators.scan import base_relation

    return base_relation(
        invoices(spark, sf_dir), extractions(spark, sf_dir, texts), vendors(spark, sf_dir)
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as confirmed invoices of the user: the source of histories and outliers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        uuid_of(F.col("event_id")).alias("invoice_id"), F.col("event_id").alias("k"),
        F.col("user_id").cast("string").alias("vendor_id"), F.col("ts").cast("timestamp").alias("uploaded_at"),
        F.col("value").cast("decimal(18,4)").alias("total"), "event_type",
    )


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        uuid_of(k).alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "view", "local-stub")
        .otherwise(choose(k, F.lit("Haiku-4"), F.lit("sonnet-4"), F.lit("opus-4"))).alias("model"),
        F.lit("header").alias("spec_name"),
        (F.col("value").cast("decimal(18,2)") * 100).cast("bigint").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(k % 500).cast("bigint").alias("cache_creation_input_tokens"),
        (k % 300).cast("bigint").alias("cache_read_input_tokens"),
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, one a minute, with content hash and a 64-bit token hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = F.array_distinct(
        F.filter(F.split(F.lower("text"), "[^a-z0-9]+", -1), lambda w: w != "")
    )
    words = docs.select("doc_id", F.explode(tokens).alias("w")).select(
        "doc_id", F.conv(F.substring(F.md5("w"), 1, 16), 16, -10).cast("bigint").alias("h")
    )
    bits = words.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        *[F.sum(F.getbit("h", F.lit(i)).cast("bigint")).alias(f"b{i}") for i in range(64)],
    )
    signed = lambda i: F.lit(-(1 << 63) if i == 63 else 1 << i)
    hashed = F.lit(0).cast("bigint")
    for i in range(64):
        hashed = hashed.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), signed(i)).otherwise(0))
    return (
        docs.join(bits.select("doc_id", hashed.alias("hash_bits")), "doc_id")
        .select(
            F.col("doc_id").alias("k"), uuid_of(F.col("doc_id")).alias("invoice_id"), "text",
            F.timestamp_seconds(F.col("doc_id") * 60).alias("uploaded_at"),
            F.sha2("text", 256).alias("file_hash"), "hash_bits",
            F.when(F.col("doc_id") % 3 == 0, F.array(uuid_of(F.greatest(F.col("doc_id") - 1, F.lit(0))), uuid_of(F.lit(0))))
            .otherwise(F.array().cast("array<string>")).alias("duplicate_dismissals"),
        )
    )
