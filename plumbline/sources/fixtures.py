"""Inputs with known faults, derived from the given tables by integer arithmetic.

Each fixture has a DataFrame builder and, for result checks, the same rule as a SQL common table
expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    slot = F.pmod(key, F.lit(10))
    return F.when(slot < 7, "train").when(slot < 9, "validation").otherwise("test")


SPLIT_SQL = "CASE WHEN {k} % 10 < 7 THEN 'train' WHEN {k} % 10 < 9 THEN 'validation' ELSE 'test' END"


def faulted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted nulls, exact copies and rows leaked into another split."""
    key = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(key % 20 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.when(key % 25 != 1, F.col("o_orderpriority")).alias("o_orderpriority"),
        split_of(key).alias("split"))
    # copies and leaked rows come out of the one scan
    split = F.col("split")
    places = F.array_compact(F.array(split, F.when(key % 50 == 0, split), F.when(
        key % 40 == 3, F.when(split == "test", "train").otherwise("test"))))
    return base.withColumn("split", F.explode(places))


FAULTED_SQL = f"""
base AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 25 <> 1 THEN o_orderpriority END AS o_orderpriority,
  {SPLIT_SQL.format(k='o_orderkey')} AS split FROM orders),
faulted AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0
  UNION ALL SELECT * REPLACE (CASE WHEN split = 'test' THEN 'train' ELSE 'test' END AS split)
  FROM base WHERE o_orderkey % 40 = 3)"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their (partly missing) labels and a split."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("split", split_of(F.col("doc_id")))


DOC_SQL = f"""
doc AS (SELECT d.*, l.quality, l.toxic, {SPLIT_SQL.format(k='d.doc_id')} AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters of document quality: the second flips every tenth, the third skips every seventh."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("a1"),
        F.when(key % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("a2"),
        F.when(key % 7 != 0, F.col("quality")).alias("a3"))


ANNOTATION_SQL = """
ann AS (SELECT doc_id, quality AS a1, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS a2,
  CASE WHEN doc_id % 7 <> 0 THEN quality END AS a3 FROM labels)"""


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with one percent of the rows repeated, so that timestamps collide."""
    times = F.when(F.col("event_id") % 100 == 0, 2).otherwise(1)
    return table(spark, sf_dir, "events").select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


EVENT_SQL = """
ev AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 100 = 0)"""


def order_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from 1998, the later half 25 percent dearer, partly null and retyped."""
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    late = orders.filter(F.col("o_orderdate") >= cut).select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"),
        (F.col("o_totalprice") * 1.25).alias("o_totalprice"), "o_orderdate",
        F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderkey") % 7).alias("o_new"))
    return orders.filter(F.col("o_orderdate") < cut), late


HALVES_SQL = """
early AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
late AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice * 1.25 AS o_totalprice,
  o_orderdate, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS o_orderpriority,
  o_orderkey % 7 AS o_new FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""

_LETTERS = "etaoinshrdlucmfw"
_FACTORS = (10, 16, 25, 40)


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit letter-frequency fingerprint per document; edited copies differ in few bits.

    Stands in for an image's perceptual hash: the same width, the same hexadecimal form. Each digit
    says how many of four frequency marks a letter passes.
    """
    size = F.length("text")
    digits = []
    for ch in _LETTERS:
        count = size - F.length(F.replace(F.lower("text"), F.lit(ch)))
        marks = [F.when(count * f > size, 1 << (3 - i)).otherwise(0) for i, f in enumerate(_FACTORS)]
        digits.append(F.lower(F.hex((marks[0] + marks[1] + marks[2] + marks[3]).cast("bigint"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*digits).alias("phash"))


def _fingerprint_sql() -> str:
    digits = []
    for ch in _LETTERS:
        terms = [f"CASE WHEN (length(text) - length(replace(lower(text), '{ch}', ''))) * {f} > length(text) "
                 f"THEN {1 << (3 - i)} ELSE 0 END" for i, f in enumerate(_FACTORS)]
        digits.append("lower(to_hex(" + " + ".join(terms) + "))")
    return "fp AS (SELECT doc_id, " + " || ".join(digits) + " AS phash FROM documents)"


FINGERPRINT_SQL = _fingerprint_sql()


def audited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulted orders with a binary label and a note that sometimes holds an e-mail address."""
    key = F.col("o_orderkey")
    return faulted_orders(spark, sf_dir).withColumns({
        "big": (F.col("o_totalprice") > 150000).cast("int"),
        "note": F.when(key % 30 == 0, F.concat(F.lit("mail u"), key, F.lit("@example.com"))).otherwise("ok")})


AUDITED_SQL = FAULTED_SQL + """,
audited AS (SELECT *, CAST(o_totalprice > 150000 AS INTEGER) AS big,
  CASE WHEN o_orderkey % 30 = 0 THEN 'mail u' || o_orderkey || '@example.com' ELSE 'ok' END AS note FROM faulted)"""
