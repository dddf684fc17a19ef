"""Queries that write given tables to the shared folder and read them back, and role suggestions for all three kinds of data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import faults, quality, scoring, suggest
from plumbline.plans.catalogue_scoring import _HIST, monthly_runs
from plumbline.plans.registry import query
from plumbline.sources import fixtures as fx, tables
from plumbline.sources.fixtures import table

_PRIORITY = " SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS priced, min(o_orderdate)::DATE AS first_day FROM "
_ORDER_TYPES = "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _by_priority(frame):
    return frame.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("priced"),
        F.min("o_orderdate").cast("date").alias("first_day"))


@query("WITH " + fx.FAULTED_SQL + _PRIORITY + "faulted GROUP BY 1", digits=2)
def csv_round_trip(spark, sf):
    """Orders with missing cells written as CSV and read by extension, with a schema."""
    path = f"{tables.work_directory(spark)}/orders.csv"
    tables.write_csv(fx.faulted_orders(spark, sf).select(*[c.split()[0] for c in _ORDER_TYPES.split(", ")]), path)
    return _by_priority(tables.read_table(spark, path, _ORDER_TYPES))


@query("WITH " + fx.FAULTED_SQL + _PRIORITY + "faulted GROUP BY 1", digits=2)
def parquet_round_trip(spark, sf):
    path = f"{tables.work_directory(spark)}/orders.parquet"
    fx.faulted_orders(spark, sf).write.parquet(path)
    return _by_priority(tables.read_table(spark, path))


@query("SELECT o_orderpriority, count(*) AS n, count(o_totalprice) FILTER (o_orderkey % 20 <> 0) AS numbers FROM orders GROUP BY 1")
def json_export(spark, sf):
    """A frame as JSON lines: NaN is written as null."""
    path = f"{tables.work_directory(spark)}/orders"
    price = F.when(F.col("o_orderkey") % 20 != 0, F.col("o_totalprice")).otherwise(float("nan"))
    tables.write_json(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", price.alias("price")), path)
    back = spark.read.schema("o_orderkey long, o_orderpriority string, price double").json(path)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("numbers"))


@query(_HIST + " SELECT 'tabular' AS analyzer, run_id, dataset_name, score, grade, round(missingness, 6) AS missingness FROM hist")
def audit_history_scan(spark, sf):
    """Audit records written as JSON beside an unreadable file; the scan skips that file's lines."""
    path = f"{tables.work_directory(spark)}/records"
    runs = scoring.health_score(monthly_runs(spark, sf))
    runs = runs.withColumns({"record_id": F.col("run_id"), "schema_version": F.lit(1), "file_sha256": F.sha2("run_id", 256),
                             "verdict": F.lit(None).cast("string"), "findings": F.array().cast("array<string>"),
                             "recommendations": F.array().cast("array<string>"), "score": F.col("score").cast("long")})
    tables.write_records(runs, path)
    broken = runs.select(F.concat(F.lit('{"run_id": '), "run_id", F.lit(", ]")).alias("value"))
    broken.write.mode("append").text(f"{path}/analyzer=tabular")
    back = tables.read_records(spark, path)
    return back.select("analyzer", "run_id", "dataset_name", "score", "grade", F.col("metrics")["missingness"].alias("missingness"))


# roles

def _tabular(spark, sf):
    return fx.audited_orders(spark, sf).select(
        F.col("o_orderkey").alias("order id"), F.col("o_custkey").alias("customer"), F.col("big").alias("label"), "split",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.col("o_orderpriority").alias("region"), F.col("o_totalprice").alias("price"))


def _series(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("ts").alias("time"),
                                             F.col("event_type").alias("label"), F.col("event_type").alias("region"), "value")


def _assets(spark, sf):
    return fx.doc_labels(spark, sf).select(
        F.col("doc_id").alias("record id"), F.concat(F.lit("img/"), "doc_id", F.lit(".png")).alias("path"), F.col("quality").alias("label"), "split",
        "source", F.col("lang").alias("group"), F.col("toxic").alias("light"))


_TABLES = {
    "tabular": (_tabular, suggest.TABULAR_ROLES, suggest.SPLIT_WORDS, fx.AUDITED_SQL, "audited", {
        "order id": ("o_orderkey", "number"), "customer": ("o_custkey", "number"), "label": ("big", "number"), "split": ("split", "text"),
        "created": ("strftime(o_orderdate, '%Y-%m-%d')", "date text"), "region": ("o_orderpriority", "text"), "price": ("o_totalprice", "number")}),
    "series": (_series, suggest.SERIES_ROLES, suggest.SPLIT_WORDS, "", "events", {
        "id": ("event_id", "number"), "user": ("user_id", "number"), "time": ("ts", "time"), "label": ("event_type", "text"),
        "region": ("event_type", "text"), "value": ("value", "number")}),
    "asset": (_assets, suggest.ASSET_ROLES, suggest.SPLIT_WORDS + "|holdout", fx.DOC_SQL, "doc", {
        "record id": ("doc_id", "number"), "path": ("'img/' || doc_id || '.png'", "text"), "label": ("quality", "number"), "split": ("split", "text"),
        "source": ("source", "text"), "group": ("lang", "text"), "light": ("toxic", "number")})}


def _scores_sql(kind: str) -> str:
    """The column profile of a table and the score of every column for every role, from the same rule table."""
    _, rules, words, head, name, columns = _TABLES[kind]
    parts = []
    for i, (label, (expr, sort)) in enumerate(columns.items()):
        dates = {"time": "1.0", "date text": f"count({expr}) / greatest(1, count(*))"}.get(sort, "0.0")
        top = f"(SELECT count(*) > 0 FROM (SELECT lower(CAST({expr} AS VARCHAR)) AS v, count(*) AS n FROM {name} WHERE {expr} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 12) WHERE regexp_matches(v, '{words}'))"
        parts.append(f"SELECT '{label}' AS \"column\", {i} AS position, {str(sort in ('number',)).lower()} AS \"numeric\", greatest(1, count(*)) AS rows, "
                     f"count(DISTINCT {expr}) AS \"distinct\", count(DISTINCT {expr}) / greatest(1, count(*)) AS ratio, {dates} AS dates, {top} AS split_like FROM {name}")
    cells = []
    for r in rules:
        hits = " + ".join(f"CAST(regexp_matches(lower(trim(\"column\")), '{p}') AS INTEGER)" for p in r.patterns)
        points = "".join(f" + CASE WHEN {c.replace('distinct ', chr(34) + 'distinct' + chr(34) + ' ')} THEN {p} ELSE 0 END" for c, p in r.bonuses)
        points = points.replace("WHEN numeric ", 'WHEN "numeric" ')
        cells.append(f"SELECT '{r.role}' AS role, \"column\", position, ({hits}) * {r.weight}{points} + dates * {r.date_points} AS score FROM pr")
    return ("WITH " + (head + ", " if head else "") + "pr AS (" + " UNION ALL ".join(parts) + "), sc AS (" + " UNION ALL ".join(cells) + ")")


def _chosen_sql(kind: str) -> str:
    rules, taken, parts = _TABLES[kind][1], [], []
    text = _scores_sql(kind)
    for r in rules:
        free = "".join(f" AND \"column\" NOT IN (SELECT \"column\" FROM c_{t})" for t in taken) if r.takes else ""
        text += (f", c_{r.role} AS (SELECT role, \"column\" FROM sc WHERE role = '{r.role}' AND score >= {r.threshold}{free} "
                 f"ORDER BY score DESC, position LIMIT {r.limit})")
        parts.append(f"SELECT role, \"column\" FROM c_{r.role}")
        if r.takes:
            taken.append(r.role)
    return text + " " + " UNION ALL ".join(parts)


def _scores(kind: str):
    build, rules, words = _TABLES[kind][:3]

    def run(spark, sf):
        """Score of every column for every role."""
        return suggest.role_scores(build(spark, sf), rules, words).select("role", "column", "score")

    return run


def _chosen(kind: str):
    build, rules, words = _TABLES[kind][:3]

    def run(spark, sf):
        """The columns chosen for each role."""
        roles = suggest.suggest_roles(build(spark, sf), rules, words)
        rows = [(r.role, c) for r in rules for c in (getattr(roles, r.role) if r.takes else (getattr(roles, r.role),)) if c]
        return spark.createDataFrame(rows, "role string, column string")

    return run


for _kind, _prefix in (("tabular", ""), ("series", "series_"), ("asset", "asset_")):
    query(_scores_sql(_kind) + ' SELECT role, "column", round(score::DOUBLE, 6) AS score FROM sc', f"{_prefix}role_scores")(_scores(_kind))
    query(_chosen_sql(_kind), f"{_prefix}suggested_roles")(_chosen(_kind))


# operators that were without a query

@query("WITH " + fx.AUDITED_SQL + " SELECT round(avg((o_totalprice < 5000 OR o_totalprice > 300000)::INT), 6) AS out_of_range FROM audited WHERE o_totalprice IS NOT NULL")
def numeric_range_rate(spark, sf):
    orders = fx.audited_orders(spark, sf)
    return orders.agg(quality.numeric_range_rate(orders, "o_totalprice", 5000, 300000).alias("out_of_range"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, epoch(o_orderdate) AS t FROM orders), d AS (SELECT stddev_samp(o_totalprice) AS sd FROM s),
q AS (SELECT quantile_cont(t, 0.7) AS cut FROM s)
SELECT count(*) AS n, round(avg(CASE WHEN t >= cut THEN o_totalprice + 3.0 * sd * 0.5 ELSE o_totalprice END), 4) AS mean FROM s, d, q""", digits=4)
def scaled_drift(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    cutoff = faults.late_cutoff(orders, "o_orderdate", 0.7)
    return faults.scaled_drift(orders, "o_orderdate", ["o_totalprice"], 0.5, cutoff).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
