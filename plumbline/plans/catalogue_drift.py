"""Queries on drift, time axes, outliers, fairness and security."""

from pyspark.sql import functions as F

from plumbline.functions.columns import timestamp_of
from plumbline.operators import drift, fairness, profile, quality, robust, security, series
from plumbline.operators.distribution import melt, quantiles, value_counts
from plumbline.plans.registry import ORACLES, query
from plumbline.roles import Roles
from plumbline.sources import fixtures as fx
from plumbline.sources.fixtures import table

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ks_sql(columns, source: str, slice_sql: str) -> str:
    """KS of the first against the last slice, by cumulative shares over the merged values."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, s FROM sl WHERE {c} IS NOT NULL" for c in columns)
    return f"""sl AS (SELECT *, {slice_sql} AS s FROM {source}),
r AS (SELECT min(s) AS a, max(s) AS b FROM sl),
l AS ({long}),
c AS (SELECT "column", v, count(*) FILTER (s = a) AS na, count(*) FILTER (s = b) AS nb FROM l, r WHERE s IN (a, b) GROUP BY 1, 2),
k AS (SELECT "column", sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER p AS ta, sum(nb) OVER p AS tb FROM c
  WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
d AS (SELECT "column", max(abs(ca / ta - cb / tb)) AS ks, CAST(max(ta) AS BIGINT) AS first_values, CAST(max(tb) AS BIGINT) AS last_values
  FROM k GROUP BY 1 HAVING max(ta) >= 20 AND max(tb) >= 20)"""


_SLICES = {
    "month": "strftime({c}, '%Y-%m')", "day": "strftime({c}, '%Y-%m-%d')",
    "quarter": "CAST(year({c}) AS VARCHAR) || 'Q' || quarter({c})",
    "week": "strftime(date_trunc('week', {c}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {c}) + INTERVAL 6 DAY, '%Y-%m-%d')",
}
_KS_OUT = ' SELECT "column", round(ks, 6) AS ks, first_values, last_values FROM d'


def _drift_query(mode: str):
    sql = "WITH " + _ks_sql(_LINE, "lineitem", _SLICES[mode].format(c="l_shipdate")) + _KS_OUT

    @query(sql, name=f"drift_first_last_{mode}")
    def run(spark, sf):
        return drift.drift_of_ends(table(spark, sf, "lineitem"), Roles(time="l_shipdate", slice_mode=mode), _LINE)


for _mode in ("month", "quarter", "week", "day"):
    _drift_query(_mode)


@query("WITH " + fx.FAULTED_SQL + ", " + _ks_sql(["o_orderkey", "o_custkey", "o_totalprice"], "faulted", "split") + _KS_OUT)
def drift_by_split(spark, sf):
    sliced = drift.with_slices(fx.faulted_orders(spark, sf), Roles(time="o_orderdate", split="split"), prefer="split")
    return drift.drift_first_last(sliced, ["o_orderkey", "o_custkey", "o_totalprice"])


_QUARTILE = ("WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, "
             "quantile_cont(l_quantity, 0.75) AS c FROM lineitem), t AS (SELECT lineitem.*, 'q' || (1 + (a < l_quantity)::INT "
             "+ (b < l_quantity AND b <> a)::INT + (c < l_quantity AND c <> b)::INT) AS ql FROM lineitem, q), ")


@query(_QUARTILE + _ks_sql(["l_extendedprice", "l_discount", "l_tax"], "t", "ql") + _KS_OUT)
def drift_by_quartile(spark, sf):
    sliced = drift.with_slices(table(spark, sf, "lineitem"), Roles(time="l_quantity"))
    return drift.drift_first_last(sliced, ["l_extendedprice", "l_discount", "l_tax"])


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT min(s) AS first_slice, max(s) AS last_slice, arg_min(n, s) AS first_slice_rows, arg_max(n, s) AS last_slice_rows, count(*) AS num_slices FROM s""")
def slice_range(spark, sf):
    return drift.slice_range(drift.with_slices(table(spark, sf, "orders"), Roles(time="o_orderdate")))


def _slice_counts_query(mode: str):
    @query(f"SELECT {_SLICES[mode].format(c='ts')} AS slice, count(*) AS n FROM events GROUP BY 1", name=f"slice_labels_{mode}")
    def run(spark, sf):
        sliced = drift.with_slices(table(spark, sf, "events"), Roles(time="ts", slice_mode=mode))
        return sliced.groupBy(F.col(drift.SLICE).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


for _mode in ("month", "quarter", "week", "day"):
    _slice_counts_query(_mode)


_CROSS_KS = """l AS (SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS DOUBLE) AS v, 0 AS s FROM early UNION ALL
  SELECT 'o_totalprice', o_totalprice, 0 FROM early UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS DOUBLE), 1 FROM late
  UNION ALL SELECT 'o_totalprice', o_totalprice, 1 FROM late),
c AS (SELECT "column", v, count(*) FILTER (s = 0) AS na, count(*) FILTER (s = 1) AS nb FROM l GROUP BY 1, 2),
k AS (SELECT "column", v, na, nb, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER p AS ta, sum(nb) OVER p AS tb FROM c
  WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
d AS (SELECT "column", max(abs(ca / ta - cb / tb)) AS ks, sum(v * na) / sum(na) AS m0, sum(v * nb) / sum(nb) AS m1,
  CAST(max(ta) AS DOUBLE) AS ta, CAST(max(tb) AS DOUBLE) AS tb FROM k GROUP BY 1)"""


@query("WITH " + fx.HALVES_SQL + ", " + _CROSS_KS + """, x AS (SELECT *, ks * ks * ta * tb / (ta + tb) AS x2 FROM d)
SELECT "column", round(ks, 6) AS ks, round(CASE WHEN x2 < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0,
  list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * i * i * x2))))) END, 6) AS p_value,
  round(m0, 4) AS baseline_mean, round(m1, 4) AS candidate_mean, round(m1 - m0, 4) AS mean_delta, ks > 0.3 AS flagged FROM x""")
def cross_drift(spark, sf):
    out = drift.cross_drift(*fx.order_halves(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("baseline_mean", "candidate_mean", "mean_delta")})


@query("WITH " + fx.HALVES_SQL + """, m AS (SELECT 'o_orderpriority' AS "column",
  (SELECT 1 - count(o_orderpriority) / count(*) FROM early) AS a, (SELECT 1 - count(o_orderpriority) / count(*) FROM late) AS b)
SELECT "column", round(a, 6) AS baseline_missing, round(b, 6) AS candidate_missing, round(b - a, 6) AS delta FROM m WHERE abs(b - a) > 0.01""")
def missing_shift(spark, sf):
    return drift.missing_shift(*fx.order_halves(spark, sf))


@query("WITH " + fx.HALVES_SQL + ", " + _CROSS_KS + """ SELECT count(*) FILTER (ks > 0.3) AS flagged_columns, round(max(ks), 6) AS max_ks,
  CAST(3 AS BIGINT) AS schema_changes, 'Schema changed' AS verdict FROM d""")
def cross_verdict(spark, sf):
    return drift.cross_verdict(*fx.order_halves(spark, sf))


@query("WITH " + fx.HALVES_SQL + ", " + _CROSS_KS.replace("FROM early", "FROM early2").replace("FROM late", "FROM late2").replace(
    "l AS (", "early2 AS (SELECT o_orderkey, o_totalprice FROM early), late2 AS (SELECT o_orderkey, o_totalprice FROM late), l AS (", 1)
    + """ SELECT count(*) FILTER (ks > 0.05) AS flagged_columns, round(max(ks), 6) AS max_ks, CAST(0 AS BIGINT) AS schema_changes,
  CASE WHEN count(*) FILTER (ks > 0.05) > 0 THEN 'Drift detected' WHEN max(ks) > 0 THEN 'No drift above threshold'
  ELSE 'No comparable numeric columns' END AS verdict FROM d""")
def cross_verdict_same_schema(spark, sf):
    a, b = fx.order_halves(spark, sf)
    return drift.cross_verdict(a.select("o_orderkey", "o_totalprice"), b.select("o_orderkey", "o_totalprice"), 0.05)


@query("WITH " + fx.HALVES_SQL + """ SELECT count(*) AS rows, count(o_orderstatus) AS with_status, round(sum(o_totalprice), 2) AS total
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM early UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM late)""", digits=2)
def concatenated_tables(spark, sf):
    a, b = fx.order_halves(spark, sf)
    both = a.drop("o_custkey").unionByName(b.drop("o_custkey"), allowMissingColumns=True)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count("o_orderstatus").alias("with_status"),
                    F.sum("o_totalprice").alias("total"))


# time axis

@query("""WITH t AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM events),
p AS (SELECT try_strptime(txt, '%Y-%m-%d %H:%M:%S') AS ts FROM t)
SELECT round(count(ts) / count(*), 6) AS parse_ok_rate, count(*) - count(ts) AS num_invalid, min(ts) AS min_time, max(ts) AS max_time,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS span_days FROM p""")
def time_profile(spark, sf):
    texts = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return series.time_profile(texts, "t")


@query("WITH " + fx.EVENT_SQL + """, g AS (SELECT user_id, ts, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / sum(n), 6) AS duplicate_rate FROM g""")
def duplicate_timestamps(spark, sf):
    return series.duplicate_timestamps(fx.event_series(spark, sf), "ts", ["user_id"])


def _steps_sql(partition: str, order: str) -> str:
    return ("WITH " + fx.EVENT_SQL + f", s AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER ({partition} ORDER BY {order}))) / 1e6 AS step FROM ev), "
            "p AS (SELECT step FROM s WHERE step IS NOT NULL) ")


_CADENCE = """SELECT count(*) AS num_steps, round(quantile_cont(step, 0.5), 6) AS median_seconds, round(quantile_cont(step, 0.1), 6) AS p10_seconds,
  round(quantile_cont(step, 0.9), 6) AS p90_seconds, round((quantile_cont(step, 0.9) - quantile_cont(step, 0.1)) / greatest(1e-9, quantile_cont(step, 0.5)), 6)
  AS irregularity_ratio FROM p WHERE step > 0"""
_GAPS = """, m AS (SELECT quantile_cont(step, 0.5) AS med FROM p) SELECT round(med, 6) AS median_gap_seconds, round(quantile_cont(step, 0.95), 6) AS p95_gap_seconds,
  round(max(step), 6) AS largest_gap_seconds, round(avg((step > 10 * med)::INT), 6) AS large_gap_rate FROM p, m GROUP BY med"""
_BY_USER, _ACROSS = _steps_sql("PARTITION BY user_id", "ts"), _steps_sql("", "user_id, ts")


@query(_BY_USER + _CADENCE)
def cadence_within_entity(spark, sf):
    return series.cadence(series.steps(fx.event_series(spark, sf), "ts", ["user_id"]))


@query(_ACROSS + _CADENCE)
def cadence_across_entities(spark, sf):
    return series.cadence(series.steps(fx.event_series(spark, sf), "ts", ["user_id"], across_entities=True))


@query(_steps_sql("", "ts") + _CADENCE)
def cadence_global(spark, sf):
    return series.cadence(series.steps(fx.event_series(spark, sf), "ts"))


@query(_BY_USER.rstrip() + _GAPS)
def gaps_within_entity(spark, sf):
    return series.gaps(series.steps(fx.event_series(spark, sf), "ts", ["user_id"]))


@query(_ACROSS.rstrip() + _GAPS)
def gaps_across_entities(spark, sf):
    return series.gaps(series.steps(fx.event_series(spark, sf), "ts", ["user_id"], across_entities=True))




def _series():
    return ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts")


_WIN = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query("SELECT event_id, round(avg(value) " + _WIN.format(n=24) + ", 6) AS rolling_mean FROM events")
def rolling_mean(spark, sf):
    return series.rolling_mean(table(spark, sf, "events"), *_series(), "value", 25).select("event_id", "rolling_mean")


@query("WITH q AS (SELECT event_id, value, quantile_cont(value, 0.9) " + _WIN.format(n=49) + " AS t FROM events) "
       "SELECT event_id, round(t, 6) AS threshold, value > t AS query FROM q")
def rolling_quantile_budget(spark, sf):
    return series.budget_threshold(table(spark, sf, "events"), *_series(), "value", 50, 0.1).select(
        "event_id", "threshold", "query")


@query("WITH q AS (SELECT event_id, value, quantile_cont(value, 0.9) " + _WIN.format(n=49) + " AS t2, quantile_cont(value, 0.7) "
       + _WIN.format(n=49) + " AS t1 FROM events) SELECT CASE WHEN value > t2 THEN 'human' WHEN value > least(t1, t2) THEN 'oracle' ELSE 'none' END AS route, "
       "count(*) AS n, round(sum(least(t1, t2)), 4) AS tau1_sum, round(sum(t2), 4) AS tau2_sum FROM q GROUP BY 1", digits=4)
def two_tier_routes(spark, sf):
    routed = series.two_tier_routes(table(spark, sf, "events"), *_series(), "value", 50, 0.1, 0.2)
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("tau1").alias("tau1_sum"), F.sum("tau2").alias("tau2_sum"))


@query("""WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT a.event_id, a.pos AS position, round(sum(b.value * (CASE WHEN b.pos = 1 THEN 1.0 ELSE 0.12 END) * pow(0.88, a.pos - b.pos)), 6) AS ema
FROM r a JOIN r b ON a.user_id = b.user_id AND b.pos <= a.pos GROUP BY 1, 2""")
def exponential_average(spark, sf):
    return series.exponential_average(table(spark, sf, "events"), *_series(), "value").select(
        "event_id", F.col("_pos").cast("bigint").alias("position"), "ema")


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_per_step(spark, sf):
    daily = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "value", "event_id")
    return series.last_per_step(daily, ["user_id", "day"], ["event_id"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2")
def max_per_step(spark, sf):
    daily = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return series.max_per_step(daily, ["user_id", "day"], "value")


_HOUR = "CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS BIGINT)"


def _hour():
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("bigint")


@query(f"""WITH h AS (SELECT event_type, {_HOUR} AS t, max((value > 20)::INT) AS q FROM events GROUP BY 1, 2),
x AS (SELECT event_type, unnest(range(0, (SELECT max(t) FROM h) + 1)) AS t FROM (SELECT DISTINCT event_type FROM h)),
d AS (SELECT x.event_type, x.t, coalesce(q, 0) AS q FROM x LEFT JOIN h USING (event_type, t))
SELECT event_type, t, CAST(sum(q) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS cumulative FROM d""")
def cumulative_on_axis(spark, sf):
    log = table(spark, sf, "events").select("event_type", _hour().alias("t"), (F.col("value") > 20).cast("bigint").alias("q"))
    last = log.agg(F.max("t")).scalar()
    return series.cumulative_on_axis(log, "event_type", "t", "q", last)


@query(f"SELECT event_type, {_HOUR} // 24 * 24 AS bin, round(avg((value > 20)::INT), 6) AS rate, count(*) AS n FROM events GROUP BY 1, 2")
def binned_rate(spark, sf):
    log = table(spark, sf, "events").select("event_type", _hour().alias("t"), "value")
    return series.binned_rate(log, ["event_type"], "t", F.col("value") > 20, 24)


@query("SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS seconds FROM events")
def timestamp_feature(spark, sf):
    events = table(spark, sf, "events")
    from plumbline.functions.columns import seconds_of
    return events.select("event_id", seconds_of(timestamp_of(events, "ts")).alias("seconds"))


@query("SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rnk FROM part")
def average_ranks(spark, sf):
    from plumbline.operators.distribution import average_ranks as ranks
    return ranks(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "rnk").select(
        "p_partkey", "p_brand", "rnk")


@query("WITH z AS (SELECT p_partkey, p_retailprice AS x, avg(p_retailprice) OVER w AS m, stddev_pop(p_retailprice) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand)) "
       "SELECT p_partkey, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS z FROM z")
def group_z_scores(spark, sf):
    return series.z_scores(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "z").select("p_partkey", "z")


# robustness

_QUANT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_values, round(quantile_cont({c}, 0.1), 6) AS p10, "
                            f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lineitem" for c in _LINE)


@query(_QUANT)
def exact_quantiles(spark, sf):
    counts = value_counts(melt(table(spark, sf, "lineitem"), _LINE), ["column"])
    return quantiles(counts, ["column"], {"p10": 0.1, "median": 0.5, "p99": 0.99})


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT), 6) AS outlier_rate, count({c}) AS n_values "
    f"FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})" for t, c in
    [("lineitem", c) for c in _LINE] + [("lineitem", "l_linenumber")]))
def iqr_outliers(spark, sf):
    return robust.iqr_outliers(table(spark, sf, "lineitem"), [*_LINE, "l_linenumber"])


def _mad_sql(columns, source: str, keep: str) -> str:
    med = ", ".join(f"median({c}) AS m_{c}" for c in columns)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in columns)
    parts = " + ".join(f"coalesce(CASE WHEN d_{c} > 0 THEN abs({c} - m_{c}) / d_{c} END, 0)" for c in columns)
    used = " + ".join(f"(d_{c} > 0 AND {c} IS NOT NULL)::INT" for c in columns)
    return (f"md AS (SELECT {med} FROM {source}), mm AS (SELECT {mad} FROM {source}, md), "
            f"sc AS (SELECT {keep}, CASE WHEN ({used}) > 0 THEN ({parts}) / ({used}) END AS score FROM {source}, md, mm)")


_MAD = "WITH " + fx.FAULTED_SQL + ", " + _mad_sql(["o_custkey", "o_totalprice"], "faulted", "o_orderkey, split, o_orderstatus")


def _scored(spark, sf):
    return robust.mad_scores(fx.faulted_orders(spark, sf), ["o_custkey", "o_totalprice"], ["o_orderkey", "split", "o_orderstatus"])


@query(_MAD + " SELECT round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(avg(coalesce((score > 3)::INT, 0)), 6) AS outlier_rate, "
       "count(*) FILTER (score > 3) AS outlier_count, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99 FROM sc")
def mad_score_summary(spark, sf):
    return robust.score_summary(_scored(spark, sf))


@query(_MAD + " SELECT o_orderkey, split, round(score, 6) AS anomaly_score FROM sc ORDER BY score DESC NULLS LAST, o_orderkey, split LIMIT 20")
def mad_top_rows(spark, sf):
    return robust.top_anomalies(_scored(spark, sf), ["o_orderkey", "split"]).select("o_orderkey", "split", "anomaly_score")


@query(_MAD + " SELECT o_orderstatus AS label, round(avg(coalesce((score > 2)::INT, 0)), 6) AS outlier_rate, count(*) AS n FROM sc GROUP BY 1 HAVING count(*) >= 5")
def outlier_rate_by_label(spark, sf):
    return robust.outlier_rate_by_label(_scored(spark, sf), "o_orderstatus", 2.0)


@query("WITH " + fx.DOC_SQL + """, t AS (SELECT lang || '-' || source AS bucket, CASE WHEN n_chars > 900 THEN 'long' || source ELSE 'short' END AS size, quality FROM doc),
l AS (SELECT 'bucket' AS "column", bucket AS value, quality FROM t UNION ALL SELECT 'size', size, quality FROM t),
c AS (SELECT "column", value, quality, count(*) AS n FROM l GROUP BY 1, 2, 3),
v AS (SELECT "column", value, CAST(sum(n) AS BIGINT) AS "count", sum(n) FILTER (quality IS NOT NULL) AS known, max(n) FILTER (quality IS NOT NULL) AS top FROM c GROUP BY 1, 2)
SELECT v."column", v.value, v."count", CAST((SELECT min(CAST(c.quality AS VARCHAR)) FROM c WHERE c."column" = v."column" AND c.value = v.value AND c.n = v.top AND c.quality IS NOT NULL) AS VARCHAR) AS top_label,
  round(top / known, 6) AS top_label_share FROM v WHERE "count" >= 5 AND "count" <= greatest(5, floor((SELECT count(*) FROM doc) * 0.001)) AND top / known >= 0.95""")
def rare_category_concentration(spark, sf):
    docs = fx.doc_labels(spark, sf).select(
        F.concat_ws("-", "lang", "source").alias("bucket"),
        F.when(F.col("n_chars") > 900, F.concat(F.lit("long"), "source")).otherwise("short").alias("size"), "quality")
    return robust.rare_categories(docs, "quality")


_RARE = ORACLES["rare_category_concentration"]


@query(_RARE + ' ORDER BY top_label_share DESC, "count" DESC, "column", value LIMIT 20')
def top_rare_categories(spark, sf):
    """The twenty findings of largest concentration."""
    return robust.top_rare_categories(rare_category_concentration(spark, sf))


_COND = """WITH l AS (SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'weekday', CAST(isodow(ts) AS VARCHAR) FROM events),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS p, 1.0 / count(*) OVER (PARTITION BY "column") AS q FROM c)
SELECT "column", count(*) AS num_bins, round(min(p), 6) AS worst_bin_coverage,
  round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 6) AS jsd_vs_uniform FROM s GROUP BY 1"""


@query(_COND)
def condition_coverage(spark, sf):
    frame = table(spark, sf, "events").select("event_type", (F.weekday("ts") + 1).alias("weekday"))
    return quality.condition_coverage(frame, ["event_type", "weekday"])


@query("""WITH c AS (SELECT source AS v, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c),
e AS (SELECT count(*) AS k, -sum(p * ln(p)) AS h FROM s)
SELECT 'source' AS "column", k AS num_sources, round(h, 6) AS entropy, round(h / ln(k), 6) AS normalized_entropy, round(exp(h), 6) AS effective_number FROM e""")
def source_diversity(spark, sf):
    return quality.source_diversity(table(spark, sf, "documents"), "source")


# fairness

def _cube(spark, sf, label="quality"):
    return fairness.group_cube(fx.doc_labels(spark, sf), ["lang", "source"], label)


_CUBE = "WITH " + fx.DOC_SQL + """, cube AS (SELECT 'lang' AS group_column, lang AS grp, CAST(quality AS VARCHAR) AS label, count(*) AS n FROM doc GROUP BY 1, 2, 3
  UNION ALL SELECT 'source', source, CAST(quality AS VARCHAR), count(*) FROM doc GROUP BY 1, 2, 3)"""


@query(_CUBE + """, g AS (SELECT group_column, grp, sum(n) AS n FROM cube GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY group_column) AS p, 1.0 / count(*) OVER (PARTITION BY group_column) AS q FROM g)
SELECT group_column, count(*) AS num_groups, round(min(p), 6) AS min_group_share, round(max(p), 6) AS max_group_share, CAST(min(n) AS BIGINT) AS min_subgroup_support,
  round(max(p) / min(p), 6) AS max_representation_disparity, round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 6) AS jsd_vs_uniform,
  round(-sum(p * ln(p)), 6) AS coverage_entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS coverage_normalized_entropy FROM s GROUP BY 1""")
def group_representation(spark, sf):
    return fairness.representation(_cube(spark, sf))


@query(_CUBE + """, g AS (SELECT group_column, grp, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY 1, 2)
SELECT group_column, grp, n, round(n / sum(n) OVER (PARTITION BY group_column), 6) AS share,
  round(n * count(*) OVER (PARTITION BY group_column) / sum(n) OVER (PARTITION BY group_column), 6) AS ratio FROM g ORDER BY n DESC, group_column, grp LIMIT 10""")
def representation_ratios(spark, sf):
    return fairness.representation_ratios(_cube(spark, sf))


@query("WITH " + fx.DOC_SQL + ", r AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS group_column, {g} AS grp, 1 - count(quality) / count(*) AS a, 1 - count(toxic) / count(*) AS b FROM doc GROUP BY 2" for g in ("lang", "source"))
    + """) SELECT group_column, 'quality' AS "column", round(max(a) - min(a), 6) AS disparity FROM r GROUP BY 1 UNION ALL
  SELECT group_column, 'toxic', round(max(b) - min(b), 6) FROM r GROUP BY 1 UNION ALL SELECT group_column, 'n_chars', 0.0 FROM r GROUP BY 1""")
def missing_disparity(spark, sf):
    return fairness.missing_disparity(fx.doc_labels(spark, sf), ["lang", "source"], ["n_chars", "quality", "toxic"])


@query(_CUBE + " SELECT group_column, grp, round(coalesce(sum(n) FILTER (label IS NULL), 0) / sum(n), 6) AS label_missing_rate FROM cube GROUP BY 1, 2")
def label_missing_by_group(spark, sf):
    return fairness.label_missing_by_group(_cube(spark, sf))


_POSITIVE = ", pr AS (SELECT group_column, grp, coalesce(sum(n) FILTER (label = '1'), 0) / sum(n) AS positive_rate, CAST(sum(n) AS BIGINT) AS n FROM cube WHERE label IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2)"


@query(_CUBE + _POSITIVE + " SELECT group_column, grp, round(positive_rate, 6) AS positive_rate, n FROM pr")
def positive_rate_by_group(spark, sf):
    return fairness.positive_rates(_cube(spark, sf))


@query(_CUBE + _POSITIVE + " SELECT group_column, round(max(positive_rate) - min(positive_rate), 6) AS positive_rate_disparity FROM pr GROUP BY 1")
def positive_rate_disparity(spark, sf):
    return fairness.positive_rate_disparity(_cube(spark, sf))


@query(_CUBE + """, k AS (SELECT * FROM cube WHERE label IS NOT NULL), g AS (SELECT group_column, grp, sum(n) AS t FROM k GROUP BY 1, 2),
gg AS (SELECT DISTINCT group_column, grp FROM cube), lb AS (SELECT DISTINCT group_column, label FROM k),
x AS (SELECT gg.group_column, gg.grp, lb.label, coalesce(k.n / g.t, 0) AS share FROM gg JOIN lb USING (group_column)
  LEFT JOIN k ON k.group_column = gg.group_column AND k.grp = gg.grp AND k.label = lb.label LEFT JOIN g ON g.group_column = gg.group_column AND g.grp = gg.grp)
SELECT group_column, label, round(max(share) - min(share), 6) AS parity_gap FROM x GROUP BY 1, 2""")
def parity_gap(spark, sf):
    return fairness.parity_gaps(_cube(spark, sf))


@query(_CUBE + " SELECT group_column, grp, label, round(n / sum(n) OVER (PARTITION BY group_column, grp), 6) AS share FROM cube WHERE label IS NOT NULL")
def label_distribution_by_group(spark, sf):
    return fairness.label_distribution(_cube(spark, sf))


@query(_CUBE + """, j AS (SELECT *, sum(n) OVER (PARTITION BY group_column, grp) AS g, sum(n) OVER (PARTITION BY group_column, label) AS l,
  sum(n) OVER (PARTITION BY group_column) AS t FROM cube WHERE label IS NOT NULL AND grp IS NOT NULL)
SELECT group_column, round(sum(n / t * ln(n * t / (g * l))), 6) AS mutual_information, CAST(max(t) AS BIGINT) AS rows FROM j GROUP BY 1 HAVING max(t) > 10""")
def mutual_information(spark, sf):
    return fairness.mutual_information(_cube(spark, sf))


@query("""WITH j0 AS (SELECT lang AS g, source AS c, count(*) AS n FROM documents GROUP BY 1, 2), j AS (SELECT n, sum(n) OVER (PARTITION BY g) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM j0)
SELECT 'lang' AS group_column, round(sum(n / t * ln(n * t / (a * b))), 6) AS mutual_information, CAST(max(t) AS BIGINT) AS rows FROM j""")
def group_context_information(spark, sf):
    return fairness.mutual_information(fairness.group_cube(table(spark, sf, "documents"), ["lang"], "source"))


_INTER = "WITH " + fx.DOC_SQL + ", i AS (SELECT lang || ' × ' || source AS subgroup, count(*) AS n FROM doc GROUP BY 1)"


@query(_INTER + ", s AS (SELECT n, n / (SELECT sum(n) FROM i) AS p FROM i) SELECT count(*) AS num_subgroups, min(n) AS min_subgroup_support, "
       "round(-sum(p * ln(p)), 6) AS coverage_entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS coverage_normalized_entropy FROM s")
def intersectional_coverage(spark, sf):
    return fairness.intersectional_coverage(fx.doc_labels(spark, sf), ["lang", "source"])


@query(_INTER + " SELECT subgroup, n FROM i ORDER BY n, subgroup LIMIT 10")
def smallest_intersections(spark, sf):
    return fairness.smallest_intersections(fx.doc_labels(spark, sf), ["lang", "source"])


# security

def _pii_sql(source: str, columns) -> str:
    from plumbline.functions.columns import PII_PATTERNS
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{p}' AS pattern, round(avg(regexp_matches({c}, '{r}')::INT), 6) AS hit_rate FROM {source}"
        for c in columns for p, r in PII_PATTERNS.items())


@query(_pii_sql("documents", ["text", "lang", "source"]))
def pii_scan_documents(spark, sf):
    return security.pii_hit_rates(table(spark, sf, "documents"), ["text", "lang", "source"])


@query(_pii_sql("conversations", ["text", "role"]))
def pii_scan_conversations(spark, sf):
    return security.pii_hit_rates(table(spark, sf, "conversations"), ["text", "role"])


@query("SELECT * FROM (" + _pii_sql("pages", ["url", "html"]) + ") WHERE hit_rate >= 0.01")
def pii_findings_pages(spark, sf):
    return security.pii_findings(security.pii_hit_rates(table(spark, sf, "pages"), ["url", "html"]))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c)
SELECT round(sum(p * p), 6) AS hhi, count(*) AS num_sources, round(max(p), 6) AS top_source_share,
  CASE WHEN sum(p * p) > 0.25 THEN 'high_concentration' ELSE 'acceptable' END AS interpretation FROM s""")
def source_concentration(spark, sf):
    return security.source_concentration(table(spark, sf, "documents"), "source")


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


_ENCODED = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))


@query(f"""WITH e AS (SELECT {_ENCODED} AS x FROM documents), d AS (SELECT sha256(x) AS h, strlen(x) AS b FROM e)
SELECT count(*) AS rows, CAST(sum(b) AS BIGINT) AS encoded_bytes, sha256(concat_ws(',', {_WORDS})) AS fingerprint FROM d""")
def table_fingerprint(spark, sf):
    return security.table_fingerprint(table(spark, sf, "documents"))


@query("SELECT count(*) AS total_items, count(*) FILTER (doc_id % 20 <> 0) AS items_with_hash, round(count(*) FILTER (doc_id % 20 <> 0) / count(*), 6) AS integrity_coverage FROM documents")
def hash_coverage(spark, sf):
    return security.hash_coverage(table(spark, sf, "documents"), F.when(F.col("doc_id") % 20 != 0, F.sha2("text", 256)))


@query("""SELECT count(*) AS total, count(*) FILTER (doc_id % 50 = 0 OR strlen(text) < 100) AS suspicious_count, count(*) FILTER (doc_id % 50 = 0) AS unreadable,
  count(*) FILTER (strlen(text) < 100) AS tiny, round(avg((doc_id % 50 = 0 OR strlen(text) < 100)::INT), 6) AS suspicious_rate FROM documents""")
def suspicious_items(spark, sf):
    return security.suspicious_items(table(spark, sf, "documents"), F.col("doc_id") % 50 != 0, F.octet_length("text"))


@query("SELECT 'user_id' AS \"column\", count(user_id) AS present_values FROM events")
def declared_identifiers(spark, sf):
    return security.declared_identifiers(table(spark, sf, "events"), ["user_id"])


@query("SELECT doc_id, lang FROM documents ORDER BY (doc_id * 7919 + 733103) % 1000003, doc_id LIMIT 2000")
def keyed_row_sample(spark, sf):
    """Sampling operator: 2000 documents in the order of a draw from their keys."""
    draw = F.pmod(F.col("doc_id") * 7919 + 733103, F.lit(1000003))
    return security.keyed_sample(table(spark, sf, "documents").select("doc_id", "lang"), [F.col("doc_id")], 7, 2000, draw)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS r FROM documents)
SELECT doc_id, source FROM r WHERE r <= 20""")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return security.stratified_sample(docs, "source", [F.col("doc_id") * 7919 % 1009, F.col("doc_id")], 20)


@query("SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1 HAVING count(*) > 0.03 * (SELECT count(*) FROM documents)")
def dominant_sources(spark, sf):
    return security.share_above(profile.entity_counts(table(spark, sf, "documents"), ["source"], None), "n", [], 0.03)



