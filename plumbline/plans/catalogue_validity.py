"""Queries on the fault grid, validity statistics and supervision logs."""

import math

from pyspark.sql import functions as F

from plumbline.operators import faults, gate, validity
from plumbline.operators.scoring import CLEAN_RECOMMENDATION, DEFAULT_WEIGHTS, TABULAR_RULES
from plumbline.plans import grid as g
from plumbline.plans.catalogue_scoring import SCORE_SQL, _RULE_SQL, runs_sql
from plumbline.plans.registry import query
from plumbline.sources import fixtures as fx
from plumbline.sources.fixtures import table


def _draw(salt: int) -> str:
    return f"(((o_orderkey * 7919 + seed * 104729 + {salt * 15485863}) % 1000) / 1000.0)"


def _grid_sql() -> str:
    cells = ", ".join(f"('{f}', {s}, {seed}, '{f}-{s:.2f}-{seed}')" for f in g.FAULTS for s in g.SEVERITIES for seed in g.SEEDS)
    cut = "quantile_cont(epoch_us(o_orderdate) / 1e6, {q})"
    recs = " || ' ' || ".join(f"CASE WHEN {c} THEN '{TABULAR_RULES[i][4]}' ELSE '' END" for c, i in _RULE_SQL)
    primary = " ".join(f"WHEN fault = '{f}' THEN coalesce({m}, 0)" for f, m, _, _ in validity.FAULT_RULES)
    level = " ".join(f"WHEN fault = '{f}' THEN {v}" for f, _, v, _ in validity.FAULT_RULES)
    names = " ".join(f"WHEN fault = '{f}' THEN '{m}'" for f, m, _, _ in validity.FAULT_RULES)
    words = " ".join(f"WHEN fault = '{f}' THEN '{k}'" for f, _, _, k in validity.FAULT_RULES)
    statuses = []
    for name, p in gate.POLICIES.items():
        checks = [("score", p["min_health_score"], "<")] + [(m, p[k], ">") for _, m, k in gate._LIMITS]
        if not p["allow_pii"]:
            checks.append(("pii_flag_count", 0, ">"))
        failed = " OR ".join(f"coalesce({m} {op} {v}, false)" for m, v, op in checks)
        statuses.append(f"CASE WHEN {failed} THEN 'FAIL' ELSE 'PASS' END AS gate_{name.split(' ')[0].lower()}")
    price = f"CASE WHEN fault = 'missingness' AND {_draw(1)} < severity THEN NULL WHEN fault = 'drift' AND epoch_us(o_orderdate) / 1e6 >= q3 THEN o_totalprice + severity * 200000 ELSE o_totalprice END"
    cust = f"CASE WHEN fault = 'missingness' AND {_draw(2)} < severity THEN NULL WHEN fault = 'drift' AND epoch_us(o_orderdate) / 1e6 >= q3 THEN o_custkey - severity * 500 ELSE o_custkey END"
    target = (f"CASE WHEN fault = 'fairness' AND severity > 0 THEN (CASE WHEN o_orderpriority = '1-URGENT' THEN {_draw(106)} < least(0.95, 0.5 + severity) "
              f"ELSE {_draw(106)} < greatest(0.05, 0.5 - severity) END)::INT ELSE ((o_orderkey * 7919) % 1000 < 500)::INT END")
    features = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "split", "note", "target"]
    contents = "o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, note, target"
    return f"""WITH cells(fault, severity, seed, rid) AS (VALUES {cells}),
cut AS (SELECT {cut.format(q=0.25)} AS q1, {cut.format(q=0.75)} AS q3 FROM orders),
x0 AS (SELECT o_orderkey, {cust} AS o_custkey, {price} AS o_totalprice, o_orderdate, o_orderpriority, {fx.SPLIT_SQL.format(k='o_orderkey')} AS split,
  CASE WHEN fault = 'pii' AND {_draw(105)} < severity THEN 'contact operator_' || o_orderkey || '@example.com' ELSE 'normal' END AS note, {target} AS target, rid, fault, severity, seed,
  CASE WHEN epoch_us(o_orderdate) / 1e6 <= q1 THEN 0 WHEN epoch_us(o_orderdate) / 1e6 >= q3 THEN 1 END AS late FROM orders, cells, cut),
x AS MATERIALIZED (SELECT * FROM x0 UNION ALL SELECT * FROM x0 WHERE fault = 'duplicates' AND {_draw(101)} < severity
  UNION ALL SELECT * REPLACE (CASE WHEN split = 'test' THEN 'train' ELSE 'test' END AS split) FROM x0 WHERE fault = 'split_leakage' AND {_draw(103)} < severity),
{runs_sql('x', 'rid', 'late', ['o_totalprice', 'o_custkey'], ['o_orderpriority', 'note'], ['o_orderpriority'], 'target', features, contents)}, {SCORE_SQL},
grid0 AS (SELECT *, split_part(run_id, '-', 1) AS fault, CAST(split_part(run_id, '-', 2) AS DOUBLE) AS severity, CAST(split_part(run_id, '-', 3) AS INTEGER) AS seed,
  {recs} AS recs, {', '.join(statuses)} FROM graded),
grid AS MATERIALIZED (SELECT *, gate_balanced AS status, CASE {names} END AS primary_metric, CAST(CASE {primary} END AS DOUBLE) AS primary_value,
  CASE {primary} END > CASE {level} END AS detected,
  regexp_matches(lower(CASE WHEN trim(recs) = '' THEN '{CLEAN_RECOMMENDATION}' ELSE recs END), CASE {words} END) AS recommendation_hit FROM grid0)"""


_GRID = _grid_sql()


def _grid(spark, sf):
    return g.grid_table(spark, sf)


@query(_GRID + " SELECT fault, severity, seed, n_rows, score, grade, status, primary_metric, round(primary_value, 6) AS primary_value, detected, recommendation_hit FROM grid")
def fault_grid(spark, sf):
    return _grid(spark, sf).select("fault", "severity", "seed", "n_rows", "score", "grade", "status", "primary_metric",
                                   "primary_value", "detected", "recommendation_hit")


@query(_GRID + """ SELECT fault, severity, primary_metric, round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0), 6) AS score_std, round(avg(primary_value), 6) AS value_mean,
  round(coalesce(stddev_samp(primary_value), 0), 6) AS value_std, round(avg(detected::INT), 6) AS detected_rate, round(avg(recommendation_hit::INT), 6) AS recommendation_rate,
  round(avg((status = 'FAIL')::INT), 6) AS policy_fail_rate FROM grid GROUP BY 1, 2, 3""")
def grid_aggregate(spark, sf):
    return validity.aggregate_grid(_grid(spark, sf))


@query(_GRID + " SELECT fault, " + ", ".join(f"round(avg(detected::INT) FILTER (severity = {s}), 6) AS s{int(round(s * 100)):02d}" for s in g.SEVERITIES) + " FROM grid GROUP BY 1")
def detection_matrix(spark, sf):
    return validity.severity_matrix(_grid(spark, sf), F.col("detected").cast("double"), g.SEVERITIES)


@query(_GRID + " SELECT fault, min(severity) FILTER (r >= 0.999 AND severity > 0) AS min_severity FROM (SELECT fault, severity, avg(detected::INT) AS r FROM grid GROUP BY 1, 2) GROUP BY 1")
def minimum_detectable_severity(spark, sf):
    return validity.minimum_detectable(_grid(spark, sf))


@query(_GRID + """, pr AS (SELECT a.fault, avg(CASE WHEN a.primary_value > b.primary_value THEN 1.0 WHEN a.primary_value = b.primary_value THEN 0.5 ELSE 0 END) AS auc,
  count(DISTINCT a.run_id) AS positives, count(DISTINCT b.run_id) AS negatives FROM grid a JOIN grid b ON a.fault = b.fault AND a.severity > 0 AND b.severity = 0 GROUP BY 1)
SELECT fault, positives, negatives, round(auc, 6) AS auc FROM pr""")
def detection_roc_auc(spark, sf):
    return validity.roc_of(_grid(spark, sf), ["fault"], F.col("primary_value"), F.col("severity") > 0).drop("average_precision")


@query(_GRID + " SELECT policy, round(avg(f::INT) FILTER (severity = 0), 6) AS false_block, round(avg(f::INT) FILTER (severity > 0), 6) AS true_block FROM (" + " UNION ALL ".join(
    f"SELECT '{n.split(' ')[0].lower()}' AS policy, severity, gate_{n.split(' ')[0].lower()} = 'FAIL' AS f FROM grid" for n in gate.POLICIES) + ") GROUP BY 1")
def gate_calibration(spark, sf):
    short = [n.split(" ")[0].lower() for n in gate.POLICIES]
    long = _grid(spark, sf).unpivot(["run_id", "severity"], [f"gate_{n}" for n in short], "policy", "status")
    return validity.gate_calibration(long.withColumn("policy", F.substring("policy", 6, 40)))


@query(_GRID + " SELECT fault, " + ", ".join(f"round(avg({w} - {d}_points), 6) AS lost_{d}" for d, w in DEFAULT_WEIGHTS.items()) + " FROM grid WHERE severity = 0.4 GROUP BY 1")
def dimension_attribution(spark, sf):
    return validity.attribution(_grid(spark, sf))


_DROPS = ", ".join(f"avg({d}_points) FILTER (severity = 0) - avg({d}_points) FILTER (severity = 0.4) AS x_{d}" for d in DEFAULT_WEIGHTS)
_FULL = "(" + " + ".join(f"x_{d}" for d in DEFAULT_WEIGHTS) + ")"


@query(_GRID + f", dr AS (SELECT fault, {_DROPS} FROM grid GROUP BY 1) SELECT fault, round({_FULL}, 6) AS full_drop, " + ", ".join(
    f"round(CASE WHEN abs({_FULL}) > 1e-12 THEN ({_FULL} - x_{d}) / {(100 - w) / 100} / {_FULL} ELSE 0 END, 6) AS retain_wo_{d}" for d, w in DEFAULT_WEIGHTS.items()) + " FROM dr")
def leave_one_dimension_out(spark, sf):
    return validity.leave_one_out(_grid(spark, sf))


@query(_GRID + """, mm AS (SELECT *, min(primary_value) OVER (PARTITION BY fault) AS lo, max(primary_value) OVER (PARTITION BY fault) AS hi FROM grid),
nn AS (SELECT fault, severity, (primary_value - lo) / CASE WHEN hi <> lo THEN hi - lo ELSE 1 END AS v FROM mm)
SELECT fault, round(avg(v) FILTER (severity = 0), 6) AS clean_mean, round(avg(v) FILTER (severity > 0), 6) AS faulty_mean FROM nn GROUP BY 1""")
def normalised_response(spark, sf):
    return validity.normalised_response(_grid(spark, sf))


@query(_GRID + " SELECT fault, severity, seed FROM grid WHERE NOT (fault IN ('drift', 'pii') AND severity >= 0.1)")
def grid_resume(spark, sf):
    plan = _grid(spark, sf).select("fault", "severity", "seed")
    return validity.remaining_cells(plan, plan.filter("fault IN ('drift', 'pii') AND severity >= 0.1"), ["fault", "severity", "seed"])


# Model runs: (data set, model, severity, seed) cells derived from line items stand in for learner results.

def model_runs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), (F.round(F.col("l_discount") * 10, 0) / 2).alias("severity"),
        F.pmod("l_linenumber", F.lit(4)).alias("seed")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("l_quantity") * 3, 1).alias("score"), (F.avg("l_extendedprice") / 60000).alias("auc"))


_RUNS = """WITH mr AS (SELECT l_returnflag AS dataset, l_linestatus AS model, round(l_discount * 10, 0) / 2 AS severity, l_linenumber % 4 AS seed, count(*) AS rows,
  round(avg(l_quantity) * 3, 1) AS score, avg(l_extendedprice) / 60000 AS auc FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query(_RUNS + """, c AS (SELECT dataset, model, count(*) AS n, corr(score, auc) AS r FROM mr GROUP BY 1, 2)
SELECT dataset, model, n, round(r, 6) AS pearson_r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_statistic FROM c""")
def pearson_by_group(spark, sf):
    return validity.correlation(model_runs(spark, sf), ["dataset", "model"], "score", "auc")


@query(_RUNS + """, k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model ORDER BY auc) + (count(*) OVER (PARTITION BY model, auc) - 1) / 2.0 AS b FROM mr)
SELECT model, count(*) AS n, round(corr(a, b), 6) AS spearman_rho FROM k GROUP BY 1""")
def spearman_by_model(spark, sf):
    return validity.spearman(model_runs(spark, sf), ["model"], "score", "auc")


_Z = """, z AS (SELECT *, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS zs, (auc - avg(auc) OVER w) / stddev_pop(auc) OVER w AS za FROM mr WINDOW w AS (PARTITION BY dataset, model))"""


@query(_RUNS + _Z + ", c AS (SELECT model, count(*) AS n, corr(zs, za) AS r FROM z GROUP BY 1) SELECT model, n, round(r, 6) AS pearson_r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_statistic FROM c")
def pooled_correlation(spark, sf):
    return validity.pooled_correlation(model_runs(spark, sf), "dataset", ["model"], "score", "auc")


@query(_RUNS + ", c AS (SELECT dataset, model, corr(score, auc) AS r FROM mr GROUP BY 1, 2) SELECT model, round((exp(2 * avg(atanh(r))) - 1) / (exp(2 * avg(atanh(r))) + 1), 6) AS fisher_mean FROM c GROUP BY 1")
def fisher_mean_correlation(spark, sf):
    rs = validity.correlation(model_runs(spark, sf), ["dataset", "model"], "score", "auc")
    return validity.fisher_mean(rs, ["model"], "pearson_r")


@query(_RUNS + _Z + """, d AS (SELECT model, dataset, avg(auc) FILTER (severity = 0) - avg(auc) FILTER (severity >= 0.4) AS d FROM mr GROUP BY 1, 2)
SELECT model, round((SELECT avg(d) FROM d WHERE d.model = z.model), 6) AS sensitivity, round(corr(zs, za), 6) AS r FROM z GROUP BY model""")
def sensitivity_law(spark, sf):
    return validity.sensitivity_law(model_runs(spark, sf))


_HARM = _RUNS + """, cl AS (SELECT dataset, avg(auc) FILTER (severity = 0) AS c FROM mr GROUP BY 1), h AS (SELECT mr.*, c - auc >= 0.002 AS harm, score < 76 AS fail FROM mr JOIN cl USING (dataset))"""


def _harm(spark, sf):
    return validity.harm_flags(model_runs(spark, sf), 0.002).withColumn("fail", F.col("score") < 76)


@query(_HARM + """, c AS (SELECT count(*) FILTER (fail AND harm) AS tp, count(*) FILTER (fail AND NOT harm) AS fp, count(*) FILTER (NOT fail AND harm) AS fn, count(*) FILTER (NOT fail AND NOT harm) AS tn FROM h)
SELECT tp, fp, fn, tn, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(fp / (fp + tn + 1e-9), 6) AS fpr FROM c""")
def gate_as_harm_detector(spark, sf):
    return validity.gate_as_detector(_harm(spark, sf))


_ROC = """, s AS (SELECT {k} score, count(*) FILTER (harm) AS p, count(*) FILTER (NOT harm) AS n FROM h GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM s WINDOW w AS (ORDER BY score))"""


@query(_HARM + _ROC.format(k="") + """ SELECT CAST(max(tp) AS BIGINT) AS positives, CAST(max(tn) AS BIGINT) AS negatives, round(sum(p * (cn - n + n / 2.0)) / max(tp * tn), 6) AS auc,
  round(sum(p * (tp - cp + p) / (tp - cp + p + tn - cn + n)) / max(tp), 6) AS average_precision FROM c""")
def harm_roc_auc(spark, sf):
    found = validity.roc_of(_harm(spark, sf).withColumn("k", F.lit(1)), ["k"], F.col("score"), F.col("harm"))
    return found.drop("k")


@query(_HARM + _ROC.format(k="") + " SELECT score AS threshold, round((tn - cn + n) / tn, 6) AS fpr, round((tp - cp + p) / tp, 6) AS tpr FROM c")
def roc_curve_points(spark, sf):
    return validity.roc_points(_harm(spark, sf).withColumn("k", F.lit(1)), ["k"], F.col("score"), F.col("harm")).drop("k")


@query(_HARM + _ROC.format(k="") + """ SELECT score, round((cp + cn) / (tp + tn), 6) AS blocked_share, r AS ratio, round((r * (tp - cp) + cn) / (tp + tn), 6) AS cost
  FROM c, (SELECT unnest([1, 2, 5]) AS r)""")
def operating_cost_curve(spark, sf):
    return validity.cost_curve(_harm(spark, sf))


@query(_RUNS + """, z AS (SELECT *, (auc - avg(auc) OVER w) / stddev_pop(auc) OVER w AS za, (rows - avg(rows) OVER w) / stddev_pop(rows) OVER w AS zr FROM mr WINDOW w AS (PARTITION BY dataset))
SELECT 'score' AS signal, 'auc' AS outcome, round(corr(score, za), 6) AS r FROM z UNION ALL SELECT 'score', 'rows', round(corr(score, zr), 6) FROM z
UNION ALL SELECT 'severity', 'auc', round(corr(severity, za), 6) FROM z UNION ALL SELECT 'severity', 'rows', round(corr(severity, zr), 6) FROM z""")
def correlation_matrix(spark, sf):
    return validity.correlation_matrix(model_runs(spark, sf), ["score", "severity"], ["auc", "rows"], "dataset")


@query(_RUNS + " SELECT dataset, round(regr_slope(auc, score), 6) AS slope, round(regr_intercept(auc, score), 6) AS intercept, count(*) AS n FROM mr GROUP BY 1")
def score_auc_line(spark, sf):
    return validity.least_squares(model_runs(spark, sf), ["dataset"], "score", "auc")


@query(_RUNS + " SELECT dataset, severity, round(avg(score), 6) AS score, round(avg(auc), 6) AS auc FROM mr GROUP BY 1, 2")
def severity_trajectories(spark, sf):
    return validity.trajectories(model_runs(spark, sf), ["dataset", "severity"], ["score", "auc"])


@query(_RUNS + " SELECT round(avg(rows), 6) AS mean, max(rows)::DOUBLE AS max, round(quantile_cont(rows, 0.95), 6) AS p95 FROM mr")
def runtime_percentiles(spark, sf):
    return validity.runtime_percentiles(model_runs(spark, sf), "rows")


@query(_RUNS + """, b AS (SELECT dataset, score > 77 AS a, auc > 0.64 AS b, score, auc FROM mr), s AS (SELECT dataset, count(*) AS n, avg((a = b)::INT) AS po, avg(a::INT) AS pa, avg(b::INT) AS pb, corr(score, auc) AS r FROM b GROUP BY 1)
SELECT dataset, n, round(po, 6) AS agreement, round(r, 6) AS value_r, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM s""")
def tool_agreement(spark, sf):
    runs = model_runs(spark, sf).withColumns({"a": F.col("score") > 77, "b": F.col("auc") > 0.64})
    return validity.tool_agreement(runs, ["dataset"], "a", "b", "score", "auc")


@query(_RUNS + " SELECT dataset, severity, seed, round(max(auc) FILTER (model = 'F'), 6) AS \"auc_F\", round(max(auc) FILTER (model = 'O'), 6) AS \"auc_O\" FROM mr GROUP BY 1, 2, 3")
def learner_pivot(spark, sf):
    return validity.learner_pivot(model_runs(spark, sf), ["dataset", "severity", "seed"], ["F", "O"])


# Draws from the keys of a run by integer arithmetic, the same in SQL.

def _run_key():
    return (F.ascii("dataset") * 31 + F.ascii("model") * 13 + (F.col("severity") * 100).cast("int") * 17 + F.col("seed") * 101).cast("long")


def _run_draw(number):
    return F.pmod((_run_key() * 7919 + number * 104729) * (number + 13), F.lit(1000003)) / 1000003.0


_DRAWN = _RUNS + """, kr AS (SELECT *, CAST(ascii(dataset) * 31 + ascii(model) * 13 + CAST(severity * 100 AS INTEGER) * 17 + seed * 101 AS BIGINT) AS k FROM mr)"""
_MASSES = [sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 9)]


@query(_DRAWN + ", rp AS (SELECT kr.*, t.r AS replicate, (((k * 7919 + t.r * 104729) * (t.r + 13)) % 1000003) / 1000003.0::DOUBLE AS u FROM kr, range(200) t(r)), w AS (SELECT *, "
       + " + ".join(f"(u >= {m!r}::DOUBLE)::INT" for m in _MASSES) + """ AS w FROM rp),
m AS (SELECT model, replicate, sum(w)::DOUBLE AS n, sum(w * score) AS x, sum(w * auc) AS y, sum(w * score * score) AS xx, sum(w * auc * auc) AS yy, sum(w * score * auc) AS xy FROM w WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT model, (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) AS r FROM m WHERE xx - x * x / n > 1e-12 AND yy - y * y / n > 1e-12)
SELECT model, count(*) AS n_values, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM c GROUP BY 1""")
def bootstrap_interval(spark, sf):
    """Bootstrap interval of the score-AUC correlation per model."""
    return validity.bootstrap_correlation(model_runs(spark, sf), ["model"], "score", "auc", ["dataset", "severity", "seed"], draw=_run_draw(F.col("replicate")))


@query(_DRAWN + """, sp AS (SELECT kr.*, t.p, ((k * 7919) * 13) % 1000003 AS f, CASE WHEN t.p = 0 THEN ((k * 7919) * 13) % 1000003 ELSE ((k * 7919 + t.p * 104729) * (t.p + 13)) % 1000003 END AS m FROM kr, range(201) t(p)),
a AS (SELECT p, score, row_number() OVER (PARTITION BY p ORDER BY f, dataset, model, severity, seed) AS i FROM sp),
b AS (SELECT p, auc, row_number() OVER (PARTITION BY p ORDER BY m, dataset, model, severity, seed) AS i FROM sp),
r AS (SELECT p, corr(score, auc) AS r FROM a JOIN b USING (p, i) GROUP BY 1), o AS (SELECT r AS obs FROM r WHERE p = 0)
SELECT round(max(obs), 6) AS observed_r, round((count(*) FILTER (p > 0 AND abs(r) >= abs(obs) - 1e-12) + 1) / count(*), 6) AS p_value FROM r, o""")
def permutation_p_value(spark, sf):
    return validity.permutation_p(model_runs(spark, sf), "score", "auc", ["dataset", "model", "severity", "seed"], draw=_run_draw)


# Supervision log derived from events: four methods, integer time steps, integer arithmetic outcomes.

def supervision_log(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.element_at(F.array(*[F.lit(m) for m in ("Static", "SAL", "ADWIN-SAL", "Symbiosis-Edge")]), (F.col("user_id") % 4 + 1).cast("int")).alias("method"),
        F.floor(F.col("event_id") / 4).alias("t"), "event_id", (F.col("event_id") % 5).alias("y_true"),
        F.when(k < 70 + F.col("user_id") % 4 * 5, F.col("event_id") % 5).otherwise((F.col("event_id") + 1) % 5).alias("y_pred"),
        ((F.col("user_id") % 4 > 0) & (k % 10 == 0)).alias("q_oracle"), ((F.col("user_id") % 4 == 3) & (k % 10 == 1)).alias("q_human"),
        F.when((F.col("user_id") % 4 > 0) & (k % 10 == 0), (k % 3 > 0)).alias("oracle_correct"),
        F.when((F.col("user_id") % 4 == 3) & (k % 10 == 1), (k % 7 > 0)).alias("human_correct"), F.col("value").alias("uncertainty"))


_LOG = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 4 AS m FROM events),
lg AS (SELECT list_extract(['Static', 'SAL', 'ADWIN-SAL', 'Symbiosis-Edge'], m + 1) AS method, event_id // 4 AS t, event_id % 5 AS y_true, CASE WHEN k < 70 + m * 5 THEN event_id % 5 ELSE (event_id + 1) % 5 END AS y_pred,
  (m > 0 AND k % 10 = 0) AS qo, (m = 3 AND k % 10 = 1) AS qh, k FROM e)"""
_COSTS = {"edge": 0.01, "oracle": 1.0, "human": 5.0}
_SUMMARY = _LOG + """, st AS (SELECT method, t, count(*) AS n, sum((y_pred = y_true)::INT) AS ok, max(qo::INT) AS o, max(qh::INT) AS h, max(greatest(qo::INT, qh::INT)) AS a FROM lg WHERE t >= 400 GROUP BY 1, 2),
ms AS (SELECT method, sum(ok) / sum(n) AS acc, CAST(sum(o) AS BIGINT) AS queries_oracle, CAST(sum(h) AS BIGINT) AS queries_human, CAST(sum(a) AS BIGINT) AS queries_total, count(*) AS n_steps FROM st GROUP BY 1),
mc AS (SELECT *, CASE WHEN method = 'Static' THEN 0.0::DOUBLE WHEN method IN ('SAL', 'ADWIN-SAL') THEN 5.0::DOUBLE * queries_oracle ELSE 0.01::DOUBLE * n_steps + 1.0 * queries_oracle + 5.0 * queries_human END AS total_cost, acc - (SELECT acc FROM ms WHERE method = 'Static') AS lift FROM ms)"""


@query(_SUMMARY + """ SELECT method, round(acc, 6) AS acc, queries_oracle, queries_human, queries_total, n_steps, round(total_cost, 6) AS total_cost, round(lift, 6) AS lift,
  round(CASE WHEN total_cost > 0 THEN lift / total_cost END, 6) AS roi FROM mc""")
def supervision_summary(spark, sf):
    return validity.supervision_summary(supervision_log(spark, sf), 400, _COSTS)


@query(_SUMMARY + """, x AS (SELECT count(*) AS m, max(acc) FILTER (sy) AS acc, max(lift) FILTER (sy) AS lift, max(roi) FILTER (sy) AS roi
  FROM (SELECT method = 'Symbiosis-Edge' AS sy, acc, coalesce(lift, 0) AS lift, CASE WHEN total_cost > 0 THEN lift / total_cost END AS roi FROM mc)),
s AS (SELECT CASE WHEN m = 0 THEN 0 ELSE 1 END * greatest(0, least(100, 50 - 5 * (4 - m) + CASE WHEN acc > 0.8 THEN 15 WHEN acc > 0.7 THEN 8 ELSE 0 END + CASE WHEN lift > 0.1 THEN 15 WHEN lift > 0.05 THEN 8 ELSE 0 END + CASE WHEN roi > 0.001 THEN 10 ELSE 0 END)) AS total FROM x)
SELECT CAST(total AS BIGINT) AS total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def supervision_score(spark, sf):
    return validity.supervision_score(validity.supervision_summary(supervision_log(spark, sf), 400, _COSTS))


@query(_LOG + """ SELECT round(avg((k % 3 > 0)::INT) FILTER (qo), 6) AS oracle_observed_acc, count(*) FILTER (qo) AS oracle_queries,
  round(avg((k % 7 > 0)::INT) FILTER (qh), 6) AS human_observed_acc, count(*) FILTER (qh) AS human_queries FROM lg""")
def annotator_observed_accuracy(spark, sf):
    return validity.annotator_observed(supervision_log(spark, sf))


@query(_LOG + """, a AS (SELECT method, coalesce(avg((y_pred = y_true)::INT) FILTER (t < 400), 0) AS pre, coalesce(avg((y_pred = y_true)::INT) FILTER (t >= 400), 0) AS post FROM lg GROUP BY 1)
SELECT method, round(pre, 6) AS pre_acc, round(post, 6) AS post_acc, round(pre - post, 6) AS drop FROM a""")
def accuracy_around_drift(spark, sf):
    return validity.accuracy_around_drift(supervision_log(spark, sf), 400)


# Fault transforms, each against the clean table.

def _hashed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", fx.split_of(F.col("o_orderkey")).alias("split"),
                                             (F.col("o_orderkey") % 2).cast("int").alias("y"))


def _fault_draw(salt: int):
    return F.pmod(F.col("o_orderkey") * 7919 + 733103 + salt * 15485863, F.lit(1000)) / 1000.0


def _u(salt: int) -> str:
    return f"((o_orderkey * 7919 + 733103 + {salt * 15485863}) % 1000 / 1000.0::DOUBLE)"


_TIMES = " + ".join(f"({_u(102)} >= {m!r}::DOUBLE)::INT" for m in [sum(math.exp(-0.2) * 0.2 ** j / math.factorial(j) for j in range(k)) for k in range(1, 9)])
_AWAY = "o_totalprice + CASE WHEN " + _u(200) + " < 0.5 THEN -1.0 ELSE 1.0 END * 15.0 * {sd}"


@query(f"""WITH h AS (SELECT o_orderkey, o_totalprice, {_TIMES} AS times, CASE WHEN {_u(1)} >= 0.2 THEN o_totalprice END AS holed FROM orders),
s AS (SELECT stddev_pop(o_totalprice) AS sd FROM h)
SELECT 'missingness' AS fault, count(*) AS rows, round(avg((holed IS NULL)::INT), 6) AS effect FROM h
UNION ALL SELECT 'duplicates', count(*) + count(*) FILTER ({_u(101)} < 0.2), (count(*) FILTER ({_u(101)} < 0.2))::DOUBLE FROM h
UNION ALL SELECT 'repeated_duplicates', CAST(count(*) + sum(times) AS BIGINT), sum(times)::DOUBLE FROM h
UNION ALL SELECT 'split_leakage', count(*) + count(*) FILTER ({_u(103)} < 0.2), (count(*) FILTER ({_u(103)} < 0.2))::DOUBLE FROM h
UNION ALL SELECT 'label_noise', count(*), round(avg(({_u(108)} < 0.2)::INT), 6) FROM h
UNION ALL SELECT 'outliers', count(*), round(avg((abs(CASE WHEN {_u(107)} < 0.2 THEN {_AWAY.format(sd='sd')} ELSE o_totalprice END) > 600000)::INT), 6) FROM h, s
UNION ALL SELECT 'combined', CAST(count(*) + sum(times) AS BIGINT), round(sum((1 + times) * (holed IS NULL)::INT) / sum(1 + times), 6) FROM h""")
def hash_drawn_faults(spark, sf):
    """Each transform at severity 0.2 with draws from the keys: observed effect per fault."""
    base, draw = _hashed(spark, sf), _fault_draw
    one = F.lit(1)

    def effect(name, frame, expr):
        return frame.agg(F.lit(name).alias("fault"), F.count(one).alias("rows"), expr.cast("double").alias("effect"))

    out = effect("missingness", faults.missingness(base, ["o_totalprice"], 0.2, draw), F.avg(F.col("o_totalprice").isNull().cast("int")))
    parts = [
        effect("duplicates", faults.duplicates(base, 0.2, draw), F.count(one) - F.count_distinct("o_orderkey")),
        effect("repeated_duplicates", faults.repeated_duplicates(base, 0.2, draw), F.count(one) - F.count_distinct("o_orderkey")),
        effect("split_leakage", faults.split_leakage(base, "split", 0.2, draw), F.count(one) - F.count_distinct("o_orderkey")),
        effect("label_noise", faults.label_noise(base, "y", 0.2, draw), F.avg((F.col("y") != F.col("o_orderkey") % 2).cast("int"))),
        effect("outliers", faults.outliers(base, ["o_totalprice"], 0.2, draw), F.avg((F.abs("o_totalprice") > 600000).cast("int"))),
        effect("combined", faults.combined(base, ["o_totalprice"], 0.2, draw), F.avg(F.col("o_totalprice").isNull().cast("int")))]
    for part in parts:
        out = out.unionByName(part)
    return out


@query("""WITH c AS (SELECT p_type AS c, count(*) AS n FROM part GROUP BY 1), m AS (SELECT c FROM c ORDER BY n DESC, c LIMIT 1)
SELECT CAST((p_type = (SELECT c FROM m))::INT AS INTEGER) AS target, count(*) AS n,
  round(sum(CASE WHEN (SELECT var_samp(p_retailprice) >= var_samp(p_size) FROM part) THEN p_retailprice ELSE p_size END), 2) AS total FROM part GROUP BY 1""", digits=2)
def prepared_dataset(spark, sf):
    """The most variable feature, whichever it is, summed by target."""
    out = faults.prepare(table(spark, sf, "part"), "p_type", "p_partkey", max_features=1)
    key, feature, target = out.columns
    return out.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.sum(feature).alias("total"))
