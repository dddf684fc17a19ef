"""Statistics over run tables: how well do the checks and the score work?"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col, uniform
from plumbline.operators.distribution import average_ranks, quantiles, roc_auc_from_counts, running_totals, value_counts, with_totals
from plumbline.operators.scoring import DEFAULT_WEIGHTS
from plumbline.operators.series import positions, z_scores

# Per fault the metric that should respond, its detection level, and recommendation keywords.
FAULT_RULES = (
    ("missingness", "missingness", 0.05, "missingness|impute|recollect"),
    ("duplicates", "duplicate_rate", 0.01, "duplicate|deduplicate"),
    ("split_leakage", "split_leakage", 0.0, "leakage|re-split"),
    ("drift", "max_drift_ks", 0.30, "drift|retraining|recalibration"),
    ("pii", "pii_flag_count", 0.0, "pii|mask|legal"),
    ("fairness", "max_positive_rate_disparity", 0.20, "fairness|disparity|group"),
)
ALIGNED = {"missingness": "quality", "duplicates": "quality", "split_leakage": "quality", "drift": "reliability",
           "pii": "security", "fairness": "fairness"}


def primary_metric(runs: DataFrame) -> DataFrame:
    """Adds the fault's own metric, whether it detects the fault, and whether a recommendation names it."""
    rules = F.broadcast(runs.sparkSession.createDataFrame(
        list(FAULT_RULES), "fault string, primary_metric string, level double, keywords string"))
    value = F.coalesce(*[F.when(F.col("primary_metric") == m, F.coalesce(col(m), F.lit(0.0))) for _, m, _, _ in FAULT_RULES])
    text = F.lower(F.array_join("recommendations", " "))
    joined = runs.join(rules, "fault").withColumn("primary_value", value)
    return joined.withColumns({
        "detected": F.col("primary_value") > F.col("level"),
        "recommendation_hit": F.rlike(text, F.col("keywords"))}).drop("level", "keywords")


def aggregate_grid(grid: DataFrame) -> DataFrame:
    """Means, deviations and rates per fault and severity; missing statistics read 0."""
    return grid.groupBy("fault", "severity", "primary_metric").agg(
        F.avg("score").alias("score_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"),
        F.avg("primary_value").alias("value_mean"), F.coalesce(F.stddev_samp("primary_value"), F.lit(0.0)).alias("value_std"),
        F.avg(F.col("detected").cast("double")).alias("detected_rate"),
        F.avg(F.col("recommendation_hit").cast("double")).alias("recommendation_rate"),
        F.avg((F.col("status") == "FAIL").cast("double")).alias("policy_fail_rate"))


def severity_matrix(grid: DataFrame, value: Column, severities: Sequence[float]) -> DataFrame:
    """Fault by severity table of a mean."""
    return grid.groupBy("fault").agg(*[
        F.avg(F.when(F.abs(F.col("severity") - s) < 1e-9, value)).alias(f"s{int(round(s * 100)):02d}") for s in severities])


def minimum_detectable(grid: DataFrame, level: float = 0.999) -> DataFrame:
    """Smallest positive severity at which (practically) every run is detected."""
    rates = grid.groupBy("fault", "severity").agg(F.avg(F.col("detected").cast("double")).alias("rate"))
    return rates.groupBy("fault").agg(
        F.min(F.when((F.col("rate") >= level) & (F.col("severity") > 0), F.col("severity"))).alias("min_severity"))


def roc_of(df: DataFrame, keys: Sequence[str], score: Column, positive: Column) -> DataFrame:
    """ROC area and average precision of a score per key."""
    counts = df.groupBy(*keys, score.alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"), F.sum((~positive).cast("bigint")).alias("neg"))
    return roc_auc_from_counts(counts, keys, few_keys=False)


def roc_points(df: DataFrame, keys: Sequence[str], score: Column, positive: Column) -> DataFrame:
    """False and true positive rate at every threshold, highest score first."""
    counts = df.groupBy(*keys, score.alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"), F.sum((~positive).cast("bigint")).alias("neg"))
    ranked = running_totals(counts, keys, "score", ("pos", "neg"), few_keys=False)
    return ranked.select(
        *keys, F.col("score").alias("threshold"),
        ((F.col("all_neg") - F.col("cum_neg") + F.col("neg")) / F.nullif("all_neg", F.lit(0))).alias("fpr"),
        ((F.col("all_pos") - F.col("cum_pos") + F.col("pos")) / F.nullif("all_pos", F.lit(0))).alias("tpr"))


def gate_calibration(gated: DataFrame) -> DataFrame:
    """Share of blocked clean runs and of blocked faulty runs per policy."""
    blocked = (F.col("status") == "FAIL").cast("double")
    return gated.groupBy("policy").agg(
        F.avg(F.when(F.col("severity") == 0, blocked)).alias("false_block"),
        F.avg(F.when(F.col("severity") > 0, blocked)).alias("true_block"))


def tool_agreement(df: DataFrame, keys: Sequence[str], flag_a: str, flag_b: str, value_a: str, value_b: str) -> DataFrame:
    """Decision agreement, value correlation and binary kappa of two tools."""
    a, b = col(flag_a).cast("double"), col(flag_b).cast("double")
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("double")).alias("agreement"), F.avg(a).alias("_a"), F.avg(b).alias("_b"),
        pearson(value_a, value_b).alias("value_r"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    kappa = F.when(chance < 1, (F.col("agreement") - chance) / F.nullif(1 - chance, F.lit(0.0))).otherwise(1.0)
    return stats.select(*keys, "n", "agreement", "value_r", kappa.alias("kappa"))


def pearson(x: str, y: str) -> Column:
    """Aggregate Pearson r, null when a side is constant (``F.corr`` divides by zero there, which is an error in ANSI mode)."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.when(spread != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0)))))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r with its t statistic per key; null below three pairs."""
    both = df.filter(col(x).isNotNull() & col(y).isNotNull())
    found = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("_r"))
    r = F.when((F.col("n") >= 3) & ~F.isnan("_r"), F.col("_r"))
    return found.select(*keys, "n", r.alias("pearson_r"),
                        F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))).alias("t_statistic"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key, ties averaged."""
    keys = list(keys)
    both = df.filter(col(x).isNotNull() & col(y).isNotNull()).select(*keys, x, y)
    if not keys:
        both, keys = both.withColumn("_one", F.lit(1)), ["_one"]
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("spearman_rho")).drop("_one")


def pooled_correlation(df: DataFrame, group: str, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of values standardised within each group."""
    scope = [group, *keys]
    z = z_scores(z_scores(df.filter(col(x).isNotNull() & col(y).isNotNull()), scope, x, "_zx"), scope, y, "_zy")
    return correlation(z, keys, "_zx", "_zy")


def fisher_mean(df: DataFrame, keys: Sequence[str], r: str) -> DataFrame:
    """Mean correlation through Fisher's z, clipped to +-0.999."""
    clipped = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), col(r)))
    return df.filter(col(r).isNotNull()).groupBy(*keys).agg(F.tanh(F.avg(F.atanh(clipped))).alias("fisher_mean"))


def _replicates(df: DataFrame, unit: Sequence[str], replicates: int, seed: int, draw: Column | None) -> DataFrame:
    """Poisson(1) resampling weights per unit and replicate, from hashes or a given draw."""
    u = uniform(seed, F.col("replicate"), *[col(c) for c in unit]) if draw is None else draw
    weight, mass, term = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        weight = weight + (u >= mass).cast("int")
        term /= k
        mass += term
    spread = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return spread.withColumn("weight", weight).filter("weight > 0")


def bootstrap_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, unit: Sequence[str],
                          replicates: int = 200, seed: int = 7, draw: Column | None = None) -> DataFrame:
    """Percentile interval of a correlation; ``unit`` names what is resampled (row id, cluster, seed).

    ``draw``, a number in [0, 1) from ``replicate`` and the unit, replaces the hash. Meant for run tables: rows are multiplied by the replicates.

    Weighted sums make each replicate one aggregate: rows never travel more than once per replicate.
    """
    sums = {"n": F.col("weight"), "x": F.col("weight") * col(x), "y": F.col("weight") * col(y),
            "xx": F.col("weight") * col(x) * col(x), "yy": F.col("weight") * col(y) * col(y), "xy": F.col("weight") * col(x) * col(y)}
    moments = _replicates(df, unit, replicates, seed, draw).groupBy(*keys, "replicate").agg(
        *[F.sum(e.cast("double")).alias(f"_{k}") for k, e in sums.items()])
    vx, vy = F.col("_xx") - F.col("_x") ** 2 / F.col("_n"), F.col("_yy") - F.col("_y") ** 2 / F.col("_n")
    r = F.when((vx > 1e-12) & (vy > 1e-12), (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")) / F.sqrt(vx * vy))
    values = moments.select(*keys, r.alias("value")).filter(F.col("value").isNotNull())
    if not keys:
        values, keys = values.withColumn("all_rows", F.lit(1)), ["all_rows"]
    return quantiles(value_counts(values, list(keys)), list(keys), {"ci_low": 0.025, "ci_high": 0.975})


def permutation_p(df: DataFrame, x: str, y: str, key: Sequence[str], permutations: int = 200, seed: int = 7,
                  draw: Callable[[Column], Column] | None = None) -> DataFrame:
    """Two-sided permutation p-value of a correlation over a run table.

    In each permutation the k-th x in one hash order meets the y that is k-th in another; permutation
    0 uses the same order twice and gives the observed value. ``draw`` of a permutation's number replaces the hashes. Rows are multiplied
    by the permutations.
    """
    names = list(key)
    rows = df.filter(col(x).isNotNull() & col(y).isNotNull()).select(*names, x, y)
    spread = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    keys = [col(k) for k in names]
    fixed = uniform(seed, *keys) if draw is None else draw(F.lit(0))
    other = uniform(seed + 1, F.col("permutation"), *keys) if draw is None else draw(F.col("permutation"))
    mixed = F.when(F.col("permutation") == 0, fixed).otherwise(other)

    def placed(order: Column, value: str) -> DataFrame:
        tagged = spread.withColumn("_u", order)
        return positions(tagged, ["permutation"], ["_u", *names], F.floor(F.col("_u") * 64)).select("permutation", "_pos", value)

    rs = placed(fixed, x).join(placed(mixed, y), ["permutation", "_pos"]).groupBy("permutation").agg(pearson(x, y).alias("r"))
    framed = with_totals(rs, _obs=F.max(F.when(F.col("permutation") == 0, F.col("r"))))
    extreme = (F.col("permutation") > 0) & (F.abs("r") >= F.abs("_obs") - 1e-12)
    return framed.agg(F.max("_obs").alias("observed_r"),
                      ((F.sum(extreme.cast("bigint")) + 1) / F.count(F.lit(1))).alias("p_value"))


def sensitivity_law(runs: DataFrame, high: float = 0.4) -> DataFrame:
    """Per model: mean AUC drop from clean to severe over data sets, and the pooled score-AUC correlation."""
    drops = runs.groupBy("model", "dataset").agg(
        (F.avg(F.when(F.col("severity") == 0, F.col("auc"))) - F.avg(F.when(F.col("severity") >= high, F.col("auc")))).alias("_d"))
    drop = drops.groupBy("model").agg(F.avg("_d").alias("sensitivity"))
    pooled = pooled_correlation(runs, "dataset", ["model"], "score", "auc").select("model", F.col("pearson_r").alias("r"))
    return drop.join(F.broadcast(pooled), "model")


def harm_flags(runs: DataFrame, drop: float = 0.05) -> DataFrame:
    """Adds ``harm``: the AUC fell by at least ``drop`` below the clean mean of the data set."""
    clean = runs.groupBy("dataset").agg(F.avg(F.when(F.col("severity") == 0, F.col("auc"))).alias("clean_auc"))
    return runs.join(clean, "dataset").withColumn("harm", F.col("clean_auc") - F.col("auc") >= drop)


def gate_as_detector(flagged: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate of gate failures for harmful runs."""
    fail, harm = F.col("fail"), F.col("harm")

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("bigint"))

    row = flagged.agg(n(fail & harm).alias("tp"), n(fail & ~harm).alias("fp"), n(~fail & harm).alias("fn"), n(~fail & ~harm).alias("tn"))
    return row.select("tp", "fp", "fn", "tn", (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9)).alias("precision"),
                      (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9)).alias("recall"),
                      (F.col("fp") / (F.col("fp") + F.col("tn") + 1e-9)).alias("fpr"))


def cost_curve(flagged: DataFrame, score: str = "score", ratios: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """Expected cost per run when the lowest scores are blocked first, for each miss/block cost ratio.

    One point per distinct score (runs with equal scores are blocked together).
    """
    counts = flagged.groupBy(F.lit(1).alias("_k"), col(score).alias("score")).agg(
        F.sum(F.col("harm").cast("bigint")).alias("pos"), F.sum((~F.col("harm")).cast("bigint")).alias("neg"))
    ranked = running_totals(counts, ["_k"], "score", ("pos", "neg"))
    total = F.col("all_pos") + F.col("all_neg")
    points = ranked.select(
        "score", ((F.col("cum_pos") + F.col("cum_neg")) / total).alias("blocked_share"),
        (F.col("all_pos") - F.col("cum_pos")).alias("_miss"), F.col("cum_neg").alias("_false"), total.alias("_n"))
    return points.select("score", "blocked_share", F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio"), "_miss", "_false", "_n").select(
        "score", "blocked_share", "ratio", ((F.col("ratio") * F.col("_miss") + F.col("_false")) / F.col("_n")).alias("cost"))


def attribution(grid: DataFrame, severity: float = 0.40) -> DataFrame:
    """Mean points lost per dimension and fault at one severity."""
    lost = [F.avg(F.lit(w) - F.col(f"{d}_points")).alias(f"lost_{d}") for d, w in DEFAULT_WEIGHTS.items()]
    return grid.filter(F.abs(F.col("severity") - severity) < 1e-9).groupBy("fault").agg(*lost)


def leave_one_out(grid: DataFrame, severity: float = 0.40) -> DataFrame:
    """Share of a fault's score drop that remains when one dimension is removed and weights renormalised."""
    high = F.abs(F.col("severity") - severity) < 1e-9
    row = grid.groupBy("fault").agg(*[
        (F.avg(F.when(F.col("severity") == 0, F.col(f"{d}_points"))) - F.avg(F.when(high, F.col(f"{d}_points")))).alias(f"_{d}")
        for d in DEFAULT_WEIGHTS])
    full = sum((F.col(f"_{d}") for d in DEFAULT_WEIGHTS), F.lit(0.0))
    whole = sum(DEFAULT_WEIGHTS.values())
    kept = {d: (full - F.col(f"_{d}")) / ((whole - w) / whole) for d, w in DEFAULT_WEIGHTS.items()}
    return row.select("fault", full.alias("full_drop"), *[
        F.when(F.abs(full) > 1e-12, k / full).otherwise(0.0).alias(f"retain_wo_{d}") for d, k in kept.items()])


def correlation_matrix(runs: DataFrame, signals: Sequence[str], outcomes: Sequence[str], group: str) -> DataFrame:
    """Correlation of every signal with every outcome (outcome standardised within groups)."""
    z = runs
    for y in outcomes:
        z = z_scores(z, [group], y, f"_z_{y}")
    row = z.agg(*[pearson(x, f"_z_{y}").alias(f"r{i}_{j}") for i, x in enumerate(signals) for j, y in enumerate(outcomes)])
    cells = F.array(*[F.struct(F.lit(x).alias("signal"), F.lit(y).alias("outcome"), F.col(f"r{i}_{j}").alias("r"))
                      for i, x in enumerate(signals) for j, y in enumerate(outcomes)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def least_squares(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def trajectories(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def normalised_response(grid: DataFrame) -> DataFrame:
    """Min-max normalised primary metric per fault: mean of clean and of faulty runs."""
    framed = with_totals(grid, ["fault"], _lo=F.min("primary_value"), _hi=F.max("primary_value"))
    width = F.col("_hi") - F.col("_lo")
    norm = (F.col("primary_value") - F.col("_lo")) / F.when(width != 0, width).otherwise(1.0)
    return framed.groupBy("fault").agg(F.avg(F.when(F.col("severity") == 0, norm)).alias("clean_mean"),
                                       F.avg(F.when(F.col("severity") > 0, norm)).alias("faulty_mean"))


def runtime_percentiles(df: DataFrame, value: str) -> DataFrame:
    keyed = df.select(F.lit(1).alias("key"), col(value).cast("double").alias("value"))
    found = quantiles(value_counts(keyed, ["key"]), ["key"], {"p95": 0.95}).select("key", "p95")
    sums = keyed.groupBy("key").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return sums.join(F.broadcast(found), "key").drop("key")


def learner_pivot(runs: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Learner results side by side for each (data set, severity, seed)."""
    return runs.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(f"auc_{m}") for m in models])


def remaining_cells(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells that have no result yet (resume)."""
    return plan.join(done.select(*keys), list(keys), "left_anti")


# Supervision logs: (t, method, y_true, y_pred, q_oracle, q_human, oracle_correct, human_correct, uncertainty).

def supervision_summary(log: DataFrame, drift_t: int | None, costs: Mapping[str, float]) -> DataFrame:
    """Accuracy, queries, cost, lift over the static method and return per method after the drift point."""
    post = log if drift_t is None else log.filter(F.col("t") >= drift_t)
    qo, qh = F.coalesce("q_oracle", F.lit(False)).cast("int"), F.coalesce("q_human", F.lit(False)).cast("int")
    steps = post.groupBy("method", "t").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("y_pred") == F.col("y_true")).cast("bigint")).alias("_ok"),
        F.max(qo).alias("_o"), F.max(qh).alias("_h"), F.max(F.greatest(qo, qh)).alias("_a"))
    sums = steps.groupBy("method").agg(
        (F.sum("_ok") / F.sum("_n")).alias("acc"), F.sum("_o").alias("queries_oracle"), F.sum("_h").alias("queries_human"),
        F.sum("_a").alias("queries_total"), F.count(F.lit(1)).alias("n_steps"))
    o, h, n = F.col("queries_oracle"), F.col("queries_human"), F.col("n_steps")
    cost = (F.when(F.col("method") == "Static", 0.0).when(F.col("method").isin("SAL", "ADWIN-SAL"), costs["human"] * o)
            .otherwise(costs["edge"] * n + costs["oracle"] * o + costs["human"] * h))
    static = with_totals(sums, _static=F.max(F.when(F.col("method") == "Static", F.col("acc"))))
    lift = F.coalesce(F.col("acc") - F.col("_static"), F.lit(0.0))
    out = static.withColumns({"total_cost": cost.cast("double"), "lift": lift})
    return out.withColumn("roi", F.when(F.col("_static").isNotNull() & (F.col("total_cost") > 0), F.col("lift") / F.col("total_cost"))).drop("_static")


def supervision_score(summary: DataFrame) -> DataFrame:
    """Heuristic 0-100 score of a supervision run; 0 for an empty log."""
    sym = F.col("method") == "Symbiosis-Edge"
    row = summary.agg(*[F.max(F.when(sym, F.col(c))).alias(c) for c in ("acc", "lift", "roi")],
                      F.collect_set("method").alias("_m"))
    missing = sum(((~F.array_contains("_m", m)).cast("int") for m in ("Static", "SAL", "ADWIN-SAL", "Symbiosis-Edge")), F.lit(0))
    score = (50 + F.when(F.col("acc") > 0.80, 15).when(F.col("acc") > 0.70, 8).otherwise(0)
             + F.when(F.col("lift") > 0.10, 15).when(F.col("lift") > 0.05, 8).otherwise(0)
             + F.when(F.col("roi") > 0.001, 10).otherwise(0) - 5 * missing)
    bounded = F.when(F.size("_m") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("bigint")
    from plumbline.operators.scoring import grade
    return row.select(bounded.alias("total"), grade(bounded).alias("grade"))


def annotator_observed(log: DataFrame) -> DataFrame:
    """Observed accuracy and number of queries of the oracle and the human."""
    o, h = F.coalesce("q_oracle", F.lit(False)), F.coalesce("q_human", F.lit(False))
    return log.agg(
        F.avg(F.when(o, F.col("oracle_correct").cast("double"))).alias("oracle_observed_acc"), F.sum(o.cast("bigint")).alias("oracle_queries"),
        F.avg(F.when(h, F.col("human_correct").cast("double"))).alias("human_observed_acc"), F.sum(h.cast("bigint")).alias("human_queries"))


def accuracy_around_drift(log: DataFrame, drift_t: int) -> DataFrame:
    """Accuracy before and after the drift point, and the drop, per method."""
    ok = (F.col("y_pred") == F.col("y_true")).cast("double")
    early = F.col("t") < drift_t
    row = log.groupBy("method").agg(F.coalesce(F.avg(F.when(early, ok)), F.lit(0.0)).alias("pre_acc"),
                                    F.coalesce(F.avg(F.when(~early, ok)), F.lit(0.0)).alias("post_acc"))
    return row.withColumn("drop", F.col("pre_acc") - F.col("post_acc"))
