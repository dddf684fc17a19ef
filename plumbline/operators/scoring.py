"""Health scores, dimension status, verdicts and recommendations over metric tables.

A metric table has rows (run_id, metric, value). ``wide`` turns it into one row per run; every score
is then a column expression, so any number of runs is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.roles import AssetThresholds, SeriesThresholds, TabularThresholds

# Metric names of a run, score weights, grade limits, base points of asset scores.
METRICS = (
    "missingness", "duplicate_rate", "split_leakage", "label_noise", "estimated_label_noise", "pii_flag_count",
    "pii_worst_rate", "max_drift_ks", "p99_anomaly", "max_positive_rate_disparity", "mean_disparity_credit",
    "label_auc", "parse_ok_rate", "duplicate_timestamps", "irregularity", "corrupt_rate")
DEFAULT_WEIGHTS = {"quality": 35.0, "security": 25.0, "reliability": 20.0, "robustness": 10.0, "fairness": 10.0}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
ASSET_POINTS = {"quality": 35.0, "reliability": 20.0, "robustness": 15.0, "fairness": 15.0, "transparency": 8.0,
                "security": 7.0}


def wide(metrics: DataFrame, keys: Sequence[str] = ("run_id",), names: Sequence[str] = METRICS) -> DataFrame:
    """One row per run with a column per metric name."""
    return metrics.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])


def credit(value: Column, warn: Column | float, severe: Column | float) -> Column:
    """1 up to the warning level, then linear down to 0 at the severe level; 1 when not measured."""
    warn, severe = (v if isinstance(v, Column) else F.lit(float(v)) for v in (warn, severe))
    sloped = F.when(severe <= warn, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (value - warn) / F.nullif(severe - warn, F.lit(0.0))))
    return F.when(value.isNull() | (value <= warn), 1.0).otherwise(sloped)


def mean_present(*parts: Column) -> Column:
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return total / sum((p.isNotNull().cast("int") for p in parts), F.lit(0))


def grade(total: Column) -> Column:
    letter = F.when(total >= GRADES[0][0], GRADES[0][1])
    for limit, name in GRADES[1:]:
        letter = letter.when(total >= limit, name)
    return letter.otherwise("F")


def normalised_weights(weights: Mapping[str, float] | None = None,
                       defaults: Mapping[str, float] = DEFAULT_WEIGHTS) -> dict[str, float]:
    """Weights in percent: overrides merged, negative or unreadable ones 0, all-zero back to defaults."""
    merged = dict(defaults)
    for name, value in (weights or {}).items():
        if name in merged:
            try:
                merged[name] = max(0.0, float(value))
            except (TypeError, ValueError):
                merged[name] = 0.0
    if sum(merged.values()) <= 0:
        merged = dict(defaults)
    whole = sum(merged.values())
    return {name: value / whole * 100.0 for name, value in merged.items()}


def health_score(runs: DataFrame, drift_threshold: float = 0.30, label_noise_warn: float = 0.05,
                 weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds the component points, ``score`` (half-even rounding) and ``grade`` to wide runs."""
    share = normalised_weights(weights)
    leak, noise = F.col("split_leakage"), F.col("estimated_label_noise")
    quality = mean_present(
        credit(F.coalesce("missingness", F.lit(0.0)), 0.05, 0.20),
        credit(F.coalesce("duplicate_rate", F.lit(0.0)), 0.01, 0.10),
        F.when(leak.isNotNull(), F.when(leak > 0, 0.0).otherwise(1.0)),
        F.when(noise.isNotNull(), credit(noise, 0.20, 0.50))
        .when(F.col("label_noise").isNotNull(),
              credit(F.col("label_noise"), label_noise_warn, max(0.20, 4 * label_noise_warn))))
    warn = max(drift_threshold, 0.01)
    parts = {
        "quality": quality,
        "security": F.greatest(F.lit(0.0), 1.0 - F.coalesce("pii_worst_rate", F.lit(0.0)) / 0.05),
        "reliability": credit(F.col("max_drift_ks"), warn, min(1.0, 2 * warn)),
        "robustness": credit(F.col("p99_anomaly"), 10.0, 20.0),
        "fairness": F.coalesce(F.col("mean_disparity_credit"), F.lit(1.0)),
    }
    scored = runs.withColumns({f"{d}_points": parts[d] * share[d] for d in parts})
    total = sum((F.col(f"{d}_points") for d in parts), F.lit(0.0))
    scored = scored.withColumn("score", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(total, 9))), 0).cast("bigint"))
    return scored.withColumn("grade", grade(F.col("score")))


def dimension_status(runs: DataFrame, drift_threshold: float = 0.30) -> DataFrame:
    """ok / warn / bad per dimension of each wide run."""
    miss, dup = F.coalesce("missingness", F.lit(0.0)), F.coalesce("duplicate_rate", F.lit(0.0))
    leak = F.coalesce("split_leakage", F.lit(0.0))
    status = {
        "Quality": F.when((leak > 0) | (dup > 0.05) | (miss > 0.15), "bad")
        .when((miss > 0.05) | (dup > 0.01), "warn").otherwise("ok"),
        "Reliability": F.when(F.col("max_drift_ks") > drift_threshold, "warn").otherwise("ok"),
        "Robustness": F.when(F.col("label_auc").isNotNull(), F.when(F.col("label_auc") > 0.85, "warn").otherwise("ok"))
        .when(F.col("p99_anomaly") > 10, "warn").otherwise("ok"),
        "Fairness": F.when(F.col("max_positive_rate_disparity") > 0.2, "warn").otherwise("ok"),
        "Security": F.when(F.col("pii_flag_count") > 0, "bad").otherwise("ok"),
    }
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("status")) for d, c in status.items()])
    return runs.select("run_id", F.explode(rows).alias("s")).select("run_id", "s.dimension", "s.status")


# Review rules as (metric, comparison, threshold name or level, finding, recommendation).
TABULAR_RULES = (
    ("missingness", ">", 0.05, "Missingness exceeds 5%; inspect completeness before training.",
     "Missingness > 5%; inspect top missing columns and decide: drop, impute, or recollect."),
    ("duplicate_rate", ">", 0.01, "Duplicate rows exceed 1%; deduplicate before using this dataset.",
     "Duplicate rows > 1%; deduplicate and verify duplicates do not cross splits."),
    ("pii_flag_count", ">", 0.0, "PII-like patterns detected; review confidentiality and legal basis.",
     "PII-like patterns found; mask or remove flagged columns and confirm legal basis."),
    ("split_leakage", ">", 0.0, "Potential split leakage; identical rows appear across splits.",
     "Split leakage detected; re-split at entity level using ID columns."),
    ("max_drift_ks", ">", "drift_ks", "Potential drift; at least one KS statistic exceeds the threshold.",
     "Drift above threshold; compare distributions and consider retraining or recalibration."),
    ("max_positive_rate_disparity", ">", 0.20, "Group positive-rate disparity exceeds 0.20; audit fairness risk.",
     "Fairness disparity detected; audit group coverage, labels, and collection process."),
    ("label_noise", ">", "label_noise_warn",
     "Suspected label-noise rate exceeds the configured threshold; review ranked samples.",
     "Suspected label noise is above threshold; review the ranked candidates and correct or relabel confirmed issues."),
)
SERIES_RULES = (
    ("missingness", ">", 0.05, None,
     "Missingness > 5% — inspect top missing columns and decide: drop, impute, or recollect."),
    ("duplicate_rate", ">", 0.01, None, "Duplicate rows > 1% — deduplicate and verify duplicates don't cross splits."),
    ("parse_ok_rate", "<", "time_parse_ok_min", "Time parsing success rate is below threshold.",
     "Time parsing is weak — standardize timestamp format and timezone, then rerun."),
    ("duplicate_timestamps", ">", "dup_timestamp_max", "Duplicate timestamps exceed the configured maximum.",
     "Duplicate timestamps detected — confirm aggregation level and deduplicate per entity+timestamp."),
    ("irregularity", ">", "irregularity_max", "Sampling cadence is irregular.",
     "Cadence irregular — consider resampling, interpolation, and explicit missing indicators."),
    ("max_drift_ks", ">", "drift_ks", "Potential drift — at least one KS statistic exceeds the threshold.",
     "Drift above threshold — compare first vs last slice and consider retraining or recalibration."),
    ("pii_flag_count", ">", 0.0, "PII-like patterns detected — review confidentiality and legal basis.",
     "PII-like patterns found — mask or remove flagged columns."),
    ("split_leakage", ">", 0.0, "Potential split leakage.", None),
    ("label_noise", ">", "label_noise_warn", "Suspected label-noise rate exceeds the configured threshold.",
     "Review the ranked label-noise candidates and correct or relabel confirmed issues."),
)
ASSET_RULES = (
    ("corrupt_rate", ">", 0.001, "Corrupt images present.", "Corrupt images found. Remove or fix them and rescan."),
    ("low_resolution_rate", ">", 0.05, None,
     "Many low-resolution images. Consider filtering or resizing policy."),
    ("duplicate_rate", ">", "exact_dup_warn", "Exact duplicates exceed threshold.",
     "Exact duplicate rate exceeds the threshold. Deduplicate."),
    ("split_leakage", ">", "leakage_warn", "Cross-split leakage detected.",
     "Cross-split leakage detected. Remove leaked items from test/val splits."),
    ("conflict_rate", ">", 0.0, None, "Conflicting labels on duplicate images. Audit and resolve."),
    ("label_noise", ">", "label_error_warn", "Suspected label-noise rate exceeds threshold.",
     "Suspected label noise exceeds the threshold. Review ranked images and relabel confirmed issues."),
    ("normalized_entropy", "<", 0.5, None,
     "Significant class imbalance. Consider resampling or weighting strategies."),
    ("max_drift_ks", ">", "drift_ks", "Potential feature drift detected.",
     "Feature drift above threshold. Check pipeline changes or retrain."),
    ("mean_kappa", "<", "kappa_warn", "Low annotator agreement.",
     "Inter-annotator agreement below threshold. Improve annotation guidelines."),
    ("gps_images", ">", 0.0, "EXIF GPS present.", "EXIF GPS present. Strip EXIF before release."),
    ("pii_flag_count", ">", 0.0, "PII-like patterns detected.",
     "PII-like patterns in filenames/paths. Mask or rename assets."),
    ("datasheet_completeness", "<", 0.6, None,
     "Dataset documentation is incomplete. Fill in datasheet sections."),
)
CLEAN_FINDING = "No major red flags under current checks."
CLEAN_RECOMMENDATION = "No major red flags. Keep the report as evidence and rerun after data updates."


def review(metrics: DataFrame, rules: Sequence[tuple] = TABULAR_RULES,
           thresholds: TabularThresholds | SeriesThresholds | AssetThresholds = TabularThresholds()) -> DataFrame:
    """Verdict, findings and recommendations per run: metrics joined with the (fixed) rule table."""
    rows = [(i, m, op, float(getattr(thresholds, t) if isinstance(t, str) else t), f, r)
            for i, (m, op, t, f, r) in enumerate(rules)]
    table = metrics.sparkSession.createDataFrame(
        rows, "position int, metric string, op string, threshold double, finding string, recommendation string")
    hit = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    joined = metrics.join(F.broadcast(table), "metric", "left")
    fired = F.coalesce(hit, F.lit(False))

    def listed(text: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(fired & F.col(text).isNotNull(), F.struct("position", text))))
        return F.transform(pairs, lambda p: p[text])

    grouped = joined.groupBy("run_id").agg(listed("finding").alias("f"), listed("recommendation").alias("r"))
    some = F.size("f") > 0
    return grouped.select(
        "run_id", F.when(some, "Needs review").otherwise("Looks OK (evidence-based)").alias("verdict"),
        F.when(some, F.col("f")).otherwise(F.array(F.lit(CLEAN_FINDING))).alias("findings"),
        F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit(CLEAN_RECOMMENDATION))).alias("recommendations"))


ASSET_METRICS = (
    "readability_rate", "duplicate_rate", "split_leakage", "label_noise", "schema_consistency_rate",
    "metadata_completeness", "normalized_entropy", "mean_kappa", "max_drift_ks", "provenance_coverage",
    "outlier_rate", "low_condition_bins", "disparate_groups", "jsd_penalty", "parity_penalty",
    "datasheet_completeness", "traceability_coverage", "gps_images", "pii_flag_count", "suspicious_rate",
    "concentrated_sources")


def asset_score(runs: DataFrame, t: AssetThresholds = AssetThresholds(),
                weights: Mapping[str, float] | None = None) -> DataFrame:
    """Points per dimension of an asset audit (capped penalties), total and grade.

    ``low_condition_bins``, ``disparate_groups`` and ``concentrated_sources`` are counts of columns
    beyond their threshold; ``jsd_penalty`` and ``parity_penalty`` are sums of capped penalties.
    """
    def over(name: str, limit: float, penalty: Column) -> Column:
        return F.when(F.col(name) > limit, penalty).otherwise(0.0)

    def under(name: str, limit: float, penalty: Column) -> Column:
        return F.when(F.col(name) < limit, penalty).otherwise(0.0)

    def capped(cap: float, amount: Column) -> Column:
        return F.least(F.lit(cap), amount)

    c = F.col
    lost = {
        "quality": under("readability_rate", 0.999, capped(10.0, (1 - c("readability_rate")) * 100))
        + over("duplicate_rate", t.exact_dup_warn, capped(5.0, c("duplicate_rate") * 50))
        + over("split_leakage", t.leakage_warn, capped(5.0, c("split_leakage") * 100))
        + over("label_noise", t.label_error_warn, capped(5.0, c("label_noise") * 25))
        + under("schema_consistency_rate", t.schema_consistency_warn, capped(3.0, (1 - c("schema_consistency_rate")) * 30))
        + under("metadata_completeness", t.metadata_completeness_warn, capped(3.0, (1 - c("metadata_completeness")) * 30))
        + under("normalized_entropy", 0.5, capped(3.0, (1 - c("normalized_entropy")) * 5)),
        "reliability": under("mean_kappa", t.kappa_warn, capped(8.0, (t.kappa_warn - c("mean_kappa")) * 20))
        + over("max_drift_ks", t.drift_ks, F.lit(5.0))
        + under("provenance_coverage", 0.9, capped(3.0, (1 - c("provenance_coverage")) * 10)),
        "robustness": over("outlier_rate", t.outlier_warn, capped(5.0, c("outlier_rate") * 30))
        + 2.0 * F.coalesce("low_condition_bins", F.lit(0.0)),
        "fairness": 2.0 * F.coalesce("disparate_groups", F.lit(0.0)) + F.coalesce("jsd_penalty", F.lit(0.0))
        + F.coalesce("parity_penalty", F.lit(0.0)),
        "security": over("gps_images", 0.0, F.lit(2.0)) + over("pii_flag_count", 0.0, F.lit(2.0))
        + over("suspicious_rate", t.suspicious_warn, F.lit(1.0)) + F.coalesce("concentrated_sources", F.lit(0.0)),
    }
    points = {d: F.greatest(F.lit(0.0), ASSET_POINTS[d] - p) for d, p in lost.items()}
    traced = F.when(c("traceability_coverage") < t.traceability_warn, 2.0).otherwise(0.0)
    points["transparency"] = F.greatest(F.lit(0.0), ASSET_POINTS["transparency"] * F.coalesce(
        "datasheet_completeness", F.lit(0.0)) - traced)
    budget = asset_budget(weights)
    scored = runs.withColumns({f"{d}_points": p / ASSET_POINTS[d] * budget[d] for d, p in points.items()})
    total = sum((F.col(f"{d}_points") for d in points), F.lit(0.0))
    scored = scored.withColumn("score", F.bround(F.least(F.lit(100.0), F.round(total, 9)), 0).cast("bigint"))
    return scored.withColumn("grade", grade(F.col("score")))


def asset_budget(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Points each dimension can reach: base points, or user weights with transparency carved out first."""
    if weights is None:
        return dict(ASSET_POINTS)
    main = {d: float(weights.get(d, ASSET_POINTS[d])) for d in DEFAULT_WEIGHTS}
    clear = float(weights.get("transparency") or 0.0)
    all_weight = (sum(main.values()) + clear) or 1.0
    transparency = clear / all_weight * 100.0 if clear > 0 else ASSET_POINTS["transparency"]
    whole = sum(main.values()) or 1.0
    return {d: w / whole * (100.0 - transparency) for d, w in main.items()} | {"transparency": transparency}
