"""Full audits: one metric table per data set, composed from shared passes.

One scan of all columns measures missing cells, pattern hits, constants and the user's own checks. Numeric columns are melted into value
counts that serve quartiles and medians, then drift and scores follow. Row contents are grouped once for duplicates and leakage, labels and the
group cube are counted once and written, as they are small. No data are cached: each pass reads only its columns, so a table larger
than the cluster's memory costs scans, not spills.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import (
    PII_PATTERNS, categorical_columns, col, missing_flag, normalize_missing, numeric_columns, seconds_of, timestamp_of)
from plumbline.operators import dedup, drift, evidence, fairness, gate, labels, profile, quality, robust, scoring, series
from plumbline.operators.security import table_fingerprint
from plumbline.roles import Roles, TabularThresholds
from plumbline.sources.tables import written

METRIC_SCHEMA = ["dimension", "check", "subject", "key", "value", "text"]


def metric(dimension: str, check: str, key: str, value: Column | None = None, subject: Column | None = None,
           text: Column | None = None) -> Column:
    return F.struct(
        F.lit(dimension).alias("dimension"), F.lit(check).alias("check"),
        (subject if subject is not None else F.lit("")).cast("string").alias("subject"), F.lit(key).alias("key"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"))


def emit(frame: DataFrame, *metrics: Column) -> DataFrame:
    """Turns each row of a result into metric rows."""
    return frame.select(F.explode(F.array(*metrics)).alias("m")).select("m.*")


@dataclass(frozen=True)
class Check:
    """A check of the user's own: an aggregate column over all rows, run in the audit's shared scan.

    ``above`` and ``below`` are limits beyond which the check has a finding; it is then named by ``finding``.
    """

    dimension: str
    name: str
    value: Column
    above: float | None = None
    below: float | None = None
    finding: str = ""

    def metrics(self, value: Column) -> list[Column]:
        beyond = F.lit(False)
        if self.above is not None:
            beyond = beyond | (value > self.above)
        if self.below is not None:
            beyond = beyond | (value < self.below)
        return [metric(self.dimension, self.name, "value", value, F.lit("own check")),
                metric(self.dimension, self.name, "finding", F.when(beyond, 1.0), F.lit("own check"), F.lit(self.finding or self.name))]


def column_scan(df: DataFrame, roles: Roles, thresholds: TabularThresholds, checks: Sequence[Check] = ()) -> DataFrame:
    """Everything that one pass over all columns can measure, checks of the user's own among it."""
    texts = categorical_columns(df, roles.reserved)
    hits = [(c, p) for c in texts for p in PII_PATTERNS]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(missing_flag(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[F.avg(col(c).rlike(PII_PATTERNS[p]).cast("double")).alias(f"h{i}") for i, (c, p) in enumerate(hits)],
        *[c.value.cast("double").alias(f"own{i}") for i, c in enumerate(checks)],
        *[flag.alias(f"k{i}") for i, flag in enumerate(profile.constant_flags(df))])
    rates = [F.col(f"m{i}") for i in range(len(df.columns))]
    flagged = {c: F.lit(False) for c in texts}
    for i, (c, _) in enumerate(hits):
        flagged[c] = flagged[c] | F.coalesce(F.col(f"h{i}") >= thresholds.pii_hit_rate, F.lit(False))
    count = sum((f.cast("int") for f in flagged.values()), F.lit(0))
    out = [
        metric("reliability", "schema_consistency", "num_rows", F.col("rows")),
        metric("reliability", "schema_consistency", "num_cols", F.lit(len(df.columns))),
        metric("quality", "missingness", "overall_missing_rate", sum(rates, F.lit(0.0)) / len(rates)),
        metric("security", "confidentiality_pii_heuristics", "columns_with_hits", count)]
    out += [metric("quality", "missingness", "missing_rate", F.col(f"m{i}"), F.lit(c)) for i, c in enumerate(df.columns)]
    out += [metric("security", "confidentiality_pii_heuristics", "hit_rate",
                   F.when(F.col(f"h{i}") >= thresholds.pii_hit_rate, F.col(f"h{i}")), F.lit(c), F.lit(p))
            for i, (c, p) in enumerate(hits)]
    out += [metric("reliability", "schema_consistency", "constant_column", F.when(F.col(f"k{i}"), 1.0), F.lit(c)) for i, c in enumerate(df.columns)]
    for i, c in enumerate(checks):
        out += c.metrics(F.col(f"own{i}"))
    if roles.label:
        out.append(metric("quality", "label_stats", "label_missing_rate", F.col(f"m{df.columns.index(roles.label)}")))
    return emit(row, *out).filter(F.col("value").isNotNull())


def numeric_passes(df: DataFrame, roles: Roles) -> list[DataFrame]:
    """Outliers, drift and anomaly scores of the numeric columns.

    Quartiles, medians and MADs (a few numbers per column) are fitted first; outlier rates and row
    scores are then plain expressions over one more scan.
    """
    columns = numeric_columns(df, roles.reserved)
    if not columns:
        return []
    fences = robust.quartiles(df, columns)
    parts = [emit(robust.outlier_rates(df, fences), metric("quality", "outliers_iqr", "outlier_rate", F.col("outlier_rate"), F.col("column")))]
    sliced = drift.with_slices(df, roles)
    if sliced is not None:
        ks = drift.drift_of_ends(df, roles, columns, k=None)
        parts.append(emit(ks, metric("reliability", "numeric_drift_ks_first_last", "top_10_ks", F.col("ks"), F.col("column"))))
        by_slice = profile.missing_by_slice(sliced, drift.SLICE, df.columns)
        parts.append(emit(by_slice, metric("reliability", "missing_rate_by_slice", "missing_rate", F.col("missing_rate"), F.col("slice"))))
    medians = {c: q[1] for c, q in fences.items()}
    scored = df.select(robust.anomaly_score(df, robust.mad_centres(df, columns, medians)).alias("anomaly_score"))
    parts.append(emit(robust.score_summary(scored), *[metric("robustness", "row_anomaly_score_mad", k, F.col(k)) for k in ("mean", "p95", "p99", "max")]))
    return parts


def content_passes(df: DataFrame, roles: Roles) -> list[DataFrame]:
    if roles.split:
        row = dedup.duplicates_and_leakage(df, roles.split)
        parts = [emit(row, metric("quality", "duplicates", "exact_duplicate_row_rate", F.col("duplicate_rate")),
                      metric("quality", "split_leakage", "row_hash_cross_split_rate", F.col("leakage_rate")))]
    else:
        parts = [emit(dedup.duplicate_rate(df), metric("quality", "duplicates", "exact_duplicate_row_rate", F.col("duplicate_rate")))]
    if roles.ids:
        ids = dedup.duplicate_rate(df, roles.ids)
        parts.append(emit(ids, metric("quality", "duplicates", "duplicate_id_rate", F.col("duplicate_rate"))))
    return parts


def label_passes(df: DataFrame, roles: Roles) -> list[DataFrame]:
    parts = []
    if roles.label:
        counts = written(df.groupBy(col(roles.label).alias("label")).agg(F.count(F.lit(1)).alias("n")))  # a row for each label
        stats = quality.label_stats(df, roles.label, counts=counts)
        parts.append(emit(stats, metric("quality", "label_stats", "class_share", F.col("share"), F.col("label")))
                     .filter(F.col("value").isNotNull()))
        kind = profile.task_type(df, roles.label, counts)
        parts.append(emit(kind, metric("quality", "label_stats", "label_cardinality", F.col("distinct_labels"),
                                       text=F.col("task_type"))))
        features = categorical_columns(df, roles.reserved)
        if features:
            rare = robust.rare_categories(df, roles.label, features)
            parts.append(emit(rare.agg(F.count(F.lit(1)).alias("k")),
                              metric("robustness", "rare_category_label_concentration", "num_findings", F.col("k"))))
    if len(roles.annotators) >= 2:
        agreement = quality.annotator_agreement(df, roles.annotators)
        parts.append(emit(agreement, *[metric("quality", "label_agreement", k, F.col(k))
                                       for k in ("exact_agreement_rate", "disagreement_rate")]))
    return parts


def fairness_passes(df: DataFrame, roles: Roles) -> list[DataFrame]:
    if not roles.groups:
        return []
    cube = written(fairness.group_cube(df, roles.groups, roles.label))  # a row for each group and label, read by all that follow
    shares = fairness.group_shares(cube).groupBy("group_column").agg(
        F.count(F.lit(1)).alias("num_groups"), F.min("share").alias("min_group_share"), F.max("share").alias("max_group_share"))
    parts = [emit(shares, *[metric("fairness", "group_checks", k, F.col(k), F.col("group_column"))
                            for k in ("num_groups", "min_group_share", "max_group_share")])]
    spread = fairness.missing_disparity(df, roles.groups, k=None).groupBy("group_column").agg(F.max("disparity").alias("d"))
    parts.append(emit(spread, metric("fairness", "group_checks", "max_missingness_disparity", F.col("d"), F.col("group_column"))))
    if roles.label:
        gap = fairness.positive_rate_disparity(cube)
        parts.append(emit(gap, metric("fairness", "group_checks", "positive_rate_disparity",
                                      F.col("positive_rate_disparity"), F.col("group_column"))))
    return parts


def series_passes(df: DataFrame, roles: Roles) -> list[DataFrame]:
    """Time-axis checks; the step statistics follow record order across entities."""
    found = series.time_profile(df, roles.time)
    steps = written(series.steps(df, roles.time, roles.entities, across_entities=True))  # counts of steps, read by both that follow
    pace, gap = series.cadence(steps), series.gaps(steps)
    repeat = series.duplicate_timestamps(df, roles.time, roles.entities)
    name = "time_axis_health"
    return [
        emit(found, metric("quality", name, "time_parse.parse_ok_rate", F.col("parse_ok_rate")),
             metric("quality", name, "time_range.span_days", F.col("span_days"))),
        emit(repeat, metric("quality", name, "duplicate_timestamps.duplicate_rate", F.col("duplicate_rate"))),
        emit(pace, metric("quality", name, "cadence_global.irregularity_ratio", F.col("irregularity_ratio")),
             metric("quality", name, "cadence_global.median_step_seconds", F.col("median_seconds"))),
        emit(gap, metric("quality", name, "gaps_global.large_gap_rate", F.col("large_gap_rate")),
             metric("quality", name, "gaps_global.largest_gap_seconds", F.col("largest_gap_seconds")))]


def audit(df: DataFrame, roles: Roles, thresholds: TabularThresholds = TabularThresholds(), dataset: str = "dataset",
          run_id: str | None = None, kind: str = "tabular", models: bool = False,
          fingerprint: bool = True, checks: Sequence[Check] = ()) -> DataFrame:
    """The metric table of one data set: (run_id, dataset, dimension, check, subject, key, value, text).

    ``checks`` of the user's own are aggregates in the scan that the built-in checks share.
    """
    df = normalize_missing(df)
    parts = [column_scan(df, roles, thresholds, checks), *numeric_passes(df, roles), *content_passes(df, roles),
             *label_passes(df, roles), *fairness_passes(df, roles)]
    if kind == "series" and roles.time:
        parts += series_passes(df, roles)
    if fingerprint:
        mark = table_fingerprint(df)
        parts.append(emit(mark, metric("security", "integrity", "sha256", text=F.col("fingerprint")),
                          metric("security", "availability_asset_checks", "byte_size", F.col("encoded_bytes"))))
    if models and roles.label:
        parts += model_passes(df, roles, thresholds)
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select(F.lit(run_id or dataset).alias("run_id"), F.lit(dataset).alias("dataset"), *METRIC_SCHEMA)


def model_passes(df: DataFrame, roles: Roles, thresholds: TabularThresholds) -> list[DataFrame]:
    """Label noise and label predictability (fits models, so only on request)."""
    skip = {*roles.reserved, *roles.annotators, *roles.ids}
    features = [c for c in df.columns if c not in skip]
    if roles.time:  # time is a feature of its own, as a number
        df = df.withColumn("_time_feature", seconds_of(timestamp_of(df, roles.time)))
        features.append("_time_feature")
    noise = labels.label_noise(df, roles.label, features, roles.ids)
    parts = []
    if noise.scored is not None:
        parts.append(emit(labels.noise_summary(noise), *[
            metric("quality", "label_noise", k, F.col(k))
            for k in ("suspected_label_noise_rate", "estimated_label_noise_rate", "out_of_fold_accuracy")]))
    auc = labels.predictability_auc(df, roles.label, numeric_columns(df, roles.reserved), roles.ids)
    if auc is not None:
        parts.append(emit(auc, metric("robustness", "label_predictability_auc", "auc", F.col("auc"))))
    return parts


def headline(metrics: DataFrame) -> DataFrame:
    """(run_id, metric, value) rows that scoring, review and gate work on."""
    def best(check: str, key: str) -> Column:
        return F.max(F.when((F.col("check") == check) & (F.col("key") == key), F.col("value")))

    disparity = F.when(F.col("key") == "positive_rate_disparity", F.col("value"))
    row = metrics.groupBy("run_id").agg(
        best("missingness", "overall_missing_rate").alias("missingness"),
        best("duplicates", "exact_duplicate_row_rate").alias("duplicate_rate"),
        best("split_leakage", "row_hash_cross_split_rate").alias("split_leakage"),
        best("label_noise", "suspected_label_noise_rate").alias("label_noise"),
        best("label_noise", "estimated_label_noise_rate").alias("estimated_label_noise"),
        best("confidentiality_pii_heuristics", "columns_with_hits").alias("pii_flag_count"),
        best("confidentiality_pii_heuristics", "hit_rate").alias("pii_worst_rate"),
        best("numeric_drift_ks_first_last", "top_10_ks").alias("max_drift_ks"),
        best("row_anomaly_score_mad", "p99").alias("p99_anomaly"),
        F.max(disparity).alias("max_positive_rate_disparity"),
        F.avg(F.when(disparity.isNotNull(), scoring.credit(disparity, 0.20, 0.50))).alias("mean_disparity_credit"),
        best("label_predictability_auc", "auc").alias("label_auc"),
        best("time_axis_health", "time_parse.parse_ok_rate").alias("parse_ok_rate"),
        best("time_axis_health", "duplicate_timestamps.duplicate_rate").alias("duplicate_timestamps"),
        best("time_axis_health", "cadence_global.irregularity_ratio").alias("irregularity"),
        best("readability", "corrupt_rate").alias("corrupt_rate"))
    return row.unpivot(["run_id"], list(scoring.METRICS), "metric", "value").filter(F.col("value").isNotNull())


def own_findings(metrics: DataFrame) -> DataFrame:
    """(run_id, dimension, check, value, finding) of every check of the user's own; ``finding`` is null where its limits hold."""
    own = metrics.filter("subject = 'own check'")
    return own.groupBy("run_id", "dimension", "check").agg(
        F.max(F.when(F.col("key") == "value", F.col("value"))).alias("value"), F.max(F.when(F.col("key") == "finding", F.col("text"))).alias("finding"))


def report(metrics: DataFrame, thresholds: TabularThresholds = TabularThresholds(), rules=scoring.TABULAR_RULES,
           weights: dict | None = None) -> DataFrame:
    """One row per run: score, grade, component points, verdict, findings, recommendations."""
    heads = headline(metrics)
    runs = scoring.health_score(scoring.wide(heads), thresholds.drift_ks, thresholds.label_noise_warn, weights)
    verdicts = scoring.review(heads, rules, thresholds)
    mark = metrics.groupBy("run_id", F.col("dataset").alias("dataset_name")).agg(
        F.max(F.when((F.col("check") == "integrity") & (F.col("key") == "sha256"), F.col("text"))).alias("file_sha256"))
    return runs.join(verdicts, "run_id").join(mark, "run_id")


def evidence_values(metrics: DataFrame, reports: DataFrame) -> DataFrame:
    """Dotted-path values of runs, extended by verdict, counts, score and group disparity."""
    def entry(path: str, value: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(F.lit(path).alias("path"), (value if value is not None else F.lit(None)).cast("double").alias("value"),
                        (text if text is not None else F.lit(None)).cast("string").alias("text"))

    top = reports.select("run_id", F.explode(F.array(
        entry("verdict", text=F.col("verdict")), entry("findings", F.size("findings")),
        entry("recommendations", F.size("recommendations")), entry("score", F.col("score"), F.col("grade")),
        entry("config", F.lit(1.0)), entry("dataset_name", text=F.col("dataset_name")))).alias("p")).select("run_id", "p.*")
    gap = metrics.filter("dimension = 'fairness' AND key IN ('positive_rate_disparity', 'max_label_parity_gap', 'max_missingness_disparity')")
    gap = gap.groupBy("run_id").agg(F.max("value").alias("value")).select(
        "run_id", F.lit("fairness.group_checks.max_disparity").alias("path"), "value", F.lit(None).cast("string").alias("text"))
    return evidence.paths(metrics).unionByName(top).unionByName(gap)


def audit_history(reports: DataFrame, analyzer: str = "tabular", created_at: Column | None = None) -> DataFrame:
    return gate.audit_records(reports.withColumn("analyzer", F.lit(analyzer)), created_at)
