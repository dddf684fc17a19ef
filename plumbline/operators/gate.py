"""Policy gate, audit records, history views and run-to-run comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.columns import slug

# Policy presets and the metrics a comparison reports.
POLICIES = {
    "Strict production": dict(min_health_score=90, max_missingness=0.02, max_duplicate_rate=0.005, allow_pii=False,
                              max_split_leakage=0.0, max_drift_ks=0.20, max_positive_rate_disparity=0.10),
    "Balanced (default)": dict(min_health_score=65, max_missingness=0.15, max_duplicate_rate=0.08, allow_pii=False,
                               max_split_leakage=0.01, max_drift_ks=0.50, max_positive_rate_disparity=0.40),
    "Lenient development": dict(min_health_score=55, max_missingness=0.25, max_duplicate_rate=0.15, allow_pii=False,
                                max_split_leakage=0.03, max_drift_ks=0.65, max_positive_rate_disparity=0.55),
    "Exploratory research": dict(min_health_score=60, max_missingness=0.20, max_duplicate_rate=0.10, allow_pii=True,
                                 max_split_leakage=0.01, max_drift_ks=0.60, max_positive_rate_disparity=0.50),
}
DEFAULT_POLICY = "Balanced (default)"
COMPARED = {
    "missingness": "Missingness", "duplicate_rate": "Duplicate rate", "split_leakage": "Split leakage",
    "max_drift_ks": "Max drift KS", "max_positive_rate_disparity": "Positive-rate disparity",
    "pii_flag_count": "PII flag count", "corrupt_rate": "Corrupt image rate",
}
_POLICY_SCHEMA = ("policy string, min_health_score double, max_missingness double, max_duplicate_rate double, "
                  "allow_pii boolean, max_split_leakage double, max_drift_ks double, max_positive_rate_disparity double")
_LIMITS = (("Missingness", "missingness", "max_missingness"), ("Duplicate rate", "duplicate_rate", "max_duplicate_rate"),
           ("Split leakage", "split_leakage", "max_split_leakage"), ("Max drift KS", "max_drift_ks", "max_drift_ks"),
           ("Positive-rate disparity", "max_positive_rate_disparity", "max_positive_rate_disparity"))


def policies(spark: SparkSession, overrides: Mapping[str, Mapping] | None = None) -> DataFrame:
    """The preset table; custom policies override single limits of the default."""
    rules = dict(POLICIES) | {
        name: {**POLICIES[DEFAULT_POLICY], **custom} for name, custom in (overrides or {}).items()}
    rows = [(name, *[float(v) if not isinstance(v, bool) else v for v in p.values()]) for name, p in rules.items()]
    return spark.createDataFrame(rows, _POLICY_SCHEMA)


def gate_checks(runs: DataFrame, rules: Mapping[str, Mapping] | None = None,
                presets: list[str] | None = None) -> DataFrame:
    """One row per run, policy and check with status pass / fail / not_applicable.

    Policies are a handful of fixed rules, so they are exploded from a literal array: no join at all.
    """
    named = dict(POLICIES) | {n: {**POLICIES[DEFAULT_POLICY], **c} for n, c in (rules or {}).items()}
    chosen = presets or list(named)
    entries = []
    for name in chosen:
        p = named[name]
        entries.append(_check(name, "Health score", F.col("score").cast("double"),
                              F.lit(f">= {p['min_health_score']}"), F.col("score") >= p["min_health_score"]))
        for title, metric, limit in _LIMITS:
            entries.append(_check(name, title, F.col(metric), F.lit(f"<= {p[limit]}"), F.col(metric) <= float(p[limit])))
        flags = F.col("pii_flag_count")
        entries.append(_check(name, "PII flags", flags, F.lit("allowed" if p["allow_pii"] else "0"),
                              F.when(flags.isNotNull(), F.lit(p["allow_pii"]) | (flags == 0))))
    return runs.select("run_id", F.explode(F.array(*entries)).alias("c")).select("run_id", "c.*")


def _check(policy: str, name: str, value: Column, limit: Column, passed: Column) -> Column:
    status = F.when(passed.isNull(), "not_applicable").when(passed, "pass").otherwise("fail")
    return F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("check"), value.alias("value"),
                    limit.alias("limit"), status.alias("status"))


def gate(checks: DataFrame) -> DataFrame:
    """PASS unless any check fails."""
    return checks.groupBy("run_id", "policy").agg(
        F.when(F.max((F.col("status") == "fail").cast("int")) == 1, "FAIL").otherwise("PASS").alias("status"),
        F.sum((F.col("status") == "fail").cast("bigint")).alias("violations"))


def metric_snapshot(metrics: DataFrame) -> DataFrame:
    """Headline metrics of each run from its full metric table (dimension, check, subject, key, value).

    The first present alternative wins; drift and disparity are maxima over their subjects.
    """
    def pick(check: str, key: str) -> Column:
        return F.max(F.when((F.col("check") == check) & (F.col("key") == key), F.col("value")))

    is_disparity = F.col("key").isin("positive_rate_disparity", "max_label_parity_gap")
    return metrics.groupBy("run_id").agg(
        pick("missingness", "overall_missing_rate").alias("missingness"),
        F.coalesce(pick("duplicates", "exact_duplicate_row_rate"), pick("duplicates", "exact_duplicate_rate"))
        .alias("duplicate_rate"),
        F.coalesce(pick("split_leakage", "row_hash_cross_split_rate"), pick("cross_split_leakage", "cross_split_leakage_rate"))
        .alias("split_leakage"),
        F.max(F.when((F.col("check").isin("numeric_drift_ks_first_last", "feature_drift_ks_first_last")) & (F.col("key") == "top_10_ks"), F.col("value"))).alias("max_drift_ks"),
        F.max(F.when((F.col("dimension") == "fairness") & is_disparity, F.col("value")))
        .alias("max_positive_rate_disparity"),
        pick("confidentiality_pii_heuristics", "columns_with_hits").alias("pii_flag_count"),
        pick("readability", "corrupt_rate").alias("corrupt_rate"))


def audit_records(runs: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Adds record id, creation time and schema version to scored runs.

    Expects dataset_name, analyzer and file_sha256 columns.
    """
    created = (created_at if created_at is not None else F.current_timestamp()).cast("timestamp")
    text = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ssXXX")
    stamp = F.replace(F.replace(F.date_format(created, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(":"), F.lit("")), F.lit("+"), F.lit("Z"))
    sha = F.substring(F.coalesce("file_sha256", F.lit("no-sha")), 1, 12)
    return runs.withColumns({
        "schema_version": F.lit(1), "created_at_utc": text,
        "record_id": F.concat_ws("-", stamp, slug(F.col("analyzer")), sha)})


def latest_runs(history: DataFrame) -> DataFrame:
    """The newest record of each analyzer and dataset."""
    return history.groupBy("analyzer", "dataset_name").agg(
        F.max_by(F.struct("record_id", "created_at_utc", "score", "grade"), F.struct("created_at_utc", "record_id")).alias("r")
    ).select("analyzer", "dataset_name", "r.*")


def compare_consecutive(history: DataFrame, metrics: Mapping[str, str] = COMPARED) -> DataFrame:
    """Each run of a dataset against the one before it: before, after, change and direction per metric."""
    series = Window.partitionBy("dataset_name").orderBy("created_at_utc", "run_id")
    cells = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(m).alias("after"),
                               F.lag(m).over(series).alias("before")) for m, label in metrics.items()])
    paired = history.select("dataset_name", "run_id", F.lag("run_id").over(series).alias("base_run_id"), cells.alias("c"))
    rows = paired.filter(F.col("base_run_id").isNotNull()).select("dataset_name", "base_run_id", "run_id", F.explode("c").alias("c"))
    return rows.select("dataset_name", "base_run_id", "run_id", "c.metric", "c.before", "c.after",
                       *_change(F.col("c.before"), F.col("c.after")))


def _change(before: Column, after: Column) -> list[Column]:
    delta = after - before
    return [delta.alias("delta"),
            F.when(delta.isNull(), "not_applicable").when(F.abs(delta) < 1e-12, "unchanged")
            .when(delta < 0, "improved").otherwise("worse").alias("direction")]


def compare_runs(base: DataFrame, candidate: DataFrame, names: Sequence[str] = tuple(COMPARED)) -> DataFrame:
    """Two metric tables (metric, value) side by side: a row for each compared name, whatever each of them lacks."""
    listed = base.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    a = base.select("metric", F.col("value").alias("before"))
    b = candidate.select("metric", F.col("value").alias("after"))
    return (listed.join(a, "metric", "left").join(b, "metric", "left")
            .select("metric", "before", "after", *_change(F.col("before"), F.col("after"))))


def compare_findings(history: DataFrame) -> DataFrame:
    """New and resolved findings and recommendations of each run against the previous one."""
    series = Window.partitionBy("dataset_name").orderBy("created_at_utc", "run_id")
    out = history.withColumns({f"_{c}": F.lag(c).over(series) for c in ("findings", "recommendations", "score", "grade")})
    out = out.filter(F.col("_findings").isNotNull())

    def only(a: str, b: str) -> Column:
        return F.array_sort(F.array_except(a, b))

    return out.select(
        "dataset_name", "run_id", (F.col("score") - F.col("_score")).alias("score_delta"),
        F.col("_grade").alias("grade_before"), F.col("grade").alias("grade_after"),
        only("findings", "_findings").alias("new_findings"), only("_findings", "findings").alias("resolved_findings"),
        only("recommendations", "_recommendations").alias("new_recommendations"),
        only("_recommendations", "recommendations").alias("resolved_recommendations"))
