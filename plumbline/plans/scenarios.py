"""Headline metrics of many data sets at once: every operator grouped by a leading run key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, col
from plumbline.operators import dedup, fairness, profile, scoring, security
from plumbline.operators.distribution import ks_from_counts, melt, near_rank_quantiles, value_counts
from plumbline.sources.tables import written


def anomaly_p99(df: DataFrame, run: str, numeric: Sequence[str]) -> DataFrame:
    """p99 of the row anomaly score per run. Medians and MADs are tables of runs; Spark joins them by their size."""

    def fitted(frame: DataFrame, name: str) -> DataFrame:
        found = near_rank_quantiles(frame, run, {c: 0.5 for c in numeric})
        return written(found.select(run, *[col(c).alias(f"_{name}_{c}") for c in numeric]))

    view = df.select(run, *[as_double(df, c).alias(c) for c in numeric])
    centred = view.join(fitted(view, "median"), run, "left")
    gaps = centred.select(run, *[F.abs(col(c) - col(f"_median_{c}")).alias(c) for c in numeric])
    scaled = gaps.join(fitted(gaps, "mad"), run, "left")
    parts = [F.when(col(f"_mad_{c}") > 0, col(c) / col(f"_mad_{c}")) for c in numeric]
    used = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    score = F.when(used > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / used)
    return near_rank_quantiles(scaled.select(run, score.alias("p99_anomaly")), run, {"p99_anomaly": 0.99})


def pii_of(rates: DataFrame, run: str, threshold: float = 0.01) -> DataFrame:
    """Columns with personal data and the worst rate per run."""
    found = F.col("hit_rate") >= threshold
    return rates.groupBy(run).agg(F.count_distinct(F.when(found, F.col("column"))).cast("double").alias("pii_flag_count"),
                                  F.max(F.when(found, F.col("hit_rate"))).alias("pii_worst_rate"))


def fair_of(cube: DataFrame, run: str) -> DataFrame:
    """Worst disparity of positive rates and its credit per run, from counts by group and label."""
    gap = F.col("positive_rate_disparity")
    return fairness.positive_rate_disparity(cube, [run]).groupBy(run).agg(
        F.max(gap).alias("max_positive_rate_disparity"), F.avg(scoring.credit(gap, 0.20, 0.50)).alias("mean_disparity_credit"))


def with_numbers(alike: DataFrame, rows: DataFrame, run: str, late: Column, numeric: Sequence[str], anomalies: bool = True) -> DataFrame:
    """Adds the drift and the anomaly score of each run's numbers."""
    sides = rows.withColumn("_late", late).filter(F.col("_late").isNotNull())
    counts = value_counts(melt(sides, numeric, [run, "_late"]), [run, "column"],
                          n_a=1 - F.col("_late"), n_b=F.col("_late"))
    drift = ks_from_counts(counts, [run, "column"]).groupBy(run).agg(F.max("ks").alias("max_drift_ks"))
    alike = alike.join(drift, run, "left")
    return alike.join(anomaly_p99(rows, run, numeric), run, "left") if anomalies else alike


def with_all_metrics(runs: DataFrame) -> DataFrame:
    return runs.withColumns({name: F.lit(None).cast("double") for name in scoring.METRICS if name not in runs.columns})


def run_metrics(df: DataFrame, run: str, late: Column, split: str, numeric: Sequence[str], texts: Sequence[str],
                groups: Sequence[str], label: str, pii_threshold: float = 0.01, anomalies: bool = True,
                twin: Column | None = None) -> DataFrame:
    """One wide row per run with the headline metrics that scoring and the gate use.

    ``late`` is 0 for rows of the first slice, 1 for the last, null elsewhere. The run key is text. ``twin`` names, from the run key, the run
    that stands for all whose rows repeat, leak, miss cells and hold numbers alike: these are measured there, texts and groups in every run.
    """
    features = [c for c in df.columns if c != run]
    # a text that many rows share is searched once
    shared = df.groupBy(run, *texts).agg(F.count(F.lit(1)).alias("_n"))
    pii = pii_of(security.pii_hit_rates(shared, texts, [run], "_n"), run, pii_threshold)
    fair = fair_of(written(fairness.group_cube(df, groups, label, [run])), run)
    rows = df if twin is None else df.filter(col(run) == twin)
    missing = profile.missing_overall(rows, [run], features).select(
        run, F.col("missing_rate").alias("missingness"), F.col("rows").alias("n_rows"))
    content = dedup.duplicates_and_leakage(rows, split, [run]).select(
        run, "duplicate_rate", F.col("leakage_rate").alias("split_leakage"))
    alike = with_numbers(missing.join(content, run), rows, run, late, numeric, anomalies)
    stand_in = col(run) if twin is None else twin
    out = pii.withColumn("_twin", stand_in).join(alike.withColumnRenamed(run, "_twin"), "_twin").drop("_twin").join(fair, run, "left")
    return with_all_metrics(out)


def metric_rows(runs: DataFrame, run: str = "run_id", names: Sequence[str] = scoring.METRICS) -> DataFrame:
    """Wide runs as (run_id, metric, value) rows without the missing ones."""
    return runs.unpivot([run], list(names), "metric", "value").filter(F.col("value").isNotNull())
