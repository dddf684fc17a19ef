"""Outliers, anomaly scores and suspicious rare categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, categorical_columns, col
from plumbline.operators.distribution import bounded_rows, melt, quantiles, value_counts
from plumbline.operators.profile import top


def quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float, int]]:
    """(q1, median, q3, values) of each column, fitted exactly; one row per column reaches the driver."""
    found = quantiles(value_counts(melt(df, columns), ["column"]), ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return {r["column"]: (r["q1"], r["median"], r["q3"], r["n_values"]) for r in bounded_rows(found, len(columns))}


def outlier_rates(df: DataFrame, fences: dict[str, tuple[float, float, float, int]], minimum: int = 8) -> DataFrame:
    """Share of values outside the fitted 1.5-IQR fences, from one scan without a shuffle of values."""
    usable = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), q3 != q1) for c, (q1, _, q3, n) in fences.items() if n >= minimum}
    if not usable:
        return df.sparkSession.createDataFrame([], "column string, outlier_rate double")
    row = df.agg(*[
        F.avg(((as_double(df, c) < lo) | (as_double(df, c) > hi)).cast("double") * (1.0 if wide else 0.0)).alias(c)
        for c, (lo, hi, wide) in usable.items()])
    return row.unpivot([], [col(c) for c in usable], "column", "outlier_rate")


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: int | None = 10) -> DataFrame:
    fences = quartiles(df, columns)
    sizes = df.sparkSession.createDataFrame([(c, q[3]) for c, q in fences.items()], "column string, n_values long")
    rates = outlier_rates(df, fences).join(F.broadcast(sizes), "column")
    return rates if k is None else top(rates, k, "outlier_rate", "column")


def mad_centres(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None = None) -> dict[str, tuple[float, float]]:
    """(median, MAD) of each column; one row per column reaches the driver, never data."""
    if medians is None:
        medians = {c: q[1] for c, q in quartiles(df, columns).items()}
    if not medians:
        return {}
    centred = df.select(*[
        F.abs(as_double(df, c) - F.lit(m)).alias(c) for c, m in medians.items()])
    spread = quantiles(value_counts(melt(centred, list(medians)), ["column"]), ["column"], {"mad": 0.5})
    return {r["column"]: (medians[r["column"]], r["mad"]) for r in bounded_rows(
        spread.select("column", "mad"), len(columns))}


def anomaly_score(df: DataFrame, centres: dict[str, tuple[float, float]]) -> Column:
    """Mean over columns of |x - median| / MAD; columns with MAD 0 or a missing value do not count."""
    parts = [F.abs(as_double(df, c) - F.lit(median)) / F.lit(mad)
             for c, (median, mad) in centres.items() if mad > 0]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    used = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(used > 0, total / used)


def mad_scores(df: DataFrame, columns: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Rows with their ``anomaly_score``."""
    kept = [col(c) for c in (df.columns if keep is None else keep)]
    return df.select(*kept, anomaly_score(df, mad_centres(df, columns)).alias("anomaly_score"))


def score_summary(scored: DataFrame, score: str = "anomaly_score", threshold: float = 3.0) -> DataFrame:
    """Mean, p95, p99, maximum and outlier share of row scores, all from one frame of counts; a row without a score is no outlier."""
    counts = value_counts(scored.select(F.lit(1).alias("key"), col(score).alias("value")), ["key"])
    high = F.when(F.col("value") > threshold, F.col("n")).otherwise(0)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    rows = counts.groupBy("key").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum(known)).alias("mean"), F.max("value").alias("max"),
        (F.sum(high) / F.sum("n")).alias("outlier_rate"), F.sum(high).alias("outlier_count"))
    points = quantiles(counts.filter("value is not null"), ["key"], {"p95": 0.95, "p99": 0.99})
    return rows.join(F.broadcast(points.drop("n_values")), "key", "left").drop("key")


def top_anomalies(scored: DataFrame, key: Sequence[str], k: int = 20) -> DataFrame:
    return top(scored, k, "anomaly_score", *key)


def outlier_rate_by_label(scored: DataFrame, label: str, threshold: float = 3.0, minimum: int = 5) -> DataFrame:
    rates = scored.filter(col(label).isNotNull()).groupBy(col(label).cast("string").alias("label")).agg(
        F.avg(F.coalesce((F.col("anomaly_score") > threshold).cast("double"), F.lit(0.0))).alias("outlier_rate"),
        F.count(F.lit(1)).alias("n"))
    return rates.filter(F.col("n") >= minimum)


def rare_categories(df: DataFrame, label: str, columns: Sequence[str] | None = None,
                    exclude: Sequence[str] = (), minimum_share: float = 0.95) -> DataFrame:
    """Rare category values whose labels are (almost) all the same.

    One (column, value, label) aggregate replaces a scan per value.
    """
    columns = list(columns or categorical_columns(df, {label, *exclude}))
    cells = (melt(df, columns, [col(label).cast("string").alias("_label")], numeric=False)
             .groupBy("column", "value", "_label").agg(F.count(F.lit(1)).alias("n")))
    labelled = F.when(F.col("_label").isNotNull(), F.col("n"))
    values = cells.groupBy("column", "value").agg(
        F.sum("n").alias("count"), F.sum(labelled).alias("_known"), F.max(labelled).alias("_top"),
        F.min_by("_label", F.when(F.col("_label").isNotNull(), F.struct(-F.col("n"), "_label"))).alias("top_label"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    ceiling = F.greatest(F.lit(5), F.floor(rows * 0.001))
    share = F.col("_top") / F.col("_known")
    return (values.filter((F.col("count") >= 5) & (F.col("count") <= ceiling) & (share >= minimum_share))
            .select("column", "value", "count", "top_label", share.alias("top_label_share")))


def top_rare_categories(findings: DataFrame, k: int = 20) -> DataFrame:
    return findings.orderBy(F.desc("top_label_share"), F.desc("count"), "column", "value").limit(k)
