"""Distribution drift between slices of one table and between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import (
    as_double, col, is_datetime, is_numeric, numeric_columns, slice_bounds, slice_label, timestamp_of)
from plumbline.operators.dedup import schema_delta
from plumbline.operators.distribution import (
    bounded_rows, ks_from_counts, ks_p_value, melt, quantiles, value_counts)
from plumbline.operators.profile import missing_by_column, numeric_variances, top
from plumbline.roles import Roles

SLICE = "_slice"


def quartile_slices(df: DataFrame, column: str) -> Column:
    """Ordinal quartile of a numeric order column (q1..q4), equal break points merged."""
    counts = value_counts(df.select(F.lit(1).alias("key"), as_double(df, column).alias("value"))
                          .filter(F.col("value").isNotNull()), ["key"])
    cuts = quantiles(counts, ["key"], {"a": 0.25, "b": 0.5, "c": 0.75})
    edges = sorted({v for r in bounded_rows(cuts, 1) for v in (r["a"], r["b"], r["c"])})
    x = as_double(df, column)
    below = sum(((F.lit(e) < x).cast("int") for e in edges), F.lit(1))
    return F.when(x.isNotNull(), F.concat(F.lit("q"), below.cast("string")))


def with_slices(df: DataFrame, roles: Roles, prefer: str = "time") -> DataFrame | None:
    """Adds the slice label: by time (period, or quartile for numeric time) or by split."""
    order = ("time", "split") if prefer == "time" else ("split", "time")
    for kind in order:
        if kind == "time" and roles.time:
            dtype = df.schema[roles.time].dataType
            if is_numeric(dtype) and not is_datetime(dtype):
                return df.withColumn(SLICE, quartile_slices(df, roles.time))
            label = slice_label(timestamp_of(df, roles.time), roles.slice_mode)
            return None if label is None else df.withColumn(SLICE, label)
        if kind == "split" and roles.split:
            return df.withColumn(SLICE, col(roles.split).cast("string"))
    return None


def slice_range(sliced: DataFrame) -> DataFrame:
    """First and last slice in label order, with their row counts."""
    counts = sliced.filter(F.col(SLICE).isNotNull()).groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min(SLICE).alias("first_slice"), F.max(SLICE).alias("last_slice"),
        F.min_by("n", SLICE).alias("first_slice_rows"), F.max_by("n", SLICE).alias("last_slice_rows"),
        F.count(F.lit(1)).alias("num_slices"))


def end_slices(df: DataFrame, roles: Roles) -> tuple[DataFrame, tuple[str, str]] | None:
    """The rows of the first and the last period of the time column with their label, and the two labels.

    The least and greatest timestamp are one aggregate over that column alone. They give the two periods' ranges on the raw column, a
    filter that reaches the scan, so all periods between are skipped by the files' statistics. None where slices are not
    periods of a timestamp column.
    """
    if not roles.time or not is_datetime(df.schema[roles.time].dataType) or slice_label(F.lit(None), roles.slice_mode) is None:
        return None
    time = col(roles.time)
    lo, hi = df.agg(F.min(time.cast("timestamp_ntz")), F.max(time.cast("timestamp_ntz"))).first()
    label = slice_label(timestamp_of(df, roles.time), roles.slice_mode)
    if lo is None:
        return df.filter(F.lit(False)).withColumn(SLICE, label), ("", "")
    kind = df.schema[roles.time].dataType
    (_, first_end), (last_start, _) = slice_bounds(lo, roles.slice_mode), slice_bounds(hi, roles.slice_mode)
    ends = [F.lit(t.isoformat(" ")).cast("timestamp_ntz").cast(kind) for t in (first_end, last_start)]
    pair = df.filter((time < ends[0]) | (time >= ends[1])).withColumn(SLICE, label)
    names = df.sparkSession.range(1).select(*[slice_label(F.lit(t.isoformat(" ")).cast("timestamp_ntz"), roles.slice_mode) for t in (lo, hi)]).first()
    return pair, (names[0], names[1])


def drift_first_last(sliced: DataFrame, columns: Sequence[str], minimum: int = 20, k: int | None = 10,
                     by: Sequence[str] = (), ends: tuple[str, str] | None = None) -> DataFrame:
    """KS distance between the first and the last slice for each numeric column.

    ``ends`` names the two slices where they are known, as for a frame of ``end_slices``.
    """
    first, last = ends or sliced.agg(F.min(SLICE), F.max(SLICE)).first()
    pair = sliced.filter(F.col(SLICE).isin(first, last))
    pair = pair.withColumn("_late", (F.col(SLICE) != F.lit(first)).cast("int"))
    counts = value_counts(melt(pair, columns, [*by, "_late"]), [*by, "column"],
                          n_a=1 - F.col("_late"), n_b=F.col("_late"))
    found = ks_from_counts(counts, [*by, "column"], minimum=minimum).filter(F.col("ks").isNotNull())
    found = found.select(*by, "column", "ks", F.col("n_a").alias("first_values"), F.col("n_b").alias("last_values"))
    return found if k is None else top(found, k, "ks", "column")


def drift_of_ends(df: DataFrame, roles: Roles, columns: Sequence[str], k: int | None = 10) -> DataFrame | None:
    """``drift_first_last`` by the cheapest way: only the two periods are read where slices are periods."""
    pair = end_slices(df, roles)
    if pair is not None:
        return drift_first_last(pair[0], columns, k=k, ends=pair[1])
    sliced = with_slices(df, roles)
    return None if sliced is None else drift_first_last(sliced, columns, k=k)


def cross_drift(a: DataFrame, b: DataFrame, threshold: float = 0.30, max_columns: int | None = None) -> DataFrame:
    """Per shared numeric column of two tables: KS, p-value, means, mean change, flag."""
    in_b = set(numeric_columns(b))
    shared = sorted(c for c in numeric_columns(a) if c in in_b)
    if max_columns and len(shared) > max_columns:
        keep = numeric_variances(a, shared, max_columns)
        shared = [r["column"] for r in keep.select("column").collect()]
    sides = [melt(frame, shared, [F.lit(side).alias("_late")]) for side, frame in ((0, a), (1, b))]
    late = F.col("_late")
    counts = value_counts(sides[0].unionByName(sides[1]), ["column"], n_a=1 - late, n_b=late)
    ks = ks_from_counts(counts, ["column"])
    value = F.col("value")
    means = counts.groupBy("column").agg(
        (F.sum(value * F.col("n_a")) / F.sum("n_a")).alias("baseline_mean"),
        (F.sum(value * F.col("n_b")) / F.sum("n_b")).alias("candidate_mean"))
    joined = ks.filter(F.col("ks").isNotNull()).join(F.broadcast(means), "column")
    return joined.select(
        "column", "ks", ks_p_value(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("p_value"),
        "baseline_mean", "candidate_mean",
        (F.col("candidate_mean") - F.col("baseline_mean")).alias("mean_delta"),
        (F.col("ks") > threshold).alias("flagged")).orderBy(F.desc("ks"), "column")


def missing_shift(a: DataFrame, b: DataFrame, minimum: float = 0.01) -> DataFrame:
    """Shared columns whose missing rate moved by more than ``minimum``."""
    shared = sorted(set(a.columns) & set(b.columns))
    left = missing_by_column(a, shared).select("column", F.col("missing_rate").alias("baseline_missing"))
    right = missing_by_column(b, shared).select("column", F.col("missing_rate").alias("candidate_missing"))
    delta = F.col("candidate_missing") - F.col("baseline_missing")
    return (left.join(F.broadcast(right), "column").withColumn("delta", delta)
            .filter(F.abs("delta") > minimum).orderBy(F.desc(F.abs("delta")), "column"))


def cross_verdict(a: DataFrame, b: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Overall verdict on two tables: schema first, then drift, then nothing comparable."""
    changed = schema_delta(a, b).filter("status <> 'shared'").agg(F.count(F.lit(1)).alias("k")).scalar()
    drift = cross_drift(a, b, threshold).agg(
        F.coalesce(F.sum(F.col("flagged").cast("bigint")), F.lit(0)).alias("flagged_columns"),
        F.coalesce(F.max("ks"), F.lit(0.0)).alias("max_ks"))
    return drift.withColumn("schema_changes", changed).withColumn(
        "verdict", F.when(F.col("schema_changes") > 0, "Schema changed")
        .when(F.col("flagged_columns") > 0, "Drift detected")
        .when(F.col("max_ks") > 0, "No drift above threshold").otherwise("No comparable numeric columns"))
