"""Column profile, completeness and value distributions of single columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    as_double, coarse_type, col, is_nested, is_numeric, missing_flag, ratio)
from plumbline.operators.distribution import value_counts, with_totals
from plumbline.roles import Roles


def column_types(df: DataFrame) -> DataFrame:
    """One row per column with its coarse type, read from the schema alone."""
    rows = [(i, f.name, coarse_type(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, dtype string")


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """Missing cells, rows and rate per column in one scan; ``by`` adds leading group keys."""
    columns = list(columns or [c for c in df.columns if c not in by])
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(missing_flag(df, c)).alias(c) for c in columns])
    ids = [*by, "_rows"]
    long = sums.select(*[col(c) for c in ids], *[col(c).cast("bigint").alias(c) for c in columns]).unpivot(
        [col(c) for c in ids], [col(c) for c in columns], "column", "missing")
    return long.select(*by, "column", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"),
                       F.col("_rows").alias("rows"),
                       ratio(F.col("missing"), F.col("_rows")).alias("missing_rate"))


def missing_overall(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """Share of missing cells, equal to the mean of the column rates. A row stands for ``weight`` rows."""
    columns = list(columns or [c for c in df.columns if c not in by])
    cells = sum((missing_flag(df, c) for c in columns), F.lit(0)).cast("bigint")
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by).agg(
        (F.sum(cells if weight is None else cells * F.col(weight)) / F.nullif(rows * len(columns), F.lit(0))).alias("missing_rate"),
        rows.alias("rows"))


def missing_by_slice(df: DataFrame, slice_column: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing-cell share per slice, the null slice included."""
    columns = list(columns or [c for c in df.columns if c != slice_column])
    return missing_overall(df, [slice_column], columns).withColumnRenamed(slice_column, "slice")


def top(df: DataFrame, k: int, value: str, *ties: str, ascending: bool = False) -> DataFrame:
    """The k best rows of a metric; ties are broken by name so that results are repeatable."""
    first = F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value)
    return df.orderBy(first, *[F.asc(t) for t in ties]).limit(k)


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows with values as text; long texts by their digest."""
    view = df.select(*[
        (F.to_json(F.struct(col(c))) if is_nested(df.schema[c].dataType)
         else col(c).cast("string")).alias(c) for c in columns])
    shortened = view.select(*[
        F.when(F.length(col(c)) > 64, F.concat(F.lit("sha256:"), F.sha2(col(c), 256))).otherwise(col(c)).alias(c) for c in columns])
    return shortened.unpivot([], [col(c) for c in columns], "column", "value").filter(F.col("value").isNotNull())


def column_profile(df: DataFrame, roles: Roles = Roles(), approx: bool = False) -> DataFrame:
    """Data card: type, missing rate, distinct values, role and three sample values per column.

    Exact distinct counts come from one shuffle of (column, value); ``approx`` keeps everything in a
    single scan with HyperLogLog sketches instead.
    """
    missing = missing_by_column(df)
    if approx:
        sketch = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in df.columns])
        distinct = sketch.unpivot([], [col(c) for c in df.columns], "column", "distinct_values")
        distinct = distinct.withColumn("samples", F.lit(None).cast("array<string>"))
    else:
        values = value_counts(_texts(df, df.columns), ["column"])
        first = Window.partitionBy("column").orderBy("value")
        samples = (values.withColumn("_r", F.row_number().over(first)).filter("_r <= 3")
                   .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples")))
        distinct = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")).join(
            F.broadcast(samples), "column")
    named = {c: "id" for c in roles.ids} | {c: "group" for c in roles.groups}
    named |= {roles.label: "label", roles.split: "split", roles.time: "time"}
    role = F.lit(None).cast("string")
    for name, kind in named.items():
        if name:
            role = F.when(F.col("column") == name, F.lit(kind)).otherwise(role)
    types = column_types(df)
    return (types.join(F.broadcast(missing), "column").join(F.broadcast(distinct), "column", "left")
            .select("column", "type", "missing_rate",
                    F.coalesce("distinct_values", F.lit(0)).cast("bigint").alias("distinct_values"),
                    role.alias("role"), "samples"))


def constant_flags(df: DataFrame) -> list[Column]:
    """For each column an aggregate that tells whether it has at most one value, missing counted as a value."""
    aggregates = []
    for f in df.schema:
        value = F.to_json(F.struct(col(f.name))) if is_nested(f.dataType) else col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            value = value.cast("int")
        nulls = F.sum(missing_flag(df, f.name))
        same = (nulls == 0) & (F.min(value) == F.max(value))
        aggregates.append(F.coalesce((nulls == F.count(F.lit(1))) | same, F.lit(True)))
    return aggregates


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, missing counted as a value; no distinct needed."""
    row = df.agg(*[flag.alias(c) for c, flag in zip(df.columns, constant_flags(df), strict=True)])
    return row.unpivot([], [col(c) for c in df.columns], "column", "constant")


def schema_consistency(df: DataFrame) -> DataFrame:
    """Row count, column count and constant columns of a table."""
    constants = constant_columns(df)
    listed = constants.agg(
        F.count(F.lit(1)).alias("num_cols"), F.sum(F.col("constant").cast("bigint")).alias("num_constant"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("constant"), F.col("column")))), ",")
        .alias("constant_columns"))
    rows = df.agg(F.count(F.lit(1)).alias("num_rows"))
    return rows.select("num_rows", listed.select("num_cols").scalar().alias("num_cols"),
                       listed.select("num_constant").scalar().alias("num_constant"),
                       listed.select("constant_columns").scalar().alias("constant_columns"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Most frequent values of a column, missing included."""
    counts = df.groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def describe(df: DataFrame, column: str) -> DataFrame:
    x = as_double(df, column)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width histogram with min(30, floor(sqrt(n)) + 5) bins; the last bin is closed."""
    stats = describe(df, column)
    bins = F.least(F.lit(30), F.floor(F.sqrt("n")).cast("int") + 5)
    frame = stats.select("min", "max", bins.alias("bins"))
    low, high, k = (frame.select(c).scalar() for c in ("min", "max", "bins"))
    x = as_double(df, column)
    slot = F.when(high > low, F.least(F.floor((x - low) / (high - low) * k).cast("int"), k - 1)).otherwise(0)
    return (df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("bin").cast("bigint").alias("bin"), (low + (high - low) * F.col("bin") / k).alias("low_edge"), "n"))


def row_completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean share of present fields per row."""
    columns = list(columns or df.columns)
    present = sum((1 - missing_flag(df, c) for c in columns), F.lit(0)) / F.lit(float(len(columns)))
    return df.agg(F.avg(present).alias("completeness"))


def field_completeness(df: DataFrame, worst: int = 5) -> DataFrame:
    """The fields that are present least often."""
    rates = missing_by_column(df).select("column", (1 - F.col("missing_rate")).alias("completeness"))
    return top(rates, worst, "completeness", "column", ascending=True)


def coverage(df: DataFrame, columns: Sequence[str], require: str = "any") -> DataFrame:
    """Share of rows with any (provenance) or all (traceability) of the columns present."""
    flags = [missing_flag(df, c) == 0 for c in columns]
    met = flags[0]
    for flag in flags[1:]:
        met = (met | flag) if require == "any" else (met & flag)
    return df.agg(F.avg(met.cast("double")).alias("coverage_rate"))


def split_coverage(df: DataFrame, split: str) -> DataFrame:
    """Rows per split, missing included, with the overall share of assigned rows."""
    counts = df.groupBy(col(split).cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    assigned = F.sum(F.when(F.col("split").isNotNull(), F.col("n")).otherwise(0))
    framed = with_totals(counts, _assigned=assigned, _rows=F.sum("n"))
    return framed.select("split", "n", (F.col("_assigned") / F.col("_rows")).alias("split_coverage"))


def entity_counts(df: DataFrame, entities: Sequence[str], k: int | None = 10) -> DataFrame:
    """Largest entities by rows; all of them, in no order, without ``k``."""
    counts = df.groupBy(*entities).agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), *[F.asc_nulls_first(e) for e in entities]).limit(k)


def numeric_variances(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k columns of largest sample variance, from one scan."""
    row = df.agg(*[F.var_samp(as_double(df, c)).alias(c) for c in columns])
    return top(row.unpivot([], [col(c) for c in columns], "column", "variance"), k, "variance", "column")


def task_type(df: DataFrame, label: str, counts: DataFrame | None = None) -> DataFrame:
    """Learning task suggested by a label column; ``counts`` (label, n) saves the scan where it is there already."""
    numeric = F.lit(is_numeric(df.schema[label].dataType))
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    stats = counts.agg(F.count("label").alias("distinct_labels"), F.sum("n").alias("rows"))
    d, rows = F.col("distinct_labels"), F.col("rows")
    return stats.select(
        d, F.when(numeric & (d > 20) & (d > 0.05 * F.greatest(F.lit(1), rows)), "Regression")
        .when(d == 2, "Binary classification")
        .when((d > 2) & (d <= 50), "Multi-class classification")
        .otherwise(F.concat(F.lit("Label selected (card="), d.cast("string"), F.lit(")"))).alias("task_type"))


def sample_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Adds a composite sample id; a missing part reads ``<missing>``."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("<missing>")) for c in ids]
    return df.withColumn("sample_id", F.concat_ws(" | ", *parts))
