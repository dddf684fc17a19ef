"""Data-corruption transforms with known severity.

Every transform takes the severity as a number or a column and an optional ``where`` condition, so a
frame that carries many scenarios side by side is corrupted in one pass. Draws come from row keys:
the same row is hit whatever the partitioning, and a larger severity hits a superset of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, col, seconds_of, timestamp_of, uniform
from plumbline.operators.distribution import bounded_rows, quantiles
from plumbline.operators.profile import numeric_variances
from plumbline.operators.series import value_counts_of

Severity = float | Column
Draw = Callable[[int], Column]


def keyed_draw(seed: int, *keys: str) -> Draw:
    """Independent uniform draws per salt from the row key."""
    return lambda salt: uniform(seed * 1000003 + salt, *[col(k) for k in keys])


def _hit(draw: Column, severity: Severity, where: Column | None) -> Column:
    hit = draw < severity
    return hit if where is None else hit & where


def missingness(df: DataFrame, columns: Sequence[str], severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Nulls a share of the cells of the columns."""
    return df.withColumns({c: F.when(~F.coalesce(_hit(draw(1 + i), severity, where), F.lit(False)), col(c))
                           for i, c in enumerate(columns)})


def duplicates(df: DataFrame, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Appends exact copies of a share of the rows."""
    return df.unionByName(df.filter(_hit(draw(101), severity, where)))


def repeated_duplicates(df: DataFrame, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Appends copies drawn with replacement: a row may come back several times (Poisson counts)."""
    u = draw(102)
    k, term, total = 0, F.exp(-(severity if isinstance(severity, Column) else F.lit(float(severity)))), None
    times, mass = F.lit(0), term
    rate = severity if isinstance(severity, Column) else F.lit(float(severity))
    for k in range(1, 9):
        times = times + (u >= mass).cast("int")
        term = term * rate / k
        mass = mass + term
    chosen = df.withColumn("_times", times if where is None else F.when(where, times).otherwise(0))
    copies = chosen.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return df.unionByName(copies.drop("_times", "_copy"))


def split_leakage(df: DataFrame, split: str, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Appends copies of a share of the rows under another split."""
    leaked = df.filter(_hit(draw(103), severity, where))
    return df.unionByName(leaked.withColumn(split, F.when(col(split) == "test", "train").otherwise("test")))


def late_cutoff(df: DataFrame, time: str, share: float = 0.75) -> float:
    """Seconds from which the last part of the time axis starts (exact quantile)."""
    return cutoffs(df, time, share)[0]


def cutoffs(df: DataFrame, time: str, *shares: float) -> list[float]:
    """The seconds up to which each share of the time axis lies (exact quantiles), from one count of times."""
    seconds = df.select(seconds_of(timestamp_of(df, time)).alias("s"))
    points = {f"q{i}": share for i, share in enumerate(shares)}
    row = bounded_rows(quantiles(value_counts_of(seconds, "s"), ["key"], points), 1)[0]
    return [row[q] for q in points]


def drift(df: DataFrame, time: str, shifts: dict[str, float], severity: Severity, cutoff: float,
          where: Column | None = None) -> DataFrame:
    """Shifts numeric columns by severity * amount in the last part of the time axis."""
    late = seconds_of(timestamp_of(df, time)) >= cutoff
    late = late if where is None else late & where
    return df.withColumns({c: F.when(late, col(c) + severity * F.lit(float(a))).otherwise(col(c)) for c, a in shifts.items()})


def scaled_drift(df: DataFrame, time: str, columns: Sequence[str], severity: Severity, cutoff: float) -> DataFrame:
    """Drift of three standard deviations times severity."""
    return drift(df, time, {c: 3.0 * s for c, s in deviations(df, columns, F.stddev_samp).items()}, severity, cutoff)


def deviations(df: DataFrame, columns: Sequence[str], how=F.stddev_pop) -> dict[str, float]:
    """Standard deviation per column, 1 where it is 0 or missing; fitted in one scan."""
    row = df.agg(*[how(as_double(df, c)).alias(c) for c in columns]).first()
    return {c: (row[c] or 1.0) for c in columns}


def personal_data(df: DataFrame, text: str, key: str, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Writes an e-mail address into a share of the texts."""
    return df.withColumn(text, F.when(F.coalesce(_hit(draw(105), severity, where), F.lit(False)), planted_text(key)).otherwise(col(text)))


def planted_text(key: str) -> Column:
    """The text with an e-mail address that a row of that key gets."""
    return F.concat(F.lit("contact operator_"), col(key), F.lit("@example.com"))


def group_bias(df: DataFrame, label: str, advantaged: Column, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Redraws labels at 0.5 + severity inside and 0.5 - severity outside the advantaged group."""
    u = draw(106)
    sev = severity if isinstance(severity, Column) else F.lit(float(severity))
    high, low = F.least(F.lit(0.95), 0.5 + sev), F.greatest(F.lit(0.05), 0.5 - sev)
    drawn = F.when(advantaged, (u < high).cast("int")).otherwise((u < low).cast("int"))
    active = (sev > 0) if where is None else (sev > 0) & where
    return df.withColumn(label, F.when(active, drawn).otherwise(col(label)))


def outliers(df: DataFrame, columns: Sequence[str], severity: Severity, draw: Draw, magnitude: float = 15.0,
             where: Column | None = None) -> DataFrame:
    """Moves a share of the rows by +-magnitude standard deviations in every column."""
    scale = deviations(df, columns)
    hit = F.coalesce(_hit(draw(107), severity, where), F.lit(False))
    return df.withColumns({
        c: F.when(hit, col(c) + F.when(draw(200 + i) < 0.5, -1.0).otherwise(1.0) * (magnitude * scale[c])).otherwise(col(c))
        for i, c in enumerate(columns)})


def label_noise(df: DataFrame, label: str, severity: Severity, draw: Draw, where: Column | None = None) -> DataFrame:
    """Flips a share of the 0/1 labels."""
    hit = F.coalesce(_hit(draw(108), severity, where), F.lit(False))
    return df.withColumn(label, F.when(hit, 1 - col(label)).otherwise(col(label)))


def combined(df: DataFrame, columns: Sequence[str], severity: float, draw: Draw) -> DataFrame:
    """Missing cells, then outliers at half severity, then duplicates."""
    out = missingness(df, columns, severity, draw)
    return repeated_duplicates(outliers(out, columns, severity * 0.5, draw), severity, draw)


def sensor_table(spark, n_rows: int, seed: int = 7) -> DataFrame:
    """Clean sensor readings of three plants over four monthly slices."""
    i = F.col("id")
    block = max(1, -(-n_rows // 4))
    quarter = F.least(F.lit(3), F.floor(i * 4 / n_rows)).cast("int")
    u = F.rand(seed)
    site = F.when(u < 0.34, "plant_a").when(u < 0.67, "plant_b").otherwise("plant_c")
    shift = F.when(F.col("site") == "plant_a", -2.0).when(F.col("site") == "plant_b", 0.0).otherwise(2.0)
    v = F.rand(seed + 1)
    out = spark.range(n_rows).withColumn("site", site).select(
        F.format_string("sample_%06d", i).alias("sample_id"),
        F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), quarter).cast("timestamp")
                      + F.make_dt_interval(hours=F.pmod(i, F.lit(block)).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(v < 0.70, "train").when(v < 0.85, "validation").otherwise("test").alias("split"), "site",
        (54.0 + shift + 7.5 * F.randn(seed + 2)).alias("sensor_temp"),
        (100.0 - shift + 12.0 * F.randn(seed + 3)).alias("sensor_pressure"),
        (-0.7 * F.ln((1 - F.rand(seed + 4)) * (1 - F.rand(seed + 5)))).alias("vibration_rms"),
        (45.0 + 9.0 * F.randn(seed + 6)).alias("humidity"), F.lit("normal").alias("operator_note"))
    logit = -2.1 + 0.025 * F.col("sensor_temp") + 0.008 * F.col("sensor_pressure")
    chance = F.greatest(F.lit(0.02), F.least(F.lit(0.98), 1.0 / (1.0 + F.exp(-logit))))
    return out.withColumn("target", (F.rand(seed + 7) < chance).cast("int"))


def prepare(df: DataFrame, label: str, key: str, max_features: int = 50, max_rows_per_class: int | None = None, seed: int = 0) -> DataFrame:
    """Model-ready rows: labelled, majority class against the rest, most variable numeric features."""
    from plumbline.functions.columns import numeric_columns
    from plumbline.operators.security import stratified_sample
    counts = df.filter(col(label).isNotNull()).groupBy(col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "c").limit(1).first()
    major = first["c"] if first is not None else None  # without labelled rows nothing is left either way
    features = numeric_columns(df, [label, key])
    if len(features) > max_features:
        features = [r["column"] for r in bounded_rows(numeric_variances(df, features, max_features), max_features)]
    out = df.filter(col(label).isNotNull()).select(
        key, *[as_double(df, c).alias(c) for c in features], (col(label) == major).cast("int").alias("target"))
    return out if max_rows_per_class is None else stratified_sample(out, "target", [uniform(seed, col(key)), col(key)], max_rows_per_class)
