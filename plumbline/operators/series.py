"""Time-axis checks and window statistics that stay parallel inside one long series.

A window partitioned by entity sorts a whole entity in one task, which fails when one entity holds a
third of the rows. Two devices avoid that and stay exact:

* ``steps`` looks back inside intervals of the order of (entity, time) and takes the last point of the preceding interval from
  the small table of interval ends;
* ``positions`` numbers the rows of an entity by adding the counts of earlier periods, and
  ``chunks`` cuts the numbered series into pieces that carry enough preceding rows as context for
  any trailing window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import as_double, col, seconds_of, timestamp_of
from plumbline.operators.distribution import (
    in_intervals, quantiles, running_totals, value_counts, with_totals)


AXIS_BLOCK = 65_536


def _null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return same


def time_profile(df: DataFrame, time: str) -> DataFrame:
    """Parse success and covered range of the time column."""
    ts = timestamp_of(df, time)
    return df.agg(
        F.avg(ts.isNotNull().cast("double")).alias("parse_ok_rate"),
        F.sum(ts.isNull().cast("bigint")).alias("num_invalid"),
        F.min(ts).alias("min_time"), F.max(ts).alias("max_time"),
        ((seconds_of(F.max(ts)) - seconds_of(F.min(ts))) / 86400.0).alias("span_days"))


def points(df: DataFrame, time: str, entities: Sequence[str] = ()) -> DataFrame:
    """Distinct (entity, time) points with their row counts; repeats collapse map-side."""
    ts = timestamp_of(df, time)
    return (df.filter(ts.isNotNull()).groupBy(*[col(e) for e in entities], ts.alias("ts"))
            .agg(F.count(F.lit(1)).alias("n")))


def duplicate_timestamps(df: DataFrame, time: str, entities: Sequence[str] = ()) -> DataFrame:
    return points(df, time, entities).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"),
        (F.sum(F.col("n") - 1) / F.nullif(F.sum("n"), F.lit(0))).alias("duplicate_rate"))


def steps(df: DataFrame, time: str, entities: Sequence[str] = (), across_entities: bool = False) -> DataFrame:
    """Seconds between consecutive records as (step, n) counts.

    Steps run within an entity; ``across_entities`` also counts the (often negative) step from the
    last record of one entity to the first of the next in entity order. All points stand in one order of (entity, time) that is cut into
    as many intervals as there are tasks, whether they belong to one series or to millions; each interval only
    learns the last point of the one before it.
    """
    entities = list(entities)
    pts = points(df, time, entities)
    placed = in_intervals(pts.select(F.struct(*entities, "ts").alias("e"), "n"), [], "e")
    looked = placed.withColumn("_prev", F.lag("e").over(Window.partitionBy("_slot").orderBy("e")))
    ends = placed.groupBy("_slot").agg(F.max("e").alias("_last"))
    ends = ends.select("_slot", F.lag("_last").over(Window.orderBy("_slot")).alias("_earlier"))  # a row for each interval
    prev = F.coalesce("_prev", "_earlier")
    found = looked.join(F.broadcast(ends), "_slot").select("e", "n", prev.alias("p")).filter("p is not null")
    if not across_entities:
        for name in entities:
            found = found.filter(F.col("e")[name].eqNullSafe(F.col("p")[name]))
    gaps = found.select((seconds_of(F.col("e.ts")) - seconds_of(F.col("p.ts"))).alias("step"), F.lit(1).alias("n"))
    repeats = pts.filter("n > 1").select(F.lit(0.0).alias("step"), (F.col("n") - 1).alias("n"))
    return gaps.unionByName(repeats).groupBy("step").agg(F.sum("n").alias("n"))


def cadence(step_counts: DataFrame, minimum: int = 50) -> DataFrame:
    """Median, p10, p90 and irregularity of positive steps; null below ``minimum`` steps."""
    positive = step_counts.filter("step > 0").withColumn("key", F.lit(1))
    found = quantiles(positive, ["key"], {"median": 0.5, "p10": 0.1, "p90": 0.9}, value="step")
    enough = F.col("n_values") >= minimum
    return found.select(
        F.col("n_values").alias("num_steps"),
        *[F.when(enough, F.col(c)).alias(f"{c}_seconds") for c in ("median", "p10", "p90")],
        F.when(enough, (F.col("p90") - F.col("p10")) / F.greatest(F.lit(1e-9), F.col("median")))
        .alias("irregularity_ratio"))


def gaps(step_counts: DataFrame) -> DataFrame:
    """Median, p95 and largest step, and the share of steps above ten medians."""
    keyed = step_counts.withColumn("key", F.lit(1))
    found = quantiles(keyed, ["key"], {"median": 0.5, "p95": 0.95}, value="step")
    joined = keyed.join(F.broadcast(found), "key")
    large = F.sum(F.when(F.col("step") > 10 * F.col("median"), F.col("n")).otherwise(0)) / F.sum("n")
    return joined.groupBy(F.col("median").alias("median_gap_seconds"), F.col("p95").alias("p95_gap_seconds")).agg(
        F.max("step").alias("largest_gap_seconds"), large.alias("_rate")).select(
        "median_gap_seconds", "p95_gap_seconds", "largest_gap_seconds",
        F.when(F.col("median_gap_seconds") > 0, F.col("_rate")).alias("large_gap_rate"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column) -> DataFrame:
    """Adds ``_pos``, the 1-based rank of a row in its series.

    ``period`` must not decrease along ``order``; it bounds how much of a series one task sorts.
    """
    keys = list(keys)
    tagged = df.withColumn("_period", period)
    inside = Window.partitionBy(*keys, "_period").orderBy(*order)
    sizes = tagged.groupBy(*keys, "_period").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_period")
    sizes = sizes.select(*keys, "_period", (F.sum("_size").over(running) - F.col("_size")).alias("_offset"))
    numbered = tagged.withColumn("_row", F.row_number().over(inside))
    joined = numbered.alias("a").join(sizes.alias("b"), _null_safe("a", "b", [*keys, "_period"]))
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns],
                         (F.col("a._row") + F.col("b._offset")).alias("_pos"))


def chunks(numbered: DataFrame, size: int, context: int) -> DataFrame:
    """Adds ``_chunk`` and ``_context``: each chunk also receives the ``context`` rows before it."""
    if context > size:
        raise ValueError("context must fit into one chunk")
    home = F.floor((F.col("_pos") - 1) / size)
    spill = (F.col("_pos") - 1) % size >= size - context
    homes = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    out = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    return out.withColumn("_context", F.col("_chunk") != F.col("_home")).drop("_home")


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column, window: int,
             **exprs: Column) -> DataFrame:
    """Adds aggregates over the last ``window`` rows (the current one included) of each series."""
    size = max(4096, 8 * window)
    pieces = chunks(positions(df, keys, order, period), size, window - 1)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(window - 1), 0)
    out = pieces.withColumns({name: expr.over(frame) for name, expr in exprs.items()})
    return out.filter(~F.col("_context")).drop("_chunk", "_context")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column, value: str,
                 window: int) -> DataFrame:
    return trailing(df, keys, order, period, window, rolling_mean=F.avg(col(value)))


def budget_threshold(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column, value: str,
                     window: int, budget: float) -> DataFrame:
    """Trailing quantile of ``value`` that a review budget corresponds to, and who exceeds it."""
    level = 1.0 - min(max(budget, 0.0), 1.0)
    out = trailing(df, keys, order, period, window, threshold=F.percentile(col(value), level))
    return out.withColumn("query", col(value) > F.col("threshold"))


def two_tier_routes(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column, value: str,
                    window: int, human: float, oracle: float) -> DataFrame:
    """Routes each record to a human above tau2, to the oracle above tau1 <= tau2, else to nobody."""
    upper = 1.0 - min(max(human, 0.0), 1.0)
    lower = 1.0 - min(max(human + oracle, 0.0), 1.0)
    out = trailing(df, keys, order, period, window,
                   tau2=F.percentile(col(value), upper), _t1=F.percentile(col(value), lower))
    out = out.withColumn("tau1", F.least("_t1", "tau2")).drop("_t1")
    x = col(value)
    return out.withColumn("route", F.when(x > F.col("tau2"), "human").when(x > F.col("tau1"), "oracle")
                          .otherwise("none"))


def exponential_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column, value: str,
                        alpha: float = 0.12) -> DataFrame:
    """Adds ``ema``: starts at the first value, then (1 - alpha) * ema + alpha * value.

    Inside a chunk the recursion is a running sum of values weighted by growing powers; between chunks
    only the end of the previous chunk matters, because a chunk is long enough for the decay over a
    whole one to lie below double precision.
    """
    rate = -math.log(1.0 - alpha)
    size = max(2, math.ceil(300.0 / rate))
    pieces = chunks(positions(df, keys, order, period), size, 0)
    place = ((F.col("_pos") - 1) % size).cast("double")
    weight = F.when(F.col("_pos") == 1, 1.0).otherwise(alpha) * F.exp(F.lit(rate) * place)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    summed = pieces.withColumn("_own", F.sum(col(value) * weight).over(inside) * F.exp(F.lit(-rate) * place))
    ends = summed.groupBy(*keys, "_chunk").agg(F.max_by("_own", "_pos").alias("_carry"))
    ends = ends.withColumn("_chunk", F.col("_chunk") + 1)
    joined = summed.alias("a").join(ends.alias("b"), _null_safe("a", "b", [*keys, "_chunk"]), "left")
    decayed = F.coalesce(F.col("b._carry"), F.lit(0.0)) * F.exp(F.lit(-rate) * (((F.col("a._pos") - 1) % size) + 1))
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], F.col("a._pos").alias("_pos"),
                         (F.col("a._own") + decayed).alias("ema"))


def last_per_step(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each step; ``order`` breaks ties."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def max_per_step(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(col(value)).alias(value))


def cumulative_on_axis(df: DataFrame, key: str, step: str, value: str, last_step: Column | int) -> DataFrame:
    """Running total of the per-step maximum on the dense axis 0..last_step for each key."""
    per_step = max_per_step(df, [key, step], value)
    # first the blocks of the axis, then the steps of a block: no row holds a whole axis
    last = (last_step if isinstance(last_step, Column) else F.lit(last_step)).cast("bigint")
    blocks = df.select(key).distinct().select(key, last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / AXIS_BLOCK))).alias("_b"))
    ends = F.least(F.col("_last"), F.col("_b") * AXIS_BLOCK + AXIS_BLOCK - 1)
    axis = blocks.select(key, F.explode(F.sequence(F.col("_b") * AXIS_BLOCK, ends)).alias(step))
    dense = axis.join(per_step, [key, step], "left").select(key, step, F.coalesce(value, F.lit(0)).alias("n"))
    return running_totals(dense, [key], step, few_keys=False).select(key, step, F.col("cum_n").alias("cumulative"))


def binned_rate(df: DataFrame, keys: Sequence[str], step: str, flag: Column, width: int) -> DataFrame:
    """Mean of a 0/1 flag per fixed-width bin of an integer step."""
    return df.groupBy(*keys, (F.floor(F.col(step) / width) * width).alias("bin")).agg(
        F.avg(flag.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def z_scores(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the z-score within the group (population deviation, 0 when constant)."""
    x = as_double(df, value)
    framed = with_totals(df, group, _mean=F.avg(x), _std=F.stddev_pop(x))
    z = F.when(F.col("_std") > 0, (x - F.col("_mean")) / F.col("_std")).otherwise(F.when(x.isNotNull(), 0.0))
    return framed.withColumn(out, z).drop("_mean", "_std")


def value_counts_of(df: DataFrame, value: str) -> DataFrame:
    """Counts of one numeric column under a constant key, ready for ``quantiles``."""
    frame = df.select(F.lit(1).alias("key"), as_double(df, value).alias("value"))
    return value_counts(frame.filter(F.col("value").isNotNull()), ["key"])
