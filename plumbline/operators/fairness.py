"""Group representation, missingness and outcome disparities.

All checks of one label start from the same small cube: counts by (group column, group, label).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col, missing_flag
from plumbline.operators.distribution import with_totals
from plumbline.operators.quality import entropy_of_shares, jsd_vs_uniform


def group_cube(df: DataFrame, groups: Sequence[str], label: str | None = None,
               by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts per (by, group column, group, label); the missing group and label are kept. A row stands for ``weight`` rows."""
    pairs = F.array(*[F.struct(F.lit(g).alias("group_column"), col(g).cast("string").alias("grp")) for g in groups])
    value = col(label).cast("string") if label else F.lit(None).cast("string")
    cells = df.select(*by, F.explode(pairs).alias("p"), value.alias("label"), *([col(weight).alias("n")] if weight else []))
    return cells.groupBy(*by, "p.group_column", "p.grp", "label").agg((F.sum("n") if weight else F.count(F.lit(1))).alias("n"))


def group_shares(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = cube.groupBy(*by, "group_column", "grp").agg(F.sum("n").alias("n"))
    return with_totals(counts, [*by, "group_column"], _all=F.sum("n")).select(
        *by, "group_column", "grp", "n", (F.col("n") / F.col("_all")).alias("share"))


def representation(cube: DataFrame) -> DataFrame:
    """Groups, smallest and largest share, support, ratio, divergence and entropy per group column."""
    shares = group_shares(cube)
    stats = shares.groupBy("group_column").agg(
        F.count(F.lit(1)).alias("num_groups"), F.min("share").alias("min_group_share"),
        F.max("share").alias("max_group_share"), F.min("n").alias("min_subgroup_support"))
    known = with_totals(shares.filter(F.col("grp").isNotNull()), ["group_column"], _s=F.sum("share"))
    jsd = jsd_vs_uniform(known.withColumn("share", F.col("share") / F.col("_s")), ["group_column"])
    entropy = entropy_of_shares(shares, ["group_column"]).select("group_column", "entropy", "normalized_entropy")
    joined = stats.join(F.broadcast(jsd), "group_column", "left").join(F.broadcast(entropy), "group_column")
    many = F.col("num_groups") >= 2
    return joined.select(
        "group_column", "num_groups", "min_group_share", "max_group_share", "min_subgroup_support",
        F.when(many, F.col("max_group_share") / F.greatest(F.col("min_group_share"), F.lit(1e-12)))
        .alias("max_representation_disparity"),
        F.when(many, F.col("jsd")).alias("jsd_vs_uniform"),
        F.col("entropy").alias("coverage_entropy"), F.col("normalized_entropy").alias("coverage_normalized_entropy"))


def representation_ratios(cube: DataFrame, k: int = 10) -> DataFrame:
    """Largest groups with their share and its ratio to an equal share."""
    shares = with_totals(group_shares(cube), ["group_column"], _k=F.count(F.lit(1)))
    return (shares.select("group_column", "grp", "n", "share", (F.col("share") * F.col("_k")).alias("ratio"))
            .orderBy(F.desc("n"), "group_column", F.asc_nulls_first("grp")).limit(k))


def missing_disparity(df: DataFrame, groups: Sequence[str], columns: Sequence[str] | None = None,
                      k: int | None = 10) -> DataFrame:
    """Largest differences between group missing rates per column, the missing group included."""
    columns = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(g).alias("group_column"), col(g).cast("string").alias("grp")) for g in groups])
    flags = df.select(F.explode(pairs).alias("_p"), *[missing_flag(df, c).alias(f"m{i}") for i, c in enumerate(columns)])
    rates = flags.groupBy("_p.group_column", "_p.grp").agg(*[F.avg(f"m{i}").alias(f"m{i}") for i in range(len(columns))])
    spread = rates.groupBy("group_column").agg(
        F.count(F.lit(1)).alias("num_groups"),
        *[(F.max(f"m{i}") - F.min(f"m{i}")).alias(c) for i, c in enumerate(columns)]).filter("num_groups >= 2")
    long = spread.unpivot([F.col("group_column")], [col(c) for c in columns], "column", "disparity")
    return long if k is None else long.orderBy(F.desc("disparity"), "group_column", "column").limit(k)


def label_missing_by_group(cube: DataFrame) -> DataFrame:
    return cube.groupBy("group_column", "grp").agg(
        (F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("label_missing_rate"))


def positive_rates(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rate of the larger of two label values per group; the missing group is left out.

    Empty unless the label has exactly two values and the column at least two groups.
    """
    keys = [*by, "group_column"]
    known = cube.filter(F.col("label").isNotNull())
    number = F.expr("try_cast(label AS double)")  # labels that are numbers are compared as such: 10 is larger than 9
    order = F.struct(number, col("label"))
    framed = with_totals(known, keys, _high=F.max(order)["label"], _odd=F.count_distinct("label"))
    rates = framed.filter(F.col("grp").isNotNull() & (F.col("_odd") == 2)).groupBy(*keys, "grp").agg(
        (F.sum(F.when(F.col("label") == F.col("_high"), F.col("n")).otherwise(0)) / F.sum("n")).alias("positive_rate"),
        F.sum("n").alias("n"))
    return with_totals(rates, keys, _k=F.count(F.lit(1))).filter("_k >= 2").drop("_k")


def positive_rate_disparity(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return positive_rates(cube, by).groupBy(*by, "group_column").agg(
        (F.max("positive_rate") - F.min("positive_rate")).alias("positive_rate_disparity"))


def parity_gaps(cube: DataFrame) -> DataFrame:
    """Per label the spread of its share over the groups; a group without the label counts as 0."""
    known = cube.filter(F.col("grp").isNotNull())
    group_totals = with_totals(known, ["group_column", "grp"], _all=F.sum(
        F.when(F.col("label").isNotNull(), F.col("n"))))
    shares = group_totals.filter(F.col("label").isNotNull()).select(
        "group_column", "grp", "label", (F.col("n") / F.col("_all")).alias("share"))
    sizes = known.groupBy("group_column").agg(F.count_distinct("grp").alias("_groups"))
    spread = shares.groupBy("group_column", "label").agg(
        F.max("share").alias("_hi"), F.min("share").alias("_lo"), F.count(F.lit(1)).alias("_k"))
    joined = spread.join(F.broadcast(sizes), "group_column").filter("_groups >= 2")
    low = F.when(F.col("_k") < F.col("_groups"), 0.0).otherwise(F.col("_lo"))
    return joined.select("group_column", "label", (F.col("_hi") - low).alias("parity_gap"))


def label_distribution(cube: DataFrame) -> DataFrame:
    known = cube.filter(F.col("grp").isNotNull() & F.col("label").isNotNull())
    return with_totals(known, ["group_column", "grp"], _all=F.sum("n")).select(
        "group_column", "grp", "label", (F.col("n") / F.col("_all")).alias("share"))


def mutual_information(cube: DataFrame, minimum: int = 10) -> DataFrame:
    """Mutual information (nats) between group and label, for more than ``minimum`` complete rows."""
    joint = cube.filter(F.col("grp").isNotNull() & F.col("label").isNotNull())
    framed = with_totals(joint, ["group_column", "grp"], _g=F.sum("n"))
    framed = with_totals(framed, ["group_column", "label"], _l=F.sum("n"))
    framed = with_totals(framed, ["group_column"], _n=F.sum("n")).filter(F.col("_n") > minimum)
    n, total = F.col("n"), F.col("_n").cast("double")
    return framed.groupBy("group_column").agg(
        F.sum(n / total * F.ln(n * total / (F.col("_g") * F.col("_l")))).alias("mutual_information"),
        F.max("_n").alias("rows"))


def intersections(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts of every combination of group values that occurs."""
    parts = [F.coalesce(col(g).cast("string"), F.lit("<missing>")) for g in groups]
    return df.groupBy(F.concat_ws(" × ", *parts).alias("subgroup")).agg(F.count(F.lit(1)).alias("n"))


def intersectional_coverage(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    counts = intersections(df, groups)
    shares = with_totals(counts, _all=F.sum("n")).withColumn("share", F.col("n") / F.col("_all"))
    return entropy_of_shares(shares).select(
        F.col("num_classes").alias("num_subgroups"), F.col("min_class_count").alias("min_subgroup_support"),
        F.col("entropy").alias("coverage_entropy"), F.col("normalized_entropy").alias("coverage_normalized_entropy"))


def smallest_intersections(df: DataFrame, groups: Sequence[str], k: int = 10) -> DataFrame:
    return intersections(df, groups).orderBy("n", "subgroup").limit(k)
