"""Label statistics, class balance, rater agreement and format checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, col, missing_flag, ratio
from plumbline.operators.distribution import with_totals

def shares(df: DataFrame, column: str, drop_missing: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Count and share per value: rows (by, value, n, share)."""
    counts = df.groupBy(*by, col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if drop_missing:
        counts = counts.filter(F.col("value").isNotNull())
    return with_totals(counts, by, _all=F.sum("n")).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def entropy_of_shares(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entropy (nats), normalised entropy and effective number from a (value, n, share) frame."""
    sums = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_classes"),
        F.sum(-F.col("share") * F.ln("share")).alias("_h"),
        F.min("n").alias("min_class_count"), F.max("n").alias("max_class_count"))
    single = F.col("num_classes") <= 1
    return sums.select(
        *by, "num_classes",
        F.when(single, 0.0).otherwise(F.col("_h")).alias("entropy"),
        F.when(single, 1.0).otherwise(F.col("_h") / F.ln(F.col("num_classes").cast("double")))
        .alias("normalized_entropy"),
        F.when(single, F.col("num_classes").cast("double")).otherwise(F.exp("_h")).alias("effective_number"),
        "min_class_count", "max_class_count")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return entropy_of_shares(shares(df, label))


def label_stats(df: DataFrame, label: str, max_classes: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """Missing rate and cardinality of a label, with class shares when it has 2 to 50 classes; ``counts`` (label, n) saves the scan."""
    if counts is None:
        counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(F.col("label").cast("string").alias("label")).agg(F.sum("n").alias("n"))
    known = F.when(F.col("label").isNotNull(), F.col("n"))
    framed = with_totals(counts, label_cardinality=F.count("label"), _rows=F.sum("n"), _known=F.sum(known))
    k = F.col("label_cardinality")
    return (framed.filter(F.col("label").isNotNull())
            .select("label", "n", "label_cardinality",
                    (1 - F.col("_known") / F.col("_rows")).alias("label_missing_rate"),
                    F.when((k >= 2) & (k <= max_classes), F.col("n") / F.col("_known")).alias("share"))
            .orderBy(F.desc("n"), "label").limit(10))


def jsd_vs_uniform(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon divergence (nats) between a (value, share) frame and the uniform shares."""
    framed = with_totals(frame, by, _k=F.count(F.lit(1))).withColumn("_q", 1.0 / F.col("_k"))
    p, q = F.col("share"), F.col("_q")
    m = (p + q) / 2
    part = F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + q * F.ln(q / m)
    return framed.groupBy(*by).agg((F.sum(part) / 2).alias("jsd"), F.count(F.lit(1)).alias("bins"))


def condition_coverage(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Bins, worst-bin share and divergence from uniform for each condition column."""
    long = df.select(*[col(c).cast("string").alias(c) for c in conditions]).unpivot(
        [], [col(c) for c in conditions], "column", "value")
    framed = shares(long, "value", by=["column"])
    worst = framed.groupBy("column").agg(
        F.count(F.lit(1)).alias("num_bins"), F.min("share").alias("worst_bin_coverage"))
    divergence = jsd_vs_uniform(framed, ["column"])
    return worst.join(F.broadcast(divergence), "column").select(
        "column", "num_bins", "worst_bin_coverage",
        F.when(F.col("num_bins") >= 2, F.col("jsd")).alias("jsd_vs_uniform"))


def source_diversity(df: DataFrame, source: str) -> DataFrame:
    balance = class_balance(df, source)
    return balance.select(F.lit(source).alias("column"), F.col("num_classes").alias("num_sources"),
                          "entropy", "normalized_entropy", "effective_number")


def annotator_agreement(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Exact agreement among rows with any label, and disagreement over all rows."""
    texts = F.array_compact(F.array(*[col(r).cast("string") for r in raters]))
    rated = F.size(texts) > 0
    agree = F.size(F.array_distinct(texts)) <= 1
    return df.agg(
        F.sum(rated.cast("bigint")).alias("rows_with_any_label"),
        F.avg(F.when(rated, agree.cast("double"))).alias("exact_agreement_rate"),
        F.avg((rated & ~agree).cast("double")).alias("disagreement_rate"))


def cohen_kappa(df: DataFrame, raters: Sequence[str], minimum: int = 10) -> DataFrame:
    """Pairwise Cohen's kappa and its mean, from one scan of (pair, a, b) counts."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("annotator_a"), F.lit(b).alias("annotator_b"),
                 col(a).cast("string").alias("a"), col(b).cast("string").alias("b"))
        for a, b in combinations(raters, 2)])
    cells = (df.select(F.explode(pairs).alias("p")).select("p.*")
             .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
             .groupBy("annotator_a", "annotator_b", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    pair = ["annotator_a", "annotator_b"]
    totals = cells.groupBy(*pair).agg(
        F.sum("n").alias("n_items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    margin_a = cells.groupBy(*pair, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    margin_b = cells.groupBy(*pair, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = margin_a.join(margin_b, [*pair, "v"]).groupBy(*pair).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    joined = totals.join(F.broadcast(chance), pair, "left").filter(F.col("n_items") >= minimum)
    n = F.col("n_items").cast("double")
    po, pe = F.col("same") / n, F.coalesce(F.col("cross"), F.lit(0)) / (n * n)
    scored = joined.select(*pair, "n_items", ratio(po - pe, 1 - pe).alias("kappa"))
    return with_totals(scored, mean_kappa=F.avg("kappa"))


def format_conformance(df: DataFrame, extension: Column, allowed: Sequence[str]) -> DataFrame:
    """Share of allowed extensions and the counts of the others."""
    counts = df.groupBy(extension.alias("extension")).agg(F.count(F.lit(1)).alias("n"))
    fits = F.coalesce(F.col("extension").isin(*allowed), F.lit(False))
    framed = with_totals(counts, _fit=F.sum(F.when(fits, F.col("n")).otherwise(0)), _all=F.sum("n"))
    return framed.select("extension", "n", fits.alias("allowed"),
                         (F.col("_fit") / F.col("_all")).alias("format_conformance_rate"))


def numeric_range_rate(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Share of present values outside [low, high], as an aggregate expression."""
    x = as_double(df, column)
    return F.avg(F.when(x.isNotNull(), ((x < low) | (x > high)).cast("double")))


def missing_rate(df: DataFrame, column: str) -> Column:
    return F.avg(missing_flag(df, column).cast("double"))
