"""Personal-data patterns, fingerprints, source concentration, suspicious items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import PII_PATTERNS, col, ratio
from plumbline.operators.distribution import with_totals
from plumbline.operators.quality import shares


def pii_hit_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None,
                  hits: Mapping[tuple[str, str], Column] | None = None) -> DataFrame:
    """Share of present values that match each pattern, for all columns in one scan of whole texts.

    ``weight`` is a column that says for how many rows a row stands; ``hits`` gives, by (column, pattern), matches that are known already.
    """
    names = [(c, p) for c in columns for p in PII_PATTERNS]

    def rate(c: str, p: str) -> Column:
        hit = col(c).rlike(PII_PATTERNS[p]) if hits is None else hits[c, p]
        if weight is None:
            return F.avg(hit.cast("double"))
        return ratio(F.sum(hit.cast("bigint") * col(weight)), F.sum(F.when(hit.isNotNull(), col(weight))))

    row = df.groupBy(*by).agg(*[rate(c, p).alias(f"h{i}") for i, (c, p) in enumerate(names)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"), F.col(f"h{i}").alias("hit_rate"))
        for i, (c, p) in enumerate(names)])
    return row.select(*by, F.explode(cells).alias("h")).select(*by, "h.column", "h.pattern", "h.hit_rate")


def pii_findings(rates: DataFrame, threshold: float = 0.01) -> DataFrame:
    return rates.filter(F.col("hit_rate") >= threshold)


def keyed_sample(df: DataFrame, key: Sequence[Column], seed: int, k: int, draw: Column | None = None) -> DataFrame:
    """Reproducible sample of k rows in the order of ``draw``, by default a hash (a distributed top-k, no global sort)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key) if draw is None else draw, *key).limit(k)


def stratified_sample(df: DataFrame, stratum: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each stratum in the given order.

    ``row_number() <= k`` lets Spark keep only k rows per stratum and task before the shuffle.
    """
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.filter(F.col("_r") <= k).drop("_r")


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive fingerprint and size of a table: SHA-256 over the sums of row-digest parts.

    Each row's digest is cut into 32-bit words whose sums do not depend on row order or partitioning
    and change when a row is added, removed, altered or repeated.
    """
    columns = list(columns or df.columns)
    # every value is preceded by its length, null by a mark that is no length: no two rows read the same
    texts = [col(c).cast("string") for c in columns]
    encoded = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    hashed = df.select(F.sha2(encoded, 256).alias("h"), F.octet_length(encoded).cast("bigint").alias("b"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = hashed.agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("encoded_bytes"),
                      *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    text = F.concat_ws(",", *[F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(8)])
    return sums.select("rows", "encoded_bytes", F.sha2(text, 256).alias("fingerprint"))


def hash_coverage(df: DataFrame, digest: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_items"), F.count(digest).alias("items_with_hash"),
                  (F.count(digest) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("integrity_coverage"))


def suspicious_items(df: DataFrame, readable: Column, size: Column, minimum: int = 100) -> DataFrame:
    """Items that cannot be read or are smaller than ``minimum`` bytes."""
    broken, tiny = ~readable, size < minimum
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.coalesce(broken | tiny, F.lit(False)).cast("bigint")).alias("suspicious_count"),
        F.sum(broken.cast("bigint")).alias("unreadable"), F.sum(tiny.cast("bigint")).alias("tiny"),
        F.avg(F.coalesce(broken | tiny, F.lit(False)).cast("double")).alias("suspicious_rate"))


def source_concentration(df: DataFrame, source: str, warn: float = 0.25) -> DataFrame:
    """Herfindahl index, number of sources, largest share and an interpretation."""
    hhi = F.sum(F.col("share") * F.col("share"))
    return shares(df, source).agg(
        hhi.alias("hhi"), F.count(F.lit(1)).alias("num_sources"), F.max("share").alias("top_source_share")
    ).withColumn("interpretation", F.when(F.col("hhi") > warn, "high_concentration").otherwise("acceptable"))


def declared_identifiers(df: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Entity columns that need a permission check, with the number of present values."""
    row = df.agg(*[F.count(col(e)).alias(e) for e in entities])
    return row.unpivot([], [col(e) for e in entities], "column", "present_values")


def exif_privacy(features: DataFrame) -> DataFrame:
    """Share of images that carry EXIF and GPS data."""
    gps, exif = F.coalesce("has_gps", F.lit(False)), F.coalesce("has_exif", F.lit(False))
    return features.agg(
        F.count(F.lit(1)).alias("images"), F.sum(exif.cast("bigint")).alias("exif_images"),
        F.sum(gps.cast("bigint")).alias("gps_images"), F.avg(gps.cast("double")).alias("gps_rate"))


def share_above(df: DataFrame, value: str, by: Sequence[str], limit: float) -> DataFrame:
    counted = with_totals(df, by, _all=F.sum(value))
    return counted.withColumn("share", col(value) / F.col("_all")).filter(F.col("share") > limit).drop("_all")
