"""Duplicates, leakage between splits, conflicting labels, near duplicates, schema differences."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col, identity, ratio
from plumbline.operators.clusters import hash_counts, hex_word, neighbours, segment_masks
from plumbline.operators.distribution import interval_count
from plumbline.operators.profile import column_types
from plumbline.sources.tables import written


def duplicate_rate(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each content, over all rows; missing values are equal.

    Copies collapse in the map-side combine, so a row repeated a billion times costs one row per task.
    """
    columns = list(columns or [c for c in df.columns if c not in by])
    groups = df.groupBy(*by, *identity(df, columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        ratio(F.sum(F.col("_n") - 1), F.sum("_n")).alias("duplicate_rate"))


def content_splits(df: DataFrame, split: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per (by, content): rows, distinct (content, split) pairs and distinct non-null splits.

    One pass that serves both the duplicate rate and the split leakage of a table. A row stands for ``weight`` rows.
    """
    features = [c for c in df.columns if c not in (split, weight, *by)]
    keys = identity(df, features)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pairs = df.groupBy(*by, *keys, col(split).cast("string").alias("_split")).agg(rows.alias("_n"))
    return pairs.groupBy(*by, *[col(c) for c in features]).agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_pairs"), F.count("_split").alias("_splits"))


def split_leakage(df: DataFrame, split: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of distinct row contents (split aside) that occur in more than one split."""
    return content_splits(df, split, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_contents"),
        F.sum((F.col("_splits") > 1).cast("bigint")).alias("leaked_contents"),
        F.avg((F.col("_splits") > 1).cast("double")).alias("leakage_rate"))


def duplicates_and_leakage(df: DataFrame, split: str, by: Sequence[str] = ()) -> DataFrame:
    """Duplicate-row rate and split leakage from the same shuffle."""
    return content_splits(df, split, by).groupBy(*by).agg(
        F.sum("_rows").alias("rows"),
        ratio(F.sum("_rows") - F.sum("_pairs"), F.sum("_rows")).alias("duplicate_rate"),
        F.avg((F.col("_splits") > 1).cast("double")).alias("leakage_rate"))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def content_duplicates(df: DataFrame, content: Column) -> DataFrame:
    """Duplicate items by content hash."""
    counts = df.groupBy(digest(content).alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("hash is not null")
    return counts.agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("unique_hashes"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("duplicated_hashes"),
        F.sum(F.col("n") - 1).alias("duplicate_items"),
        ratio(F.sum(F.col("n") - 1), F.sum("n")).alias("duplicate_rate"))


def top_duplicates(df: DataFrame, content: Column, k: int = 10) -> DataFrame:
    counts = df.groupBy(digest(content).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1 and hash is not null").orderBy(F.desc("n"), "hash").limit(k)


def item_leakage(df: DataFrame, content: Column, split: str) -> DataFrame:
    """Items whose content occurs in more than one split, over items with content and split.

    Counting (hash, split) pairs first keeps the leaked items countable without joining them back.
    """
    pairs = (df.select(digest(content).alias("hash"), col(split).alias("split")).dropna()
             .groupBy("hash", "split").agg(F.count(F.lit(1)).alias("n")))
    hashes = pairs.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits"))
    leaked = F.col("splits") > 1
    return hashes.agg(
        F.sum("n").alias("total_items"), F.sum(F.when(leaked, F.col("n")).otherwise(0)).alias("leaked_items"),
        F.sum(leaked.cast("bigint")).alias("leaked_hashes"),
        ratio(F.sum(F.when(leaked, F.col("n")).otherwise(0)), F.sum("n")).alias("leakage_rate"))


def leaked_items(df: DataFrame, content: Column, split: str) -> DataFrame:
    """The items themselves (semi-join with the leaked hashes)."""
    keyed = df.withColumn("_hash", digest(content))
    pairs = keyed.filter(col(split).isNotNull()).groupBy("_hash", col(split).alias("_s")).agg(F.lit(1))
    leaked = pairs.groupBy("_hash").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_hash")
    return keyed.filter(col(split).isNotNull()).join(leaked, "_hash", "left_semi").drop("_hash")


def label_conflicts(df: DataFrame, content: Column, label: str) -> DataFrame:
    """Contents that carry more than one label, over contents with a label."""
    pairs = (df.select(digest(content).alias("hash"), col(label).alias("label")).dropna()
             .groupBy("hash", "label").agg(F.lit(1)))
    hashes = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("labels"))
    conflict = F.col("labels") > 1
    return hashes.agg(
        F.count(F.lit(1)).alias("hash_groups"), F.sum(conflict.cast("bigint")).alias("conflict_groups"),
        F.avg(conflict.cast("double")).alias("conflict_rate"))


def near_duplicate_pairs(df: DataFrame, item: str, phash: str, max_distance: int = 6,
                         block_digits: int = 4) -> DataFrame:
    """Distinct-hash pairs within a Hamming distance, inside blocks of equal leading digits.

    Two hashes of a block that differ in at most d bits must agree on at least two of any d + 2
    segments of the remaining bits. Joining on (block, segment pair, segment values) therefore finds
    every pair and never compares a whole block with itself, however large it is; a pair is kept
    where its first two agreeing segments meet, so it appears once without a further shuffle. Items
    with the very same hash are counted before the join, so copies never multiply. Rows: hash_a <=
    hash_b, the distance, the number of item pairs they stand for and an example item of each side.
    """
    hashes = (df.filter(col(phash).isNotNull()).groupBy(F.lower(col(phash)).alias("hash"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(col(item).alias("item"))).alias("ends_lo"),
                   F.max(F.struct(col(item).alias("item"))).alias("ends_hi")))
    masks = segment_masks(max_distance, block_digits)
    segments = len(masks)
    word = hex_word(F.col("hash"))
    keys = F.array(*[
        F.struct(F.lit(1 << i).alias("bit"), F.lit((1 << j) - 1).alias("below"),
                 word.bitwiseAND(F.lit(masks[i] | masks[j])).alias("bits"))
        for i, j in combinations(range(segments), 2)])
    probes = hashes.repartition(interval_count(hashes), F.xxhash64("hash")).select(
        "hash", "n", F.struct("ends_lo", "ends_hi").alias("ends"), word.alias("word"),
        F.substring("hash", 1, block_digits).alias("block"), F.explode(keys).alias("k")).select(
        "hash", "n", "ends", "word", "block", "k.bit", "k.below", "k.bits")
    a, b = probes.alias("a"), probes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("block", "bit", "below", "bits")]
    xor = F.col("a.word").bitwiseXOR(F.col("b.word"))
    agreeing = sum((F.when(xor.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    first_pair = agreeing.bitwiseAND(F.col("a.below")) == F.col("a.bit")
    same = F.col("a.hash") == F.col("b.hash")
    met = a.join(b, on + [F.col("a.hash") <= F.col("b.hash"), F.bit_count(xor) <= max_distance,
                          first_pair])
    found = met.select(
        F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"), F.bit_count(xor).cast("bigint").alias("hamming"),
        F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n")).alias("item_pairs"),
        F.col("a.ends.ends_lo.item").alias("item_a"), F.col("b.ends.ends_hi.item").alias("item_b"))
    return found.filter("item_pairs > 0")


def near_duplicates(df: DataFrame, item: str, phash: str, max_distance: int = 6, block_digits: int = 0) -> DataFrame:
    """Summary of the near-duplicate search: item pairs, hash pairs and items with a hash, as sums over the hashes.

    All pairs within the distance count; ``block_digits`` leaves out those that differ in so many leading digits. Copies are counted, neighbours
    are summed inside the tasks that compare them; no pair is a row of its own.
    """
    hashes = written(hash_counts(df, item, phash))
    near = neighbours(hashes.withColumn("name", F.col("hash")), max_distance, block_digits).select("hash", "links", "partners")
    found = hashes.join(near, "hash", "left")
    return found.agg(F.expr("coalesce(sum(n * (n - 1 + coalesce(partners, 0))), 0L) div 2").alias("near_duplicate_pairs"),
                     F.expr("coalesce(sum(links), 0L) div 2 + coalesce(sum(if(n > 1, 1L, 0L)), 0L)").alias("hash_pairs"),
                     F.expr("coalesce(sum(n), 0L)").alias("hashed_items"))


def schema_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column presence and type changes between two tables."""
    left = column_types(a).select("column", F.col("dtype").alias("dtype_a"))
    right = column_types(b).select("column", F.col("dtype").alias("dtype_b"))
    both = left.join(right, "column", "full_outer")
    return both.select(
        "column", F.when(F.col("dtype_b").isNull(), "only_baseline").when(F.col("dtype_a").isNull(), "only_candidate")
        .when(F.col("dtype_a") != F.col("dtype_b"), "type_changed").otherwise("shared").alias("status"),
        "dtype_a", "dtype_b")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"(?<=.)\.[^.]*$", "")


def annotation_linkage(assets: DataFrame, annotations: DataFrame, asset_path: str = "path",
                       annotation_path: str = "path") -> DataFrame:
    """Share of distinct asset stems that have an annotation file of the same stem."""
    stems = assets.select(path_stem(col(asset_path)).alias("stem")).distinct()
    marked = annotations.select(path_stem(col(annotation_path)).alias("stem")).distinct().withColumn("hit", F.lit(1))
    joined = stems.join(marked, "stem", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_assets"), F.count("hit").alias("linked_assets"),
        (F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("linkage_rate"))


def unmatched_assets(assets: DataFrame, annotations: DataFrame, asset_path: str = "path",
                     annotation_path: str = "path", k: int = 20) -> DataFrame:
    stems = assets.select(path_stem(col(asset_path)).alias("stem")).distinct()
    marked = annotations.select(path_stem(col(annotation_path)).alias("stem"))
    return stems.join(marked, "stem", "left_anti").orderBy("stem").limit(k)


def join_metadata(metadata: DataFrame, assets: DataFrame, path_column: str) -> DataFrame:
    """Metadata with its assets: by full path when the values look like paths, else by file name."""
    tagged = assets.withColumnRenamed("path", "_asset_path")
    return metadata.join(tagged, col(path_column) == F.col("_asset_path"), "left")


def join_metadata_by_name(metadata: DataFrame, assets: DataFrame, path_column: str) -> DataFrame:
    """File-name join; equal names in different folders fan out."""
    tagged = assets.withColumnRenamed("path", "_asset_path").withColumn(
        "_name", F.regexp_extract("_asset_path", "[^/]+$", 0))
    return metadata.withColumn("_name", F.regexp_extract(col(path_column), "[^/]+$", 0)).join(tagged, "_name", "left")
