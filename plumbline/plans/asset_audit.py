"""Audit of a collection of image and annotation files: one scan of each kind, joined on the file's path below the root, into a metric table.

Bytes are read by Spark's ``binaryFile`` source (size, digest, EXIF, annotation text), pixels by its ``image`` source; only small
rows leave those scans. They are written once, and every check reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import PII_PATTERNS, col, missing_flag, uniform
from plumbline.operators import clusters, dedup, drift, evidence, fairness, profile, quality, robust, scoring, security
from plumbline.plans.audit import METRIC_SCHEMA, emit, metric
from plumbline.roles import AssetThresholds, Roles
from plumbline.sources import assets
from plumbline.sources.tables import written

#: Pixel features that drift and outliers are measured on.
FEATURES = ("short_side", "aspect_ratio", "brightness_mean", "color_std_mean", "blur_var_lap", "entropy")


@dataclass(frozen=True)
class AssetRoles:
    """Columns of the metadata table: ``path`` names the file below the root, the rest is optional."""

    path: str = "path"
    label: str | None = None
    split: str | None = None
    groups: Sequence[str] = ()
    sources: Sequence[str] = ()
    conditions: Sequence[str] = ()
    annotators: Sequence[str] = ()
    ids: Sequence[str] = ()


@dataclass(frozen=True)
class AssetScan:
    """Written tables of a scan: a row for each image, for each annotation file, and one for the whole collection."""

    images: DataFrame
    annotations: DataFrame
    identity: DataFrame


def relative(path: Column, root: str) -> Column:
    """The path below the root, whatever scheme and slashes the reader puts before it."""
    bare = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
    at = F.instr(path, bare)
    return F.when(at > 0, F.substring(path, at + F.length(bare), F.length(path))).otherwise(path)


def scan(spark: SparkSession, root: str, limits: assets.ArchiveLimits = assets.ArchiveLimits(), sample: int | None = None, seed: int = 7) -> AssetScan:
    """Reads all files below the root: bytes in one scan, pixels in another. Contents are never shuffled.

    With ``sample`` only so many images are decoded, those of the smallest hashes of their path below the root; the collection's
    identity and its annotations are still those of all files.
    """
    files = assets.read_files(spark, root)
    place = relative(F.col("path"), root)
    # files are many and small, and a scan takes a few for each task: what their bytes tell is written once
    read = written(assets.file_facts(files.withColumn("path", place)))
    facts = read.filter(assets.extension(F.col("path")).isin(*assets.IMAGE_EXTENSIONS))
    pixels = assets.decoded_images(spark, root, assets.image_glob()).withColumn("path", place)
    if sample is not None:
        names = files.filter(assets.extension(F.col("path")).isin(*assets.IMAGE_EXTENSIONS)).select(place.alias("path"))
        chosen = written(names.orderBy(uniform(seed, F.col("path")), "path").limit(sample))  # only paths are read for it
        facts, pixels = facts.join(chosen, "path", "left_semi"), pixels.join(chosen, "path", "left_semi")
    images = written(assets.image_features(pixels, limits, facts))
    notes = written(assets.annotations(read.withColumnRenamed("note", "content")))
    return AssetScan(images, notes, written(assets.dataset_identity(read.withColumnRenamed("byte_size", "length"))))


def with_metadata(images: DataFrame, metadata: DataFrame, roles: AssetRoles) -> DataFrame:
    """Images with the columns of their metadata row; an image without one has nulls there. Clashing feature names give way."""
    features = images.withColumnsRenamed({c: f"_image_{c}" for c in images.columns if c in metadata.columns and c != "path"})
    named = metadata.withColumn("_meta_path", col(roles.path)).drop(*({"path"} & set(metadata.columns)))
    return features.join(named, features["path"] == F.col("_meta_path"), "left").drop("_meta_path")


def file_metrics(found: AssetScan, t: AssetThresholds) -> list[DataFrame]:
    """What files alone tell: readability, resolution, blur, copies, EXIF, suspicious files, annotations, identity."""
    images, ok = found.images, F.col("open_ok")
    corrupt = F.coalesce(F.col("open_error") != "no decoder", F.lit(False))
    tiny = F.coalesce(F.col("byte_size") < 100, F.lit(False))
    sharp = F.nanvl("blur_var_lap", F.lit(None).cast("double"))

    def rate(condition: Column, among: Column | None = None) -> Column:
        flag = F.coalesce(condition, F.lit(False)).cast("double")
        return F.avg(flag if among is None else F.when(among, flag))

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))

    row = images.agg(
        F.count(F.lit(1)).alias("images_scanned"), number(corrupt).alias("corrupt_count"), rate(corrupt).alias("corrupt_rate"), rate(ok).alias("readability_rate"),
        rate(F.col("short_side") < t.min_short_side, ok).alias("low_res_rate"), rate(sharp < t.blur, ok & sharp.isNotNull()).alias("low_blur_rate"),
        number(F.col("has_exif")).alias("exif_images"), number(F.col("has_gps")).alias("gps_images"), rate(~ok | tiny).alias("suspicious_rate"),
        rate(F.col("sha256").isNotNull()).alias("integrity_coverage"))
    parts = [emit(row, *[metric(d, c, k, F.col(k)) for d, c, k in (
        ("quality", "readability", "images_scanned"), ("quality", "readability", "corrupt_count"), ("quality", "readability", "corrupt_rate"),
        ("quality", "readability", "readability_rate"), ("quality", "low_resolution", "low_res_rate"), ("quality", "blur_proxy", "low_blur_rate"),
        ("security", "exif_privacy", "exif_images"), ("security", "exif_privacy", "gps_images"), ("security", "suspicious_files", "suspicious_rate"),
        ("security", "integrity", "integrity_coverage"))])]
    named = images.agg(*[rate(F.col("path").rlike(p)).alias(f"p{i}") for i, p in enumerate(PII_PATTERNS.values())])
    flagged = F.greatest(*[F.col(f"p{i}") for i in range(len(PII_PATTERNS))]) >= t.pii_hit_rate
    parts.append(emit(named, metric("security", "pii_in_paths", "columns_with_hits", F.coalesce(flagged, F.lit(False)).cast("int"))))
    copies = images.filter("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("r"), F.count_if(F.col("n") > 1).alias("k"))
    parts.append(emit(copies, metric("quality", "duplicates", "exact_duplicate_rate", F.col("r")), metric("quality", "duplicates", "num_duplicate_sha256", F.col("k"))))
    notes = found.annotations.agg(F.count(F.lit(1)).alias("files"), rate(F.col("valid")).alias("valid"), (F.sum("valid_boxes") / F.nullif(F.sum("total_boxes"), F.lit(0))).alias("boxes"))
    parts.append(emit(notes, metric("quality", "annotation_schema_consistency", "annotation_files", F.col("files")),
                      metric("quality", "annotation_schema_consistency", "schema_consistency_rate", F.col("valid")),
                      metric("quality", "bbox_validity", "bbox_validity_rate", F.col("boxes"))))
    linked = dedup.annotation_linkage(images, found.annotations)
    parts.append(emit(linked, metric("quality", "annotation_linkage", "linkage_rate", F.col("linkage_rate"))))
    parts.append(emit(found.identity, metric("security", "integrity", "byte_size", F.col("byte_size")),
                      metric("security", "integrity", "annotation_files", F.col("annotation_files")),
                      metric("security", "integrity", "sha256", text=F.col("fingerprint"))))
    return parts


def near_metrics(images: DataFrame, t: AssetThresholds) -> list[DataFrame]:
    """Near duplicates by perceptual hash, as clusters."""
    found = clusters.cluster_summary(clusters.near_duplicate_clusters(images, "path", "phash", t.hamming))
    return [emit(found, *[metric("quality", "near_duplicates", k, F.col(k)) for k in ("near_duplicate_pairs", "clusters", "clustered_items", "largest_cluster")])]


def metadata_metrics(items: DataFrame, roles: AssetRoles, fields: Sequence[str], annotated: bool = False) -> list[DataFrame]:
    """What the joined metadata tells: completeness, splits, classes, agreement, provenance, conditions, groups, sources."""
    parts = [emit(profile.row_completeness(items, fields), metric("quality", "metadata_completeness", "metadata_completeness", F.col("completeness")))]
    if roles.split:
        parts.append(emit(items.agg(F.avg(1.0 - missing_flag(items, roles.split)).alias("r")), metric("quality", "split_coverage", "split_coverage", F.col("r"))))
        leaked = dedup.item_leakage(items, F.col("sha256"), roles.split)
        parts.append(emit(leaked, metric("quality", "cross_split_leakage", "cross_split_leakage_rate", F.col("leakage_rate"))))
        shifted = drift.drift_first_last(*_sliced(items, roles.split), k=None)
        parts.append(emit(shifted, metric("reliability", "feature_drift_ks_first_last", "top_10_ks", F.col("ks"), F.col("column"))))
    if roles.label:
        conflicts = dedup.label_conflicts(items, F.col("sha256"), roles.label)
        parts.append(emit(conflicts, metric("quality", "conflicting_duplicate_labels", "conflict_rate", F.col("conflict_rate"))))
        balance = quality.class_balance(items, roles.label)
        parts.append(emit(balance, metric("quality", "class_balance", "num_classes", F.col("num_classes")),
                          metric("quality", "class_balance", "normalized_entropy", F.col("normalized_entropy"))))
    if len(roles.annotators) > 1:
        agreed = quality.cohen_kappa(items, roles.annotators).agg(F.max("mean_kappa").alias("k"))
        parts.append(emit(agreed, metric("reliability", "annotator_agreement", "mean_kappa", F.col("k"))))
    if roles.sources:
        parts.append(emit(profile.coverage(items, roles.sources), metric("reliability", "provenance_coverage", "coverage_rate", F.col("coverage_rate"))))
        for source in roles.sources:
            parts.append(emit(security.source_concentration(items, source), metric("security", "source_concentration", "hhi", F.col("hhi"), F.lit(source))))
    if roles.conditions:
        bins = quality.condition_coverage(items, roles.conditions)
        parts.append(emit(bins, metric("robustness", "condition_coverage", "worst_bin_coverage", F.col("worst_bin_coverage"), F.col("column")),
                          metric("robustness", "distribution_divergence", "jsd_vs_uniform", F.col("jsd_vs_uniform"), F.col("column"))))
    if roles.groups:
        cube = written(fairness.group_cube(items, roles.groups, roles.label))
        shares = fairness.representation(cube)
        parts.append(emit(shares, metric("fairness", "group_checks", "representation_jsd_vs_uniform", F.col("jsd_vs_uniform"), F.col("group_column"))))
        holes = fairness.missing_disparity(items, roles.groups, fields, k=None).groupBy("group_column").agg(F.max("disparity").alias("d"))
        parts.append(emit(holes, metric("fairness", "group_checks", "max_missingness_disparity", F.col("d"), F.col("group_column"))))
        if roles.label:
            gaps = fairness.parity_gaps(cube).groupBy("group_column").agg(F.max("parity_gap").alias("g"))
            parts.append(emit(gaps, metric("fairness", "group_checks", "max_label_parity_gap", F.col("g"), F.col("group_column"))))
    described = Roles(label=roles.label, split=roles.split, groups=tuple(roles.groups), sources=tuple(roles.sources), conditions=tuple(roles.conditions),
                      annotators=tuple(roles.annotators), ids=tuple(roles.ids))
    sheet = evidence.datasheet_completeness(items, described, annotated).agg(F.max("completeness_rate").alias("r"))
    parts.append(emit(sheet, metric("transparency", "datasheet", "completeness", F.col("r"))))
    if roles.ids or roles.sources:
        traced = profile.coverage(items, [*roles.ids, *roles.sources, *([roles.label] if roles.label else [])], "all")
        parts.append(emit(traced, metric("transparency", "traceability", "traceability_coverage", F.col("coverage_rate"))))
    return parts


def _sliced(items: DataFrame, split: str) -> tuple[DataFrame, list[str]]:
    sliced = drift.with_slices(items, Roles(split=split), prefer="split")
    return sliced, [c for c in FEATURES if c in items.columns]


def asset_audit(found: AssetScan, metadata: DataFrame | None = None, roles: AssetRoles = AssetRoles(), thresholds: AssetThresholds = AssetThresholds(),
                dataset: str = "assets", near: bool = True) -> DataFrame:
    """The metric table of a scan: (run_id, dataset, dimension, check, subject, key, value, text).

    Metadata rows meet images by path; without metadata only files are judged. Pixel outliers count all images, as unreadable ones have
    no score. ``near`` adds clusters of near duplicates.
    """
    parts = file_metrics(found, thresholds)
    outliers = robust.score_summary(robust.mad_scores(found.images, FEATURES, ["path"]))
    parts.append(emit(outliers, *[metric("robustness", "image_feature_outliers_mad", k, F.col(k)) for k in ("outlier_rate", "mean", "p95", "p99")]))
    if near:
        parts += near_metrics(found.images, thresholds)
    if metadata is not None:
        fields = [c for c in metadata.columns if c != roles.path]
        annotated = not found.annotations.isEmpty()
        parts += metadata_metrics(written(with_metadata(found.images, metadata, roles)), roles, fields, annotated)
    whole = reduce(DataFrame.unionByName, parts).filter("value is not null or text is not null")
    return whole.select(F.lit(dataset).alias("run_id"), F.lit(dataset).alias("dataset"), *METRIC_SCHEMA)


# Where each input of the score stands in the metric table.
SCORE_INPUTS = (
    ("readability_rate", "readability", "readability_rate"), ("corrupt_rate", "readability", "corrupt_rate"), ("low_resolution_rate", "low_resolution", "low_res_rate"),
    ("duplicate_rate", "duplicates", "exact_duplicate_rate"), ("split_leakage", "cross_split_leakage", "cross_split_leakage_rate"),
    ("conflict_rate", "conflicting_duplicate_labels", "conflict_rate"), ("schema_consistency_rate", "annotation_schema_consistency", "schema_consistency_rate"),
    ("metadata_completeness", "metadata_completeness", "metadata_completeness"), ("normalized_entropy", "class_balance", "normalized_entropy"),
    ("label_noise", "label_noise", "suspected_label_noise_rate"), ("mean_kappa", "annotator_agreement", "mean_kappa"),
    ("max_drift_ks", "feature_drift_ks_first_last", "top_10_ks"), ("provenance_coverage", "provenance_coverage", "coverage_rate"),
    ("outlier_rate", "image_feature_outliers_mad", "outlier_rate"), ("traceability_coverage", "traceability", "traceability_coverage"),
    ("gps_images", "exif_privacy", "gps_images"), ("suspicious_rate", "suspicious_files", "suspicious_rate"),
    ("datasheet_completeness", "datasheet", "completeness"), ("pii_flag_count", "pii_in_paths", "columns_with_hits"))


def asset_runs(metrics: DataFrame, t: AssetThresholds = AssetThresholds()) -> DataFrame:
    """One row per run with every input of ``asset_score``: rates, counts of columns beyond a limit, sums of capped penalties."""
    def at(check: str, key: str) -> Column:
        return (F.col("check") == check) & (F.col("key") == key)

    def beyond(check: str, key: str, hit: Column) -> Column:
        return F.sum(F.when(at(check, key) & hit, 1.0).otherwise(0.0))

    def capped(check: str, key: str, limit: float, factor: float) -> Column:
        return F.sum(F.when(at(check, key) & (F.col("value") > limit), F.least(F.lit(3.0), F.col("value") * factor)).otherwise(0.0))

    value = F.col("value")
    return metrics.groupBy("run_id").agg(
        *[F.max(F.when(at(c, k), value)).alias(name) for name, c, k in SCORE_INPUTS],
        beyond("condition_coverage", "worst_bin_coverage", value < t.worst_bin_warn).alias("low_condition_bins"),
        beyond("group_checks", "max_missingness_disparity", value > t.missing_disparity_warn).alias("disparate_groups"),
        capped("group_checks", "representation_jsd_vs_uniform", 0.1, 10.0).alias("jsd_penalty"),
        capped("group_checks", "max_label_parity_gap", 0.2, 5.0).alias("parity_penalty"),
        beyond("source_concentration", "hhi", value > t.hhi_warn).alias("concentrated_sources"))


def asset_report(metrics: DataFrame, t: AssetThresholds = AssetThresholds(), rules=scoring.ASSET_RULES, weights: dict | None = None) -> DataFrame:
    """One row per run: points, score, grade, verdict, findings, recommendations."""
    runs = written(asset_runs(metrics, t))
    heads = runs.unpivot(["run_id"], [c for c in runs.columns if c != "run_id"], "metric", "value").filter("value is not null")
    return scoring.asset_score(runs, t, weights).join(scoring.review(heads, rules, t), "run_id")
