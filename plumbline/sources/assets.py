"""Scans of image, annotation and archive files.

Files are split over tasks by Spark's ``binaryFile`` and ``image`` sources; the latter decodes in the JVM. Pixel features
are taken from its decoded struct, size, digest and EXIF from the bytes; only these small rows are joined.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import ratio
from plumbline.operators.distribution import interval_count

# Accepted image formats, archive limits, pixel budget.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")
ANNOTATION_EXTENSIONS = ("json", "xml", "txt")
MIB = 1 << 20


@dataclass(frozen=True)
class ArchiveLimits:
    archive_bytes: int = 512 * MIB
    members: int = 20_000
    expanded_bytes: int = 2 * 1024 * MIB
    member_bytes: int = 100 * MIB
    ratio: float = 200.0
    pixels: int = 50_000_000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of every file below a folder."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
            .load(path).select("path", "length", "content"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes (path, content) rows as files below a shared folder, dealt over tasks by their path; a retried task writes the same files.

    The folder is reached through its own file system (file, hdfs, s3, gs), not through a local disk of the executor.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base.rstrip('/')}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    dealt = files.select("path", "content").repartition(interval_count(files), "path")
    return dealt.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def folder_label(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.when(F.size(F.split(path, "/")) >= 2, F.element_at(F.split(path, "/"), -2))


def archive_members(files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Members of many zip archives (path, length, content); an unreadable archive yields one row with ``valid`` false.

    Only the directory of an archive is read; nothing is expanded. The content of archives beyond the size limit is never loaded.
    """
    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "archive_bytes", "valid", "member", "size", "compressed"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    infos = [i for i in zipfile.ZipFile(io.BytesIO(content)).infolist() if not i.is_dir()]
                    rows = [(path, len(content), True, i.filename, i.file_size, i.compress_size) for i in infos]
                    rows = rows or [(path, len(content), True, None, 0, 0)]
                except (OSError, zipfile.BadZipFile):
                    rows = [(path, len(content), False, None, 0, 0)]
                yield pd.DataFrame(rows, columns=columns)

    schema = "path string, archive_bytes long, valid boolean, member string, size long, compressed long"
    read = files.filter(F.col("length") <= limits.archive_bytes).select("path", "content").mapInPandas(listing, schema)
    none = F.lit(None)
    large = files.filter(F.col("length") > limits.archive_bytes).select(
        "path", F.col("length").cast("long").alias("archive_bytes"), F.lit(True).alias("valid"), none.cast("string").alias("member"),
        F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("compressed"))
    return read.unionByName(large)


def screen_archives(members: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Verdict per archive: why it is rejected, and how many members are skipped or accepted."""
    file = F.col("member").isNotNull()
    oversized = file & (F.col("size") > limits.member_bytes)
    squeezed = file & ~oversized & (F.col("size") >= MIB) & (
        F.col("size") / F.greatest(F.lit(1), F.col("compressed")) > limits.ratio)
    stats = members.groupBy("path").agg(
        F.max("archive_bytes").alias("archive_bytes"), F.min("valid").alias("valid"), F.count("member").alias("members"),
        F.sum("size").alias("expanded_bytes"), F.sum(oversized.cast("bigint")).alias("oversized"),
        F.sum(squeezed.cast("bigint")).alias("suspicious_ratio"))
    reason = (F.when(F.col("archive_bytes") > limits.archive_bytes, "archive too large")
              .when(~F.col("valid"), "invalid archive").when(F.col("members") > limits.members, "too many files")
              .when(F.col("expanded_bytes") > limits.expanded_bytes, "expands too far"))
    accepted = F.when(reason.isNull(), F.col("members") - F.col("oversized") - F.col("suspicious_ratio")).otherwise(0)
    return stats.select("*", reason.alias("rejected"), accepted.alias("accepted"))


# pixels

def _resized(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """Box average (nearest when enlarging) to a square, from the summed-area table."""
    def edges(length: int) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.linspace(0, length, size + 1).astype(int)
        low = np.minimum(cuts[:-1], length - 1)
        return low, np.maximum(cuts[1:], low + 1)

    area = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    area[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)
    (r0, r1), (c0, c1) = edges(grey.shape[0]), edges(grey.shape[1])
    sums = area[r1][:, c1] - area[r0][:, c1] - area[r1][:, c0] + area[r0][:, c0]
    return sums / np.outer(r1 - r0, c1 - c0)


def _perceptual_hash(grey: np.ndarray) -> str:
    """64 bits: which low DCT frequencies of the 32x32 image exceed their median."""
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ _resized(grey, n) @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


FEATURE_SCHEMA = ("path string, width int, height int, mean_r double, mean_g double, mean_b double, std_r double, std_g double, "
                  "std_b double, blur_var_lap double, entropy double, phash string")


def _features(rgb: np.ndarray) -> tuple:
    flat = rgb.reshape(-1, 3).astype(float)
    grey = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)
    blur = float("nan")
    if min(grey.shape) >= 3:
        blur = float(np.var(grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]))
    share = np.bincount(grey.astype(int).ravel(), minlength=256) / grey.size
    share = share[share > 0]
    return (rgb.shape[1], rgb.shape[0], *flat.mean(axis=0), *flat.std(axis=0), blur, float(-(share * np.log2(share)).sum()),
            _perceptual_hash(grey))


def _exif(data: bytes) -> tuple:
    """(has_exif, has_gps, make, model, datetime) from the first EXIF block of a JPEG, PNG or TIFF file."""
    at = data.find(b"Exif\x00\x00")
    start = at + 6 if at >= 0 else data.find(b"eXIf") + 4 if b"eXIf" in data else 0 if data[:4] in (b"II*\x00", b"MM\x00*") else -1
    if start < 0:
        return False, False, None, None, None
    block = data[start:]
    try:
        order = "<" if block[:2] == b"II" else ">"
        entries: dict[int, bytes | int] = {}
        pending = [struct.unpack(order + "I", block[4:8])[0]]
        for offset in pending[:2]:
            for i in range(struct.unpack(order + "H", block[offset:offset + 2])[0]):
                tag, kind, count = struct.unpack(order + "HHI", block[offset + 2 + 12 * i:offset + 10 + 12 * i])
                value = block[offset + 10 + 12 * i:offset + 14 + 12 * i]
                number = struct.unpack(order + "I", value)[0]
                if kind == 2:
                    entries[tag] = value[:count] if count <= 4 else block[number:number + count]
                else:
                    entries[tag] = number
        def text(tag: int):
            raw = entries.get(tag)
            return raw.split(b"\x00")[0].decode("latin-1") if isinstance(raw, bytes) else None
        return bool(entries), 34853 in entries, text(271), text(272), text(36867) or text(306)
    except (struct.error, IndexError):
        return False, False, None, None, None


def image_glob() -> str:
    """File names of the accepted formats, in small or capital letters."""
    return "*.{" + ",".join(f(e) for e in IMAGE_EXTENSIONS for f in (str.lower, str.upper)) + "}"


def decoded_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, image) of every image file below a folder, decoded by Spark (JPEG, PNG, GIF, BMP, TIFF); width -1 where it can't."""
    found = (spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(path))
    return found.select(F.col("image.origin").alias("path"), "image")


def _together(files: DataFrame) -> DataFrame:
    """As many tasks as a shuffle has at most: a scan of small files makes one for every 32 of them, and starting it takes longer than its files."""
    return files.coalesce(interval_count(files))


def file_facts(files: DataFrame) -> DataFrame:
    """Size, digest and EXIF of each file (path, content), and the content of annotation files: all that is taken from bytes, in one scan."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_exif(data) for data in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "byte_size": batch["byte_size"], "sha256": batch["sha256"], "note": batch["note"], **{
                name: [f[i] for f in found] for i, name in enumerate(("has_exif", "has_gps", "exif_make", "exif_model", "exif_datetime"))}})

    note = F.when(extension(F.col("path")).isin(*ANNOTATION_EXTENSIONS), F.col("content"))
    sized = files.select("path", "content", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), note.alias("note"))
    return _together(sized).mapInPandas(scan, "path string, byte_size long, sha256 string, note binary, has_exif boolean, has_gps boolean, exif_make string, "
                             "exif_model string, exif_datetime string")


def image_features(images: DataFrame, limits: ArchiveLimits = ArchiveLimits(), facts: DataFrame | None = None) -> DataFrame:
    """One row per decoded image (path, image): dimensions, colour, blur, entropy, perceptual hash, and the facts of its file.

    ``open_error`` tells images that Spark has no decoder for from corrupt ones and from those beyond the pixel limit.
    """
    names = [part.split()[0] for part in FEATURE_SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, height, width, channels, data, error in zip(*(batch[c] for c in ("path", "height", "width", "channels", "data", "open_error"))):
                if error is not None:
                    rows.append((path, *[None] * (len(names) - 1), error))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                rows.append((path, *_features(pixels[:, :, 2::-1] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)), None))
            # as objects, so that an undefined number stays one and a missing one is null
            yield pd.DataFrame(rows, columns=[*names, "open_error"], dtype=object)

    flat = images.select("path", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                         F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    size = F.col("width").cast("long") * F.col("height")
    good = (F.col("width") > 0) & (size <= limits.pixels)
    missing = F.when(extension(F.col("path")).isin("webp"), "no decoder").otherwise("corrupt")
    error = F.when(~F.coalesce(good, F.lit(False)), F.when(F.col("width") > 0, F.format_string(
        "image has %d pixels; limit is %d pixels", size, F.lit(limits.pixels))).otherwise(missing))
    # images that can't be read go through the same scan: a second one would decode all of them again
    judged = flat.withColumn("open_error", error).withColumn("data", F.when(F.col("open_error").isNull(), F.col("data")))
    found = _together(judged).mapInPandas(scan, FEATURE_SCHEMA + ", open_error string").withColumn("open_ok", F.col("open_error").isNull())
    if facts is not None:
        plain = F.regexp_replace("path", "^file:/+", "file:/")
        named = facts.withColumn("_path", plain).drop("path", "note")
        found = found.withColumn("_path", plain).join(named, "_path", "left").drop("_path")
    short, long = F.least("width", "height"), F.greatest("width", "height")
    return found.withColumns({
        "short_side": short, "long_side": long, "aspect_ratio": F.col("width") / F.col("height"),
        "megapixels": F.col("width") * F.col("height") / 1e6, "file_ext": extension(F.col("path")),
        "brightness_mean": (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3,
        "color_std_mean": (F.col("std_r") + F.col("std_g") + F.col("std_b")) / 3})


def readability(features: DataFrame) -> DataFrame:
    """Corrupt and readable images; an image without a decoder is neither."""
    corrupt = F.coalesce(F.col("open_error") != "no decoder", F.lit(False))
    return features.agg(
        F.count(F.lit(1)).alias("images_scanned"), F.sum(corrupt.cast("bigint")).alias("corrupt_count"),
        F.avg(corrupt.cast("double")).alias("corrupt_rate"), F.avg(F.col("open_ok").cast("double")).alias("readability_rate"))


def resolution(features: DataFrame, minimum: int = 224) -> DataFrame:
    """Low-resolution rate and exact short-side quantiles."""
    from plumbline.operators.distribution import quantiles
    from plumbline.operators.series import value_counts_of
    ok = features.filter("open_ok")
    points = quantiles(value_counts_of(ok, "short_side"), ["key"], {"min": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "max": 1.0})
    low = (F.col("short_side") < minimum)
    rates = ok.groupBy(F.lit(1).alias("key")).agg(F.sum(low.cast("bigint")).alias("low_res_count"), F.avg(low.cast("double")).alias("low_res_rate"))
    return rates.join(F.broadcast(points), "key").drop("key", "n_values")


def blur(features: DataFrame, threshold: float = 25.0) -> DataFrame:
    low = F.coalesce(F.nanvl("blur_var_lap", F.lit(None).cast("double")) < threshold, F.lit(False))
    return features.filter("open_ok").agg(F.sum(low.cast("bigint")).alias("low_blur_count"), F.avg(low.cast("double")).alias("low_blur_rate"))


# annotations

ANNOTATION_FIELDS = ("path", "format", "style", "valid", "annotations", "images", "categories", "total_boxes", "valid_boxes", "names")


def _annotation(df: DataFrame, **values: Column) -> DataFrame:
    kinds = {"path": "string", "format": "string", "style": "string", "valid": "boolean", "names": "array<string>"}
    return df.select(*[values.get(f, F.lit(None)).cast(kinds.get(f, "bigint")).alias(f) for f in ANNOTATION_FIELDS])


def json_annotations(texts: DataFrame) -> DataFrame:
    """COCO, LabelMe, other object or array, by the top-level shape of each (path, text) file."""
    doc = texts.withColumn("keys", F.json_object_keys("text")).withColumn("items", F.json_array_length("text"))
    doc = doc.withColumn("ok", F.try_parse_json("text").isNotNull())

    def has(key: str) -> Column:
        return F.coalesce(F.array_contains("keys", key), F.lit(False))

    def size(key: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object("text", f"$.{key}")), F.lit(0))

    style = (F.when(has("annotations") & has("images"), "coco").when(has("shapes"), "labelme")
             .when(F.col("keys").isNotNull(), "generic_json").when(F.col("items").isNotNull(), "json_array"))
    listed = F.from_json(F.get_json_object("text", "$.categories"), "array<struct<name:string>>")
    names = F.transform(listed, lambda c: F.coalesce(c["name"], F.lit("")))
    return _annotation(
        doc, path=F.col("path"), format=F.lit("json"), valid=F.col("ok"), style=F.when(F.col("ok"), style),
        annotations=F.when(style == "coco", size("annotations")).when(style == "labelme", size("shapes")).when(style == "json_array", F.col("items")),
        images=F.when(style == "coco", size("images")), categories=F.when(style == "coco", size("categories")),
        names=F.when(style == "coco", names))


def xml_annotations(texts: DataFrame) -> DataFrame:
    """VOC objects and box validity; a malformed file is an invalid row, not a failed job."""
    schema = "object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>, _bad string"
    doc = texts.withColumn("x", F.from_xml("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    root = F.regexp_extract("text", r"<([A-Za-z_][\w.-]*)", 1)
    ok = F.col("x._bad").isNull() & (root != "")
    objects = F.coalesce("x.object", F.array().cast("array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"))

    def number(box: Column, side: str) -> Column:
        return F.coalesce(box[side], F.lit("0")).try_cast("double")

    good = F.filter(objects, lambda o: o["bndbox"].isNotNull()
                    & (number(o["bndbox"], "xmin") < number(o["bndbox"], "xmax"))
                    & (number(o["bndbox"], "ymin") < number(o["bndbox"], "ymax")))
    voc = ok & (root == "annotation")
    return _annotation(
        doc, path=F.col("path"), format=F.lit("xml"), valid=ok,
        style=F.when(ok, F.when(root == "annotation", "pascal_voc").otherwise("generic_xml")),
        total_boxes=F.when(voc, F.size(objects)), valid_boxes=F.when(voc, F.size(good)), names=F.when(voc, F.transform(objects, lambda o: o["name"])))


def text_annotations(texts: DataFrame) -> DataFrame:
    """YOLO lines: a class and four numbers in [0, 1]."""
    lines = texts.withColumn("line", F.explode(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), "\n")))
    parts = F.split(F.trim("line"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, 4), lambda p: p.try_cast("double"))
    good = (F.size(parts) >= 5) & F.forall(numbers, lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False)))
    files = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("total"), F.sum(good.cast("bigint")).alias("good"),
        F.sort_array(F.collect_set(F.when(good, parts[0]))).alias("classes"))
    yolo = F.col("good") > 0
    return _annotation(
        files, path=F.col("path"), format=F.lit("txt"), valid=F.lit(True), style=F.when(yolo, "yolo").otherwise("generic_txt"),
        annotations=F.col("total"), total_boxes=F.when(yolo, F.col("total")), valid_boxes=F.when(yolo, F.col("good")),
        names=F.when(yolo, F.col("classes")))


def annotations(files: DataFrame) -> DataFrame:
    """Annotation records of all JSON, XML and text files of a scan."""
    texts = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), extension(F.col("path")).alias("ext"))
    return (json_annotations(texts.filter("ext = 'json'")).unionByName(xml_annotations(texts.filter("ext = 'xml'")))
            .unionByName(text_annotations(texts.filter("ext = 'txt'"))))


def annotation_consistency(records: DataFrame) -> DataFrame:
    """Files, valid share and box validity per style."""
    return records.groupBy(F.coalesce("style", F.lit("unknown")).alias("style")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("valid").cast("bigint")).alias("valid_files"),
        F.avg(F.col("valid").cast("double")).alias("schema_consistency_rate"),
        ratio(F.sum("valid_boxes"), F.sum("total_boxes")).alias("bbox_validity_rate"))


def dataset_identity(files: DataFrame) -> DataFrame:
    """Counts of images and annotations, total bytes and an order-insensitive fingerprint of files (path, length, content or its sha256)."""
    ext = extension(F.col("path"))
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(20,0)")
    return files.agg(
        F.sum(ext.isin(*IMAGE_EXTENSIONS).cast("bigint")).alias("images"), F.sum(ext.isin("json", "xml", "txt", "csv").cast("bigint")).alias("annotation_files"),
        F.sum("length").alias("byte_size"), F.sha2(F.sum(word).cast("string"), 256).alias("fingerprint"))
