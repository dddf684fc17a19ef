"""Queries on files: archives, images and annotations, built by Spark from the given tables."""

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import dedup, security, suggest
from plumbline.plans.registry import query
from plumbline.sources import assets, fixtures as fx
from plumbline.sources.fixtures import table


def text_archives(spark, sf):
    """One zip per document with its text; every tenth file is cut off and unreadable."""
    def build(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("text.txt", text)
                    archive.writestr("id.txt", str(doc_id))
                data = buffer.getvalue()
                data = data[:30] if doc_id % 10 == 0 else data
                rows.append((f"a/{doc_id}.zip", len(data), data))
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(build, "path string, length long, content binary")


@query("""SELECT 'a/' || doc_id || '.zip' AS path, doc_id % 10 <> 0 AS valid, CAST(CASE WHEN doc_id % 10 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS members,
  CAST(CASE WHEN doc_id % 10 <> 0 THEN strlen(text) + strlen(CAST(doc_id AS VARCHAR)) ELSE 0 END AS BIGINT) AS expanded_bytes,
  CASE WHEN doc_id % 10 = 0 THEN 'invalid archive' WHEN strlen(text) + strlen(CAST(doc_id AS VARCHAR)) > 100000 THEN 'expands too far' END AS rejected,
  CAST(CASE WHEN doc_id % 10 = 0 OR strlen(text) + strlen(CAST(doc_id AS VARCHAR)) > 100000 THEN 0 ELSE 2 - (strlen(text) > 20000)::INT END AS BIGINT) AS accepted FROM documents""")
def archive_screening(spark, sf):
    members = assets.archive_members(text_archives(spark, sf))
    limits = assets.ArchiveLimits(expanded_bytes=100000, member_bytes=20000)
    return assets.screen_archives(members, limits).select("path", "valid", "members", "expanded_bytes", "rejected", "accepted")


def vector_images(spark, sf):
    """Each embedding as a decoded grey image below a folder named after its label, in the form that Spark's image source gives.

    Sizes are 8x8, 16x4 and 4x16; every 20th can't be decoded.
    """
    grey = F.transform("embedding", lambda e: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (e * F.lit(256.0).cast("float") + F.lit(128.0).cast("float")).cast("double")))))
    data = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    key, broken = F.col("vec_id"), F.col("vec_id") % 20 == 0
    wide = F.when(key % 3 == 0, 16).when(key % 3 == 1, 4).otherwise(8)
    tall = F.when(key % 3 == 0, 4).when(key % 3 == 1, 16).otherwise(8)
    path = F.concat(F.lit("img/"), "label", F.lit("/"), "vec_id", F.lit(".png"))
    minus = F.lit(-1)
    return table(spark, sf, "embeddings").select(path.alias("path"), F.struct(
        F.when(broken, minus).otherwise(tall).alias("height"), F.when(broken, minus).otherwise(wide).alias("width"),
        F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))


def vector_files(spark, sf):
    """The bytes of the same files: an EXIF block with a maker in every 15th, and with a position in every 30th."""
    def build(batches):
        for batch in batches:
            rows = []
            for path, vec_id in zip(batch["path"], batch["vec_id"]):
                tags = [(271, 2, 4, b"abc\0")] + ([(34853, 4, 1, struct.pack("<I", 8))] if vec_id % 30 == 0 else [])
                block = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHI", *t[:3]) + t[3] for t in tags) + b"\0" * 4
                rows.append((path, struct.pack("<q", vec_id) + (b"Exif\0\0" + block if vec_id % 15 == 0 else b"")))
            yield pd.DataFrame(rows, columns=["path", "content"])

    named = table(spark, sf, "embeddings").select(F.concat(F.lit("img/"), "label", F.lit("/"), "vec_id", F.lit(".png")).alias("path"), "vec_id")
    return named.mapInPandas(build, "path string, content binary")


@query("""SELECT count(*) AS images_scanned, count(*) FILTER (vec_id % 20 = 0) AS corrupt_count, round(avg((vec_id % 20 = 0)::INT), 6) AS corrupt_rate,
  round(avg((vec_id % 20 <> 0)::INT), 6) AS readability_rate FROM embeddings""")
def image_readability(spark, sf):
    return assets.readability(assets.image_features(vector_images(spark, sf)))


@query("""WITH p AS (SELECT vec_id, unnest(embedding) AS e FROM embeddings WHERE vec_id % 20 <> 0), g AS (SELECT vec_id, CAST(floor(least(255, greatest(0, e * 256::FLOAT + 128::FLOAT))) AS DOUBLE) AS g FROM p)
SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 4 ELSE 8 END AS width, CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 8 END AS height,
  round(avg(g), 4) AS brightness_mean, round(stddev_pop(g), 4) AS color_std_mean FROM g GROUP BY 1""", digits=4)
def image_statistics(spark, sf):
    found = assets.image_features(vector_images(spark, sf)).filter("open_ok")
    return found.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("bigint").alias("vec_id"), "width", "height", "brightness_mean", "color_std_mean")


@query("""WITH s AS (SELECT CASE WHEN vec_id % 3 = 2 THEN 8 ELSE 4 END AS v FROM embeddings WHERE vec_id % 20 <> 0)
SELECT count(*) FILTER (v < 6) AS low_res_count, round(avg((v < 6)::INT), 6) AS low_res_rate, min(v)::DOUBLE AS min, round(quantile_cont(v, 0.1), 6) AS p10,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, max(v)::DOUBLE AS max FROM s""")
def image_resolution(spark, sf):
    return assets.resolution(assets.image_features(vector_images(spark, sf)), 6)


@query()
def image_blur_and_hash(spark, sf):
    """Blur rate and near duplicates of the image set."""
    found = assets.image_features(vector_images(spark, sf))
    near = dedup.near_duplicates(found, "path", "phash")
    return assets.blur(found, 500.0).withColumn("near_duplicate_pairs", near.select("near_duplicate_pairs").scalar())


@query("""WITH g AS (SELECT vec_id, CAST(floor(least(255, greatest(0, e * 256::FLOAT + 128::FLOAT))) AS DOUBLE) AS g, i FROM
  (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id % 3 = 2)),
l AS (SELECT g.vec_id, u.g + d.g + w.g + r.g - 4 * g.g AS v FROM g JOIN g u ON u.vec_id = g.vec_id AND u.i = g.i - 8 JOIN g d ON d.vec_id = g.vec_id AND d.i = g.i + 8
  JOIN g w ON w.vec_id = g.vec_id AND w.i = g.i - 1 AND g.i % 8 > 0 JOIN g r ON r.vec_id = g.vec_id AND r.i = g.i + 1 AND g.i % 8 < 7)
SELECT vec_id, round(var_pop(v), 4) AS blur_var_lap FROM l GROUP BY 1""", digits=4)
def image_blur(spark, sf):
    """Variance of the Laplacian of the square images."""
    found = assets.image_features(vector_images(spark, sf)).filter("open_ok AND width = height")
    return found.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("bigint").alias("vec_id"), "blur_var_lap")


@query("""SELECT count(*) AS images, count(*) FILTER (vec_id % 15 = 0) AS exif_images, count(*) FILTER (vec_id % 30 = 0) AS gps_images,
  round(avg((vec_id % 30 = 0)::INT), 6) AS gps_rate FROM embeddings""")
def image_exif_privacy(spark, sf):
    facts = assets.file_facts(vector_files(spark, sf))
    return security.exif_privacy(assets.image_features(vector_images(spark, sf), facts=facts))


@query("SELECT CAST(label AS VARCHAR) AS folder_label, count(*) AS n FROM embeddings GROUP BY 1")
def image_folder_labels(spark, sf):
    return vector_images(spark, sf).groupBy(assets.folder_label(F.col("path")).alias("folder_label")).agg(F.count(F.lit(1)).alias("n"))


# annotations

def box_texts(spark, sf):
    """A YOLO file per order: one line per line item; quantities above 45 fall outside the unit square."""
    line = F.concat_ws(" ", "l_returnflag", "l_discount", "l_tax", F.col("l_quantity") / 45, F.col("l_quantity") / 100)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text")).select(
        F.concat(F.lit("ann/"), "l_orderkey", F.lit(".txt")).alias("path"), "text")


@query("""WITH f AS (SELECT 'ann/' || l_orderkey || '.txt' AS path, count(*) AS t, count(*) FILTER (l_quantity <= 45) AS g FROM lineitem GROUP BY 1)
SELECT path, CASE WHEN g > 0 THEN 'yolo' ELSE 'generic_txt' END AS style, t AS annotations, CASE WHEN g > 0 THEN t END AS total_boxes, CASE WHEN g > 0 THEN g END AS valid_boxes FROM f""")
def text_annotation_boxes(spark, sf):
    return assets.text_annotations(box_texts(spark, sf)).select("path", "style", "annotations", "total_boxes", "valid_boxes")


def json_texts(spark, sf):
    """JSON files in four shapes from documents; every 11th is cut off."""
    k = F.col("doc_id")
    boxes = F.array_join(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit('{"id":'), i, F.lit("}"))), ",")
    coco = F.concat(F.lit('{"images":[{"id":1},{"id":2}],"annotations":['), boxes, F.lit('],"categories":[{"name":"a"},{"name":"b"},{"name":"c"}]}'))
    labelme = F.concat(F.lit('{"shapes":['), boxes, F.lit('],"version":"5"}'))
    text = (F.when(k % 11 == 0, '{"images":[').when(k % 4 == 0, coco).when(k % 4 == 1, labelme)
            .when(k % 4 == 2, F.concat(F.lit("["), boxes, F.lit("]"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}"))))
    return table(spark, sf, "documents").select(F.concat(F.lit("ann/"), k, F.lit(".json")).alias("path"), text.alias("text"))


@query("""SELECT 'ann/' || doc_id || '.json' AS path, doc_id % 11 <> 0 AS valid,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'coco' WHEN doc_id % 4 = 1 THEN 'labelme' WHEN doc_id % 4 = 2 THEN 'json_array' ELSE 'generic_json' END AS style,
  CAST(CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 < 3 THEN doc_id % 5 + 1 END AS BIGINT) AS annotations, CAST(CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 = 0 THEN 3 END AS BIGINT) AS categories FROM documents""")
def json_annotation_shapes(spark, sf):
    return assets.json_annotations(json_texts(spark, sf)).select("path", "valid", "style", "annotations", "categories")


def xml_texts(spark, sf):
    """VOC files from parts with two boxes each; large sizes invert a box, every 13th file is malformed."""
    k = F.col("p_partkey")
    box = "<object><name>{n}</name><bndbox><xmin>{x}</xmin><ymin>0</ymin><xmax>"
    text = F.concat(F.lit("<annotation><folder>f</folder>" + box.format(n="a", x=10)), F.col("p_size") + 1, F.lit("</xmax><ymax>5</ymax></bndbox></object>"),
                    F.lit(box.format(n="b", x=0) + "9</xmax><ymax>9</ymax></bndbox></object></annotation>"))
    return table(spark, sf, "part").select(F.concat(F.lit("ann/"), k, F.lit(".xml")).alias("path"),
                                           F.when(k % 13 == 0, "<annotation><object>").otherwise(text).alias("text"))


@query("""SELECT 'ann/' || p_partkey || '.xml' AS path, p_partkey % 13 <> 0 AS valid, CASE WHEN p_partkey % 13 <> 0 THEN 'pascal_voc' END AS style,
  CAST(CASE WHEN p_partkey % 13 <> 0 THEN 2 END AS BIGINT) AS total_boxes, CAST(CASE WHEN p_partkey % 13 <> 0 THEN 1 + (p_size + 1 > 10)::INT END AS BIGINT) AS valid_boxes FROM part""")
def xml_annotation_boxes(spark, sf):
    return assets.xml_annotations(xml_texts(spark, sf)).select("path", "valid", "style", "total_boxes", "valid_boxes")


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN 'pascal_voc' ELSE 'unknown' END AS style, p_partkey % 13 <> 0 AS valid, 2 AS t, 1 + (p_size + 1 > 10)::INT AS v FROM part)
SELECT style, count(*) AS files, count(*) FILTER (valid) AS valid_files, round(avg(valid::INT), 6) AS schema_consistency_rate,
  round(sum(v) FILTER (valid) / sum(t) FILTER (valid), 6) AS bbox_validity_rate FROM x GROUP BY 1""")
def annotation_consistency(spark, sf):
    return assets.annotation_consistency(assets.xml_annotations(xml_texts(spark, sf)))


# roles

@query("""WITH c AS (SELECT 'split' AS "column", split AS v FROM faulted UNION ALL SELECT 'o_orderpriority', lower(o_orderpriority) FROM faulted WHERE o_orderpriority IS NOT NULL)
SELECT "column", max(regexp_matches(v, 'train|test|val|valid|dev')::INT) = 1 AS split_like FROM c GROUP BY 1""".replace("WITH c", "WITH " + fx.FAULTED_SQL + ", c"))
def split_value_sniffing(spark, sf):
    from plumbline.operators.distribution import value_counts
    from plumbline.operators.profile import _texts
    orders = fx.faulted_orders(spark, sf)
    return suggest.split_like_columns(value_counts(_texts(orders, ["split", "o_orderpriority"]), ["column"]))
