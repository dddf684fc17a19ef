import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.sources import assets


def png(width, height, colour=(10, 20, 30), filter_kind=0):
    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    line = bytes(colour) * width
    if filter_kind == 1:
        line = bytes(colour) + b"\x00" * (3 * width - 3)
    raw = (bytes([filter_kind]) + line) * height
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def archive(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("assets")
    (root / "cat").mkdir()
    (root / "cat" / "a.png").write_bytes(png(20, 20))
    (root / "cat" / "b.png").write_bytes(png(20, 20, filter_kind=1))
    (root / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n1234")
    (root / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 2.0 0.5 0.1 0.1\n")
    (root / "b.json").write_text('{"images": [], "annotations": [1, 2], "categories": [{"name": "cat"}]}')
    (root / "c.xml").write_text("<annotation><object><name>x</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>2</ymax></bndbox></object></annotation>")
    (root / "d.xml").write_text("<annotation><object>")
    (root / "e.json").write_bytes(b"\xff\xfe{")
    return assets.read_files(spark, str(root))


@pytest.fixture(scope="module")
def images(spark, scan):
    folder = scan.filter("path like '%broken.png'").first()["path"].rsplit("/", 1)[0]
    return assets.decoded_images(spark, folder).filter("path like '%.png'")


def test_image_features(scan, images):
    found = assets.image_features(images, facts=assets.file_facts(scan))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert rows["a.png"]["open_ok"] and (rows["a.png"]["width"], rows["a.png"]["mean_b"]) == (20, 30.0)
    assert rows["b.png"]["mean_r"] == 10.0 and rows["b.png"]["entropy"] == 0.0
    assert not rows["broken.png"]["open_ok"] and len(rows["a.png"]["phash"]) == 16


@pytest.mark.parametrize("budget, ok", [(399, False), (400, True)])
def test_pixel_budget(images, budget, ok):
    found = assets.image_features(images.filter("path like '%a.png'"), assets.ArchiveLimits(pixels=budget)).first()
    assert found["open_ok"] == ok


def test_annotations(scan):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in assets.annotations(scan).collect()}
    assert (rows["a.txt"]["style"], rows["a.txt"]["total_boxes"], rows["a.txt"]["valid_boxes"]) == ("yolo", 2, 1)
    assert (rows["b.json"]["style"], rows["b.json"]["annotations"], rows["b.json"]["names"]) == ("coco", 2, ["cat"])
    assert (rows["c.xml"]["valid_boxes"], rows["c.xml"]["names"]) == (1, ["x"])
    assert not rows["d.xml"]["valid"] and not rows["e.json"]["valid"]


def test_archive_limits(spark):
    rows = [("ok", archive({"a.txt": "x" * 10})), ("many", archive({f"{i}": "x" for i in range(6)})),
            ("bomb", archive({"z": "0" * (2 << 20), "y": "ok"})), ("bad", b"PK not a zip")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")
    members = assets.archive_members(files)
    out = {r["path"]: r for r in assets.screen_archives(members, assets.ArchiveLimits(members=5)).collect()}
    assert out["ok"]["accepted"] == 1 and out["many"]["rejected"] == "too many files"
    assert (out["bomb"]["suspicious_ratio"], out["bomb"]["accepted"]) == (1, 1) and out["bad"]["rejected"] == "invalid archive"
    small = assets.ArchiveLimits(archive_bytes=5)
    tiny = assets.screen_archives(assets.archive_members(files, small), small).collect()
    assert {r["rejected"] for r in tiny} == {"archive too large"}


def test_spark_image_source_agrees(spark, scan, tmp_path):
    (tmp_path / "x.png").write_bytes(png(20, 20))
    (tmp_path / "y.png").write_bytes(b"nothing")
    (tmp_path / "z.webp").write_bytes(b"RIFF0000WEBP")
    found = {r["path"].rsplit("/", 1)[1]: (r["open_ok"], r["open_error"]) for r in assets.image_features(assets.decoded_images(spark, str(tmp_path))).collect()}
    assert found == {"x.png": (True, None), "y.png": (False, "corrupt"), "z.webp": (False, "no decoder")}


def test_folder_label(spark):
    rows = spark.createDataFrame([("z/cat/a.png",), ("a.png",)], "p string").select(assets.folder_label(F.col("p")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["cat", None]
