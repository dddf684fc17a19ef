"""The audit of a folder of real files: scan, sample, near duplicates, score, and what happens without metadata or images."""

import struct

import pytest
from pyspark.sql import functions as F

from plumbline.plans import asset_audit as aa
from plumbline.sources import assets
from plumbline.sources.tables import work_directory


def _bmp(width, height, shade):
    row = b"".join(bytes([(shade + 9 * x) % 256] * 3) for x in range(width))
    pixels = (row + b"\0" * (-len(row) % 4)) * height
    head = struct.pack("<2sIHHI", b"BM", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(pixels), 2835, 2835, 0, 0)
    return head + pixels


@pytest.fixture(scope="module")
def root(spark):
    files = [(f"img/{i % 3}/{i}.bmp", _bmp(8 + i % 2, 8, 20 * (i % 6))) for i in range(24)]
    files += [("img/0/bad.bmp", b"BM"), ("ann/1.txt", b"0 0.5 0.5 0.1 0.1"), ("ann/2.json", b"{"), ("notes.md", b"other")]
    folder = f"{work_directory(spark)}/files"
    assert assets.write_files(spark.createDataFrame(files, "path string, content binary").repartition(4), folder) == len(files)
    return folder


def _values(metrics):
    return {(r["check"], r["key"], r["subject"]): r["value"] for r in metrics.collect()}


def test_scan_reads_what_was_written(spark, root):
    found = aa.scan(spark, root)
    rows = {r["path"]: r for r in found.images.collect()}
    assert len(rows) == 25 and not rows["img/0/bad.bmp"]["open_ok"]
    assert (rows["img/1/1.bmp"]["width"], rows["img/1/1.bmp"]["height"]) == (9, 8)
    assert {r["path"]: r["valid"] for r in found.annotations.collect()} == {"ann/1.txt": True, "ann/2.json": False}
    one = found.identity.first()
    assert (one["images"], one["annotation_files"]) == (25, 2)


def test_a_sample_is_the_same_whatever_the_partitions(spark, root):
    picks = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = aa.scan(spark, root, sample=7)
        picks.append({r["path"] for r in found.images.select("path").collect()})
        assert found.identity.first()["images"] == 25
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert picks[0] == picks[1] and len(picks[0]) == 7


def test_audit_without_metadata(spark, root):
    metrics = aa.asset_audit(aa.scan(spark, root))
    got = _values(metrics)
    assert got["readability", "corrupt_count", ""] == 1 and got["readability", "images_scanned", ""] == 25
    assert got["duplicates", "num_duplicate_sha256", ""] == 6
    assert got["duplicates", "exact_duplicate_rate", ""] == pytest.approx(18 / 25)
    assert got["near_duplicates", "near_duplicate_pairs", ""] >= 6 * 6  # four copies of each of six images
    report = aa.asset_report(metrics).first()
    assert report["verdict"] == "Needs review" and "Corrupt images present." in report["findings"]


def test_audit_with_metadata(spark, root):
    rows = [(f"img/{i % 3}/{i}.bmp", str(i % 3) if i else None, "train" if i % 2 else "test", 1) for i in range(24)]
    metadata = spark.createDataFrame(rows, "file string, kind string, split string, width int")
    roles = aa.AssetRoles(path="file", label="kind", split="split", groups=("kind",), ids=("file",))
    got = _values(aa.asset_audit(aa.scan(spark, root), metadata, roles, near=False))
    assert got["class_balance", "num_classes", ""] == 3
    assert got["split_coverage", "split_coverage", ""] == pytest.approx(24 / 25)
    assert got["datasheet", "completeness", ""] == pytest.approx(0.5)  # annotations, splits, labels, groups, metadata


def test_no_files(spark):
    folder = f"{work_directory(spark)}/none"
    assets.write_files(spark.createDataFrame([("notes.md", b"x")], "path string, content binary"), folder)
    found = aa.scan(spark, folder)
    assert found.images.count() == 0 and found.annotations.filter(F.col("valid")).count() == 0
    assert _values(aa.asset_audit(found, near=False))["readability", "images_scanned", ""] == 0


def test_files_are_read_once_for_their_bytes_and_once_for_their_pixels(spark, tmp_path, monkeypatch):
    folder = tmp_path.as_uri()
    rows = [(f"ann/{i}.txt", b"0 0.5 0.5 0.2 0.2") for i in range(20)] + [("broken.bmp", b"BM")]
    assets.write_files(spark.createDataFrame(rows, "path string, content binary"), folder)
    plans, write = [], aa.written

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(aa, "written", kept)
    found = aa.scan(spark, folder)
    assert sum(p.count("FileScan binaryFile") for p in plans) == 1 and sum(p.count("FileScan image") for p in plans) == 1
    assert found.annotations.count() == 20 and found.identity.first()["annotation_files"] == 20
    assert [(r["path"], r["open_error"], r["open_ok"]) for r in found.images.collect()] == [("broken.bmp", "corrupt", False)]
    assert "note" not in found.images.columns


def test_readable_and_corrupt_images_leave_one_scan(spark, tmp_path):
    bmp = bytes.fromhex("424D3A0000000000000036000000280000000100000001000000010018000000000004000000130B0000130B00000000000000000000") + b"\x01\x02\x03\x00"
    assets.write_files(spark.createDataFrame([("a.bmp", bmp), ("b.bmp", bmp[:40])], "path string, content binary"), tmp_path.as_uri())
    found = {r["path"].rsplit("/", 1)[-1]: r for r in assets.image_features(assets.decoded_images(spark, tmp_path.as_uri())).collect()}
    assert found["a.bmp"]["width"] == 1 and found["a.bmp"]["open_ok"] and found["a.bmp"]["entropy"] == 0.0
    assert found["b.bmp"]["blur_var_lap"] is None and found["b.bmp"]["open_error"] == "corrupt"
