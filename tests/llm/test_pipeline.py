"""The pipeline's stages on a small table with planted copies, and the registered queries."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mix", "BPE"]


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(0).union(spark.createDataFrame(
        [(9000, "12 34 !!", "en", "src0", 8), (9001, None, None, None, None), (9002, docs.first().text, "en", "src0", 0)], docs.schema))
    now = docs.union(extra).withColumn("score", docs["n_chars"]).withColumn("size", docs["n_chars"])
    columns, counts = now.columns, [now.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
            counts.append(now.count())
            ids = {r.doc_id for r in now.select("doc_id").collect()}
            if k == 0:
                assert counts[0] - counts[1] == 2 and not ids & {9000, 9001}
            if k == 1:
                assert 9002 in ids and docs.first().doc_id not in ids
            if k == 2:
                assert len(ids) == counts[-1]
    assert now.count() == counts[-1] and counts[1] > counts[2] >= counts[3]


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_empty_table_passes_all_stages(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
