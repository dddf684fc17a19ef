"""Readers and writers of tables, metric frames and audit history."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import normalize_missing

RECORD_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("record_id", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("created_at_utc", T.StringType()),
    T.StructField("analyzer", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("file_sha256", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("grade", T.StringType()), T.StructField("verdict", T.StringType()),
    T.StructField("findings", T.ArrayType(T.StringType())), T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])
SNAPSHOT = ("missingness", "duplicate_rate", "split_leakage", "max_drift_ks", "max_positive_rate_disparity", "pii_flag_count",
            "corrupt_rate")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or Parquet by extension; anything else is an error. NaN is read as missing."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True)
        frame = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif lower.endswith((".parquet", ".pq")):
        frame = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    return normalize_missing(frame)


def write_records(reports: DataFrame, path: str) -> None:
    """Appends audit records as JSON, partitioned by analyzer.

    The metric snapshot is a map, so later metrics need no schema change.
    """
    entries = F.array(*[F.struct(F.lit(m), F.col(m).cast("double")) for m in SNAPSHOT])
    known = F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull())
    columns = [f.name for f in RECORD_SCHEMA if f.name != "metrics"]
    reports.select(*columns, known.alias("metrics")).write.mode("append").partitionBy("analyzer").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Audit history, newest first; unreadable records are skipped."""
    frame = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return frame.filter(F.col("run_id").isNotNull()).orderBy(F.desc("created_at_utc"), F.desc("record_id"))


def write_json(frame: DataFrame, path: str) -> None:
    """Any metric frame as JSON lines, NaN as null."""
    normalize_missing(frame).write.mode("overwrite").json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    flat = frame.select(*[
        (F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name))
        for f in frame.schema])
    flat.write.mode("overwrite").option("header", True).csv(path)


_own: dict[str, str] = {}


def work_directory(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory of the session, ``spark.checkpoint.dir``.

    Without that setting a session on one machine uses a temporary folder, which is all that such a session's tasks need; a
    cluster must name one that every executor reaches. What is written there lives until the folder is cleared: intermediate
    tables of an application can go when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{root.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a table in the shared folder, computed once."""
    path = work_directory(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_written: dict[tuple, str] = {}


def content_key(*frames: DataFrame) -> tuple:
    """Files, sizes and change times of the Parquet tables that frames read: another key when a table has changed."""
    parts = []
    for frame in frames:
        files = frame.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        row = files.agg(F.count(F.lit(1)), F.sum(F.hash("file_path", "file_size", "file_modification_time").cast("long"))).first()
        parts.append(tuple(row))
    return tuple(parts)


def materialized(spark: SparkSession, name: str, build, inputs: tuple = ()) -> DataFrame:
    """Writes an expensive table once per application and content of its inputs to the shared folder and reads it back.

    Unlike a cache it survives lost executors, and it cuts the lineage for everything built on it.
    """
    key = (spark.sparkContext.applicationId, name, content_key(*inputs))
    if key not in _written:
        path = work_directory(spark)
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
