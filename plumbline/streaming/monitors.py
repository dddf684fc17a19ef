"""Audits over unbounded data with Structured Streaming. Each operator also runs on a batch frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.columns import PII_PATTERNS, col, missing_flag
from plumbline.operators import gate
from plumbline.sources.tables import work_directory


def windowed_audit(df: DataFrame, time: str, length: str, lateness: str, fields: Sequence[str], texts: Sequence[str],
                   ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing, personal-data and out-of-range rates per tumbling window; late rows fall to the watermark."""
    if df.isStreaming:
        df = df.withWatermark(time, lateness)
    missing = sum((missing_flag(df, c) for c in fields), F.lit(0)) / float(len(fields))
    hits = [col(c).rlike(p) for c in texts for p in PII_PATTERNS.values()]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    outside = [((col(c) < lo) | (col(c) > hi)).cast("double").alias(c) for c, (lo, hi) in ranges.items()]
    return df.groupBy(F.window(time, length)).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(missing).alias("missing_rate"),
        F.avg(F.coalesce(any_hit, F.lit(False)).cast("double")).alias("pii_rate"),
        *[F.avg(o).alias(f"out_of_range_{c}") for c, o in zip(ranges, outside)]).select(
        F.col("window.start").alias("window_start"), "rows", "missing_rate", "pii_rate", *[f"out_of_range_{c}" for c in ranges])


def gate_windows(windows: DataFrame, policy: str = gate.DEFAULT_POLICY, pii_threshold: float = 0.01) -> DataFrame:
    """Policy gate over windowed metrics, one run per window."""
    runs = windows.select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("run_id"), F.lit(None).cast("long").alias("score"),
                          F.col("missing_rate").alias("missingness"), *[F.lit(None).cast("double").alias(c) for c in (
                              "duplicate_rate", "split_leakage", "max_drift_ks", "max_positive_rate_disparity")],
                          (F.col("pii_rate") >= pii_threshold).cast("double").alias("pii_flag_count"))
    return gate.gate(gate.gate_checks(runs, presets=[policy]))


def rate_windows(df: DataFrame, time: str, length: str, slide: str | None, lateness: str, keys: Sequence[str],
                 **flags: Column) -> DataFrame:
    """Mean of 0/1 flags per key and (sliding) window: prequential accuracy, query rate, event rate."""
    if df.isStreaming:
        df = df.withWatermark(time, lateness)
    bucket = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"), *[F.avg(e.cast("double")).alias(k) for k, e in flags.items()]).select(
        *keys, F.col("window.start").alias("window_start"), "n", *flags)


def first_occurrences(df: DataFrame, keys: Sequence[str], time: str, lateness: str) -> DataFrame:
    """Suppresses repeated records (or repeated timestamps of an entity) that arrive within the watermark."""
    if df.isStreaming:
        return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def run_available(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Runs a streaming query over everything available and returns its result as a table.

    Batches go to files in the shared checkpoint folder. In update mode a window is written each time it
    changes, so the newest batch of each key is kept.
    """
    spark = stream.sparkSession
    home = work_directory(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A retried batch overwrites its own folder, so every batch counts once.
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{home}/out/batch=*")
    if mode == "update" and keys:
        newest = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
        out = out.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    return out.drop("_batch")


def gate_closed_windows(windows: DataFrame, home: str, policy: str = gate.DEFAULT_POLICY, pii_threshold: float = 0.01):
    """Starts a query that judges every window as it closes: one verdict row in ``home/verdicts`` for each, written with its batch.

    ``windows`` must come from a watermarked aggregate; in append mode a window is given out once, when the watermark has passed its
    end, so no verdict is ever taken back. A retried batch overwrites its own folder.
    """
    def judge(batch: DataFrame, batch_id: int) -> None:
        counted = batch.select(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("run_id"), F.col("rows").alias("window_rows"))
        verdicts = gate_windows(batch, policy, pii_threshold).join(counted, "run_id").withColumn("batch", F.lit(batch_id).cast("long"))
        verdicts.write.mode("overwrite").parquet(f"{home}/verdicts/batch={batch_id}")

    return (windows.writeStream.outputMode("append").option("checkpointLocation", f"{home}/state")
            .trigger(availableNow=True).foreachBatch(judge).start())


def write_batches(home: str, mode: str):
    """Starts the writer of ``run_available`` on a stream that is still fed: batch by batch into ``home/out``."""
    def start(stream: DataFrame):
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

        return (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state")
                .trigger(availableNow=True).foreachBatch(write).start())

    return start


def run_in_slices(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame],
                  start: Callable[[DataFrame], StreamingQuery], home: str) -> DataFrame:
    """Feeds a streaming query slice by slice and gives (arrived, dropped) of each micro-batch.

    Each slice arrives as files in ``home/in``, any number of them, and the query goes on from its checkpoint: a restart between any
    two micro-batches, as after a lost driver. ``arrived`` are the rows that an observed metric counts before the stateful operator,
    ``dropped`` those groups that the operator refused as too late.
    """
    spark, progress = slices[0].sparkSession, []
    for part in slices:
        part.write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{home}/in").observe("arrivals", F.count(F.lit(1)).alias("rows"))
        running = start(build(stream))
        running.awaitTermination()
        for p in running.recentProgress:
            seen = p.observedMetrics.get("arrivals") if p.observedMetrics else None
            progress.append((p.batchId, int(seen["rows"]) if seen is not None else 0, sum(o.numRowsDroppedByWatermark for o in p.stateOperators)))
    return spark.createDataFrame(progress, "batch long, arrived long, dropped long")


def written_batches(spark: SparkSession, home: str, folder: str = "out") -> DataFrame:
    """All rows that the batches of a query have written."""
    return spark.read.parquet(f"{home}/{folder}/batch=*")


def read_stream(spark, path: str, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema comes from the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))
