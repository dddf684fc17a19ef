"""Window operators against pandas on one hot series and several small ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import series
from plumbline.streaming import adaptive, monitors


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(5)
    n = 1500
    entity = np.where(np.arange(n) % 3 == 0, "hot", [f"e{i % 7}" for i in range(n)])
    start = pd.Timestamp("2024-01-01")
    ts = [start + pd.Timedelta(seconds=int(s)) for s in np.sort(rng.integers(0, 5 * 86400, n))]
    value = rng.normal(0, 0.1, n) + np.where(np.arange(n) > 900, 4.0, 0.0)
    pdf = pd.DataFrame({"entity": entity, "ts": ts, "id": np.arange(n), "x": value})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(6)
    return df, pdf


def _day():
    return F.date_trunc("day", "ts")


def test_positions(readings):
    df, pdf = readings
    got = series.positions(df, ["entity"], ["ts", "id"], _day()).toPandas().set_index("id")["_pos"].sort_index()
    want = pdf.sort_values(["ts", "id"]).groupby("entity").cumcount().add(1).sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()


def test_trailing_windows_across_chunks(readings):
    df, pdf = readings
    numbered = series.positions(df, ["entity"], ["ts", "id"], _day())
    pieces = series.chunks(numbered, 40, 9)
    from pyspark.sql import Window
    w = Window.partitionBy("entity", "_chunk").orderBy("_pos").rowsBetween(-9, 0)
    got = pieces.withColumn("m", F.avg("x").over(w)).filter(~F.col("_context")).toPandas().set_index("id")["m"].sort_index()
    want = pdf.sort_values(["ts", "id"]).groupby("entity")["x"].rolling(10, min_periods=1).mean().droplevel(0).sort_index()
    assert len(got) == len(pdf) and np.allclose(got, want)


def test_exponential_average(readings):
    df, pdf = readings
    got = series.exponential_average(df, ["entity"], ["ts", "id"], _day(), "x", alpha=0.9).toPandas().set_index("id")["ema"].sort_index()
    want = pdf.sort_values(["ts", "id"]).groupby("entity")["x"].transform(lambda s: s.ewm(alpha=0.9, adjust=False).mean()).sort_index()
    assert np.allclose(got, want)


@pytest.mark.parametrize("across", [False, True])
def test_steps(readings, across):
    df, pdf = readings
    got = series.steps(df, "ts", ["entity"], across_entities=across).toPandas()
    ordered = pdf.sort_values(["entity", "ts"], kind="mergesort")
    gaps = ordered["ts"].diff().dt.total_seconds()
    if not across:
        gaps = ordered.groupby("entity")["ts"].diff().dt.total_seconds()
    want = gaps.dropna().value_counts()
    assert dict(zip(got["step"], got["n"])) == {k: int(v) for k, v in want.items()}


def test_change_detection_equals_a_sequential_loop(readings):
    df, pdf = readings
    detector = adaptive.Detector(max_window=40, min_window=10, delta=0.9)
    got = adaptive.detect_changes(df, "entity", ["ts", "id"], "x", _day(), detector, chunk=50).toPandas()
    assert len(got) == len(pdf)
    for entity, part in pdf.sort_values(["ts", "id"]).groupby("entity"):
        window, alarms = [], []
        for x in part["x"]:
            window = (window + [x])[-40:]
            hit = False
            for cut in range(5, len(window) - 4):
                a, b = window[:cut], window[cut:]
                if len(window) >= 10 and abs(np.mean(a) - np.mean(b)) > np.sqrt(2 * np.log(2 / 0.9) * (1 / len(a) + 1 / len(b))):
                    hit = True
                    break
            if hit:
                window = window[len(window) // 2:]
            alarms.append(hit)
        mine = got[got["entity"] == entity].sort_values("position")["alarm"].tolist()
        assert mine == alarms
    assert got["alarm"].sum() > 0


def test_streaming_twin_equals_batch(spark, readings, tmp_path):
    df, _ = readings
    path = str(tmp_path / "in")
    stamped = df.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "id")
    for lo, hi in ((0, 500), (500, 1000), (1000, 1500)):
        stamped.filter(F.col("id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(path)
    detector = adaptive.Detector(max_window=40, min_window=10, delta=0.9)
    # one micro-batch: the order of rows inside a batch is by time
    stream = monitors.read_stream(spark, path, files_per_batch=100)
    got = monitors.run_available(adaptive.detect_changes_stream(stream, "entity", "ts", "x", detector)).toPandas()
    want = adaptive.detect_changes(df, "entity", ["ts"], "x", _day(), detector, chunk=50).toPandas()
    assert len(got) == len(want)
    a = got.groupby("key")["alarm"].sum().to_dict()
    b = want.groupby("entity")["alarm"].sum().to_dict()
    assert a == b


def test_streaming_windows_equal_batch(spark, readings, tmp_path):
    df, _ = readings
    path = str(tmp_path / "in")
    stamped = df.withColumns({"ts": F.col("ts").cast("timestamp"), "note": F.when(F.col("id") % 4 == 0, "a@b.org").otherwise("ok")})
    stamped.repartition(4).write.parquet(path)

    def audit(frame):
        return monitors.windowed_audit(frame, "ts", "1 day", "30 days", ["x", "note"], ["note"], {"x": (-1.0, 1.0)})

    got = monitors.run_available(audit(monitors.read_stream(spark, path)), "update", ["window_start"]).orderBy("window_start").toPandas()
    want = audit(stamped).orderBy("window_start").toPandas()
    pd.testing.assert_frame_equal(got, want, check_like=True)
    assert abs((want["pii_rate"] * want["rows"]).sum() - 375) < 1e-6


def test_unordered_chunk_context_is_refused(readings):
    with pytest.raises(ValueError):
        series.chunks(readings[0], 5, 6)
