"""Streams over several micro-batches, with a restart between any two, against sequential loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources.tables import work_directory
from plumbline.streaming import adaptive, monitors

START = datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp, x double"


def _rows():
    draw = random.Random(2)
    rows = [(i, draw.choice(["hot", "hot", "a", "b"]), START + timedelta(minutes=7 * i), draw.choice([None, 1.0, 1.0, draw.random() * 9, float(i % 5)])) for i in range(400)]
    return rows


def _slices(spark, rows, n=4):
    size = -(-len(rows) // n)
    return [spark.createDataFrame(rows[i:i + size], SCHEMA).repartition(3) for i in range(0, len(rows), size)]


def test_trailing_window_equals_numpy():
    draw = random.Random(1)
    values = [draw.choice([None, float(draw.randint(0, 5)), draw.random()]) for _ in range(500)]
    held = adaptive.TrailingWindow(20)
    for i, x in enumerate(values):
        held.push(x)
        now = [v for v in values[max(0, i - 19):i + 1] if v is not None]
        for level in (0.0, 0.3, 0.9, 1.0):
            assert held.quantile(level) == (pytest.approx(np.quantile(now, level)) if now else None)
        held = adaptive.TrailingWindow(20, list(held.ring))  # as read from the state


def test_review_budget_in_state(spark):
    rows, home = _rows(), work_directory(spark)
    monitors.run_in_slices(_slices(spark, rows), lambda s: adaptive.review_budget_stream(s, "key", ["ts", "id"], "x", 25, 0.1, 0.2), monitors.write_batches(home, "append"), home)
    got = {r["id"]: (r["tau2"], r["tau1"], r["query"], r["route"]) for r in monitors.written_batches(spark, home).collect()}
    assert len(got) == len(rows)
    windows = {}
    for i, key, _, x in rows:
        window = windows[key] = (windows.get(key, []) + [x])[-25:]
        now = [v for v in window if v is not None]
        t2, t1, asked, route = got[i]
        if not now:
            assert (t2, t1) == (None, None)
            continue
        assert t2 == pytest.approx(np.quantile(now, 0.9)) and t1 == pytest.approx(min(t2, np.quantile(now, 0.7)))
        assert asked == (None if x is None else x > t2)
        assert route == ("none" if x is None else "human" if x > t2 else "oracle" if x > t1 else "none")


def _windows(frame):
    return monitors.windowed_audit(frame, "ts", "6 hours", "1 hour", ["x"], ["key"], {"x": (0.0, 5.0)})


def test_windows_are_judged_as_they_close(spark):
    rows, home = _rows(), work_directory(spark)
    late = [(1000 + i, "late", START + timedelta(minutes=i), 1.0) for i in range(5)]
    slices = _slices(spark, rows)
    slices[2] = slices[2].unionByName(spark.createDataFrame(late, SCHEMA))
    slices.append(spark.createDataFrame([(None, None, START + timedelta(days=9), None)], SCHEMA))
    progress = monitors.run_in_slices(slices, _windows, lambda w: monitors.gate_closed_windows(w, home), home)
    verdicts = monitors.written_batches(spark, home, "verdicts").collect()
    assert len({r["run_id"] for r in verdicts}) == len(verdicts)
    assert len({r["batch"] for r in verdicts}) > 2  # while the stream runs, not after it
    counts = {}
    for _, _, ts, _ in rows:
        at = ts.replace(hour=ts.hour // 6 * 6, minute=0).strftime("%Y-%m-%dT%H:%M")
        counts[at] = counts.get(at, 0) + 1
    assert {r["run_id"]: r["window_rows"] for r in verdicts} == counts
    seen = progress.agg(F.sum("arrived").alias("arrived"), F.sum("dropped").alias("dropped")).first()
    assert seen["arrived"] == len(rows) + len(late) + 1 and seen["dropped"] > 0
    assert seen["arrived"] - sum(counts.values()) - 1 == len(late)


def test_detector_goes_on_after_a_restart(spark):
    draw = random.Random(5)
    rows = [(i, ("a", "b")[i % 3 == 0], START + timedelta(minutes=i // 4), draw.random() + (4 if i > 250 else 0)) for i in range(400)]
    detector = adaptive.Detector(40, 10, 0.9)
    home = work_directory(spark)
    monitors.run_in_slices(_slices(spark, rows, 5), lambda s: adaptive.detect_changes_stream(s, "key", "ts", "x", detector, idle="30 days", ties=["id"]), monitors.write_batches(home, "append"), home)
    got = {(r["key"], r["position"]): (r["value"], r["alarm"]) for r in monitors.written_batches(spark, home).collect()}
    for key in ("a", "b"):
        values = np.array([r[3] for r in rows if r[1] == key])
        size = 0
        for at in range(len(values)):
            size, alarm = detector.step(values, at, size)
            assert got[key, at + 1] == (values[at], alarm)


def test_short_series_need_no_size_maps_and_long_ones_agree_with_single_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    detector = adaptive.Detector(max_window=20, min_window=6, delta=0.9)
    series = {k: rng.exponential(1, n) + np.where(np.arange(n) > n // 2, 3.0, 0.0) for k, n in enumerate([1, 7, 19, 31, 32, 33, 64, 150])}
    series[3][5], series[7][40] = np.nan, np.inf

    def run(names):
        rows = [(k, i, float(x)) for k in names for i, x in enumerate(series[k])] + [(None, 0, 1.0)]
        found = adaptive.detect_changes(spark.createDataFrame(rows, "k long, i long, x double"), "k", ["i"], "x", F.floor(F.col("i") / 10), detector, chunk=32)
        return {(r["k"], r["position"]): r["alarm"] for r in found.collect()}

    def stepped(names):
        expected = {}
        for k in names:
            size = 0
            for at in range(len(series[k])):
                with np.errstate(invalid="ignore"):
                    size, alarm = detector.step(series[k], at, size)
                expected[k, at + 1] = alarm
        return expected

    assert run(series) == stepped(series) and any(stepped(series).values())
    monkeypatch.setattr(adaptive, "_start_sizes", None)  # short series must do without
    assert run(range(5)) == stepped(range(5))
