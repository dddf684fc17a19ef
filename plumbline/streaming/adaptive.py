"""Adaptive-window change detection per key, as a stream operator and as an exact parallel batch job.

The detector keeps a window of the newest values (at most ``max_window``). When two parts of it differ
in mean by more than sqrt(2 ln(2/delta) (1/n_left + 1/n_right)) it raises an alarm and keeps the newest
half. The window is therefore always the last m values of the series, so one number m is the whole
state. The batch job uses that: each chunk of a long series is run for the start sizes that can
reach it, the resulting size maps are composed along the chunks, and only then are alarms emitted.
A key with a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import col
from plumbline.operators.distribution import interval_count
from plumbline.operators.series import chunks, positions
from plumbline.sources.tables import written

#: Size maps that are composed in one task.
MAPS = 4096


@dataclass(frozen=True)
class Detector:
    max_window: int = 300
    min_window: int = 30
    delta: float = 0.08

    @property
    def half(self) -> int:
        return max(5, self.min_window // 2)

    def changed(self, window: np.ndarray) -> bool:
        """Does any admissible cut of the window separate two different means?"""
        n, half = len(window), self.half
        if n < self.min_window or n < 2 * half:
            return False
        left_n = np.arange(half, n - half + 1)
        sums = np.cumsum(window)
        left = sums[left_n - 1] / left_n
        right = (sums[-1] - sums[left_n - 1]) / (n - left_n)
        bound = np.sqrt(2.0 * math.log(2.0 / self.delta) * (1.0 / left_n + 1.0 / (n - left_n)))
        return bool(np.any(np.abs(left - right) > bound))

    def step(self, values: np.ndarray, at: int, size: int) -> tuple[int, bool]:
        """Window size after reading values[at] with ``size`` values before it, and the alarm."""
        size = min(size + 1, self.max_window)
        if self.changed(values[at + 1 - size:at + 1]):
            return size - size // 2, True
        return size, False


@lru_cache(maxsize=8)
def _bounds(detector: Detector) -> np.ndarray:
    """For each window size the difference of means that an alarm needs at each cut 1, 2, ...; infinite where no cut is admissible."""
    bounds = np.full((detector.max_window + 1, detector.max_window), np.inf)
    for n in range(max(detector.min_window, 2 * detector.half), detector.max_window + 1):
        left_n = np.arange(detector.half, n - detector.half + 1)
        bounds[n, left_n - 1] = np.sqrt(2.0 * math.log(2.0 / detector.delta) * (1.0 / left_n + 1.0 / (n - left_n)))
    return bounds


def _changed_rows(values: np.ndarray, sizes: np.ndarray, at: int, detector: Detector) -> np.ndarray:
    """``Detector.changed`` of the windows of ``sizes`` values that end at the rows from ``at`` on; all windows start together, or all are of one size."""
    widest = int(sizes.max())
    first = at + 1 - int(sizes[0])
    if sizes[0] == sizes[-1]:
        windows = np.lib.stride_tricks.sliding_window_view(values[first:at + len(sizes)], widest)
        sums = np.cumsum(windows, axis=1)
        totals = sums[:, -1:]
    else:
        sums = np.cumsum(values[first:at + len(sizes)])[None, :]
        totals = sums[0, sizes - 1][:, None]
    left_n = np.arange(1, widest + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gaps = np.abs(sums / left_n - (totals - sums) / (sizes[:, None] - left_n))
        return (gaps > _bounds(detector)[sizes, :widest]).any(axis=1)


def _stretches(values: np.ndarray, start: int, size: int, detector: Detector, rows: int = 64) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Runs the detector from row ``start`` with ``size`` values before it: (row behind the stretch, window sizes after each of its rows, alarm at its end).

    Between two alarms window sizes are known beforehand, so many rows are tested by one array operation.
    """
    at = start
    while at < len(values):
        count = min(rows, len(values) - at)
        if size < detector.max_window:
            count = min(count, detector.max_window - size)
        sizes = np.minimum(size + 1 + np.arange(count), detector.max_window)
        changed = _changed_rows(values, sizes, at, detector) if sizes[-1] >= detector.min_window else np.zeros(count, bool)
        alarm = bool(changed.any())
        if alarm:
            sizes = sizes[:int(changed.argmax()) + 1]
            sizes[-1] -= sizes[-1] // 2
        at, size = at + len(sizes), int(sizes[-1])
        yield at, sizes, alarm


def _run(values: np.ndarray, start: int, size: int, detector: Detector) -> tuple[int, list[bool]]:
    alarms = np.zeros(len(values) - start, bool)
    for at, sizes, alarm in _stretches(values, start, size, detector):
        alarms[at - start - 1], size = alarm, int(sizes[-1])
    return size, alarms.tolist()


def _size_map(values: np.ndarray, start: int, detector: Detector) -> list[int]:
    """End size for every start size 0..available; a run ends as soon as it has the size of an earlier one at the same row."""
    first = np.arange(min(start, detector.max_window) + 1)
    if start >= len(values):
        return first.tolist()
    seen, ends = np.full((len(first), len(values) - start), -1, np.int32), first.copy()
    for size in reversed(first.tolist()):
        for at, sizes, _ in _stretches(values, start, size, detector):
            seen[size, at - start - len(sizes):at - start] = sizes
            met = np.flatnonzero(seen[size + 1:, at - start - 1] == sizes[-1])
            ends[size] = sizes[-1]
            if len(met):
                ends[size] = ends[size + 1 + met[0]]
                break
    return ends.tolist()


def detect_changes(df: DataFrame, key: str, order: Sequence[str], value: str, period: Column,
                   detector: Detector = Detector(), chunk: int = 4096) -> DataFrame:
    """Batch detection: (key, position, value, alarm) for every row of every series that has a key.

    Series of one chunk start with an empty window and are run at once, many in a task; only chunks of longer ones need size maps.
    """
    named = df.select(key, *order, value).filter(col(key).isNotNull())
    numbered = written(positions(named, [key], list(order), period).select(
        col(key).alias("key"), "_pos", col(value).cast("double").alias("value")))
    pieces = chunks(numbered, chunk, detector.max_window)
    long = numbered.groupBy("key").agg(F.max("_pos").alias("_rows")).filter(F.col("_rows") > chunk)
    # a chunk that holds nothing but context is the tail of a series that ended before it
    starts = None if long.isEmpty() else _start_sizes(pieces.join(long, "key").filter(F.col("_chunk") * chunk < F.col("_rows")).drop("_rows"), detector)
    sized = pieces.withColumn("size", F.lit(0)) if starts is None else pieces.join(starts, ["key", "_chunk"], "left").fillna(0, ["size"])
    # numbers run without holes, so each piece holds the row that it begins with
    begins = F.col("_pos") == F.greatest(F.lit(1), F.col("_chunk") * chunk - detector.max_window + 1)
    sized = sized.select("key", "_chunk", "_pos", "value", "_context", "size", begins.alias("_begins"))
    dealt = sized.repartition(interval_count(df), "key", "_chunk").sortWithinPartitions("key", "_chunk", "_pos")

    def flagged(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of whole pieces, context aside, with their alarms."""
        values, context = pdf["value"].to_numpy(), pdf["_context"].to_numpy()
        edges = [*np.flatnonzero(pdf["_begins"].to_numpy()).tolist(), len(pdf)]
        sizes, flags = pdf["size"].to_numpy(), np.zeros(len(pdf), bool)
        for low, high in zip(edges, edges[1:]):
            inside = int(context[low:high].sum())
            flags[low + inside:high] = _run(values[low:high], inside, int(sizes[low]), detector)[1]
        return pdf[["key", "_pos", "value"]].assign(alarm=flags)[~context]

    def alarms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last piece, which may go on in the next batch
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            begun = np.flatnonzero(rows["_begins"].to_numpy())
            last = int(begun[-1]) if len(begun) else 0
            yield flagged(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None:
            yield flagged(held)

    key_type = df.schema[key].dataType.simpleString()
    return dealt.mapInPandas(alarms, f"key {key_type}, _pos long, value double, alarm boolean").select(
        F.col("key").alias(key), F.col("_pos").alias("position"), "value", "alarm")


def _start_sizes(pieces: DataFrame, detector: Detector) -> DataFrame:
    """(key, _chunk, size): the window's size at the start of each chunk of each series."""
    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        start = int(pdf["_context"].sum())
        found = _size_map(pdf["value"].to_numpy(), start, detector)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1], "sizes": [found]})

    key_type = pieces.schema["key"].dataType.simpleString()
    moves = pieces.groupBy("key", "_chunk").applyInPandas(maps, f"key {key_type}, _chunk long, sizes array<int>")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each chunk of a block the map from the size at the block's start; with the last one that of the whole block."""
        pdf = pdf.sort_values("_chunk")
        maps = [np.asarray(m) for m in pdf["sizes"]]
        now, before = np.arange(len(maps[0])), []
        for m in maps:
            before.append(now.tolist())
            now = m[now]
        whole = [None] * (len(maps) - 1) + [now.tolist()]
        return pd.DataFrame({"key": pdf["key"], "_block": pdf["_block"], "_chunk": pdf["_chunk"], "before": before, "whole": whole})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        """The size at the start of each block of a series."""
        pdf = pdf.sort_values("_block")
        size, sizes = 0, []
        for m in pdf["whole"]:
            sizes.append(size)
            size = int(m[size])
        return pd.DataFrame({"key": pdf["key"], "_block": pdf["_block"], "start": sizes})

    # Compose the maps: inside blocks of chunks, then along the blocks of a series, so that memory grows with neither's square.
    blocked = moves.withColumn("_block", F.floor(F.col("_chunk") / MAPS).cast("long"))
    composed = written(blocked.groupBy("key", "_block").applyInPandas(
        inside, f"key {key_type}, _block long, _chunk long, before array<int>, whole array<int>"))
    heads = composed.filter("whole is not null").select("key", "_block", "whole").groupBy("key").applyInPandas(
        along, f"key {key_type}, _block long, start int")
    return composed.join(heads, ["key", "_block"]).select("key", "_chunk", F.element_at("before", F.col("start") + 1).alias("size"))


def alarm_windows(detected: DataFrame, key: str, length: int, base: float, raised: float) -> DataFrame:
    """Label budget per row: ``raised`` for the ``length`` rows after an alarm, else ``base``.

    Looks back over a bounded number of rows, so each (key, block of rows) is one small window.
    """
    block = max(4096, 8 * length)
    numbered = detected.withColumn("_pos", F.col("position"))
    pieces = chunks(numbered, block, length)
    recent = Window.partitionBy(key, "_chunk").orderBy("_pos").rowsBetween(-length, -1)
    raised_now = F.coalesce(F.max(F.col("alarm").cast("int")).over(recent), F.lit(0)) == 1
    out = pieces.withColumn("budget", F.when(raised_now, raised).otherwise(base))
    return out.filter(~F.col("_context")).drop("_chunk", "_context", "_pos")


def detect_changes_stream(stream: DataFrame, key: str, time: str, value: str, detector: Detector = Detector(),
                          alarm_length: int = 100, idle: str = "1 hour", lateness: str = "10 minutes", ties: Sequence[str] = ()) -> DataFrame:
    """The same detector on a stream; state per key: the window, the row count and the alarm end.

    Rows of a micro-batch are taken by time, equal times by ``ties``. The watermark expires keys that stay silent for ``idle``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    key_type = stream.schema[key].dataType.simpleString()

    def update(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window, count, until = state.get if state.exists else ([], 0, -1)
        window = list(window)
        rows = pd.concat(list(batches)).sort_values([time, *ties], kind="stable")
        out = []
        for ts, x in zip(rows[time], rows[value]):
            window = (window + [float(x)])[-detector.max_window:]
            count += 1
            budgeted = count <= until
            alarm = detector.changed(np.asarray(window))
            if alarm:
                window, until = window[len(window) // 2:], max(until, count + alarm_length)
            out.append((name[0], ts, count, float(x), alarm, budgeted))
        state.update((window, count, until))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["key", time, "position", "value", "alarm", "raised_budget"])

    return stream.withWatermark(time, lateness).select(key, time, *ties, value).groupBy(key).applyInPandasWithState(
        update, f"key {key_type}, {time} timestamp, position long, value double, alarm boolean, raised_budget boolean",
        "window array<double>, count long, until long", "append", "EventTimeTimeout")


class TrailingWindow:
    """The last ``size`` values of a series in order of arrival, nulls among them, and its numbers in order of value.

    The ring is the state that is kept; the sorted list is made from it once and then follows each value by one insertion and one removal.
    """

    def __init__(self, size: int, values: Sequence[float | None] = ()) -> None:
        self.size, self.ring, self.ordered = size, deque(values), sorted(x for x in values if x is not None)

    def push(self, value: float | None) -> None:
        self.ring.append(value)
        if value is not None:
            bisect.insort(self.ordered, value)
        gone = self.ring.popleft() if len(self.ring) > self.size else None
        if gone is not None:
            del self.ordered[bisect.bisect_left(self.ordered, gone)]

    def quantile(self, level: float) -> float | None:
        """Linearly interpolated quantile; null while no value has come."""
        if not self.ordered:
            return None
        at = level * (len(self.ordered) - 1)
        low = int(at)
        high = min(low + 1, len(self.ordered) - 1)
        if low == at:
            return self.ordered[low]
        return (high - at) * self.ordered[low] + (at - low) * self.ordered[high]


def review_budget_stream(stream: DataFrame, key: str, order: Sequence[str], value: str, window: int, human: float, oracle: float = 0.0,
                         idle: str = "30 days", lateness: str = "10 minutes") -> DataFrame:
    """Review budget on a stream: thresholds are trailing quantiles that each key carries in its state.

    Gives (key, order..., value, tau2, tau1, query, route) of every row. ``order`` names the event time and then what breaks its ties; the rows of a
    micro-batch are taken in that order, and later batches must bring later rows of a key, as a log does. The state is a ring of
    the values of the last ``window`` rows, whatever number of rows a key has; a key that stays silent for ``idle`` of event time is forgotten.
    A row whose value is null takes a place in the window, as in a frame of rows, and is not asked about.
    """
    upper, lower = 1.0 - min(max(human, 0.0), 1.0), 1.0 - min(max(human + oracle, 0.0), 1.0)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    time, kinds = order[0], dict(stream.dtypes)

    def update(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = TrailingWindow(window, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        out = []
        for x in rows[value]:
            x = None if pd.isna(x) else float(x)
            held.push(x)
            tau2, tau1 = held.quantile(upper), held.quantile(lower)
            tau1 = None if tau1 is None else min(tau1, tau2)
            asked = None if x is None else x > tau2
            out.append((tau2, tau1, asked, "none" if x is None else "human" if asked else "oracle" if x > tau1 else "none"))
        state.update((list(held.ring),))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        found = pd.DataFrame(out, columns=["tau2", "tau1", "query", "route"])
        yield pd.concat([pd.DataFrame({key: [name[0]] * len(rows)}), rows[[*order, value]].reset_index(drop=True), found], axis=1)

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order, value))
    return stream.withWatermark(time, lateness).select(key, *order, value).groupBy(key).applyInPandasWithState(
        update, f"{columns}, tau2 double, tau1 double, query boolean, route string", "ring array<double>", "append", "EventTimeTimeout")


def uncertainty(probabilities: Column, alpha: float = 1.0) -> Column:
    """Entropy plus alpha times one minus the margin of a class-probability array."""
    p = F.transform(probabilities, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(1e-12), x.cast("double"))))
    entropy = -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.ln(x))
    ranked = F.sort_array(probabilities, asc=False)
    margin = F.when(F.size(ranked) >= 2, F.element_at(ranked, 1) - F.element_at(ranked, 2)).otherwise(F.element_at(ranked, 1))
    return entropy + alpha * (1.0 - margin)
