"""Order statistics of many runs over the same rows, which each run weighs, blanks or shifts; rows are never multiplied by runs.

A row is (cell, late, side, numbers): how a run treats it follows from its ``cell``, of which there is a fixed number, and numbers of late rows are
shifted by the run's amounts. Tasks hold a bounded chunk of rows and loop over runs; only summaries of chunks, values near a wanted rank and rows
of a range of values are shuffled. What comes to the driver is a row for each run and column, or for each range of values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.operators.distribution import bounded_rows, interval_count

#: Rows that a task summarises at a time, and steps of a summary: a rank is known to two of them.
CHUNK, STEPS = 1 << 17, 500


@dataclass(frozen=True)
class Runs:
    """How often each run takes a row of a cell (cells x runs), whether it keeps its numbers (columns x cells x runs), and shifts of late rows (columns x runs)."""

    copies: np.ndarray
    kept: np.ndarray
    shifts: np.ndarray

    @property
    def columns(self) -> int:
        return len(self.shifts)

    def __len__(self) -> int:
        return self.copies.shape[1]


@dataclass(frozen=True)
class Chunk:
    """Rows as arrays; missing numbers are NaN."""

    cell: np.ndarray
    late: np.ndarray
    side: np.ndarray
    numbers: tuple[np.ndarray, ...]

    def number(self, runs: Runs, column: int, run: int) -> np.ndarray:
        """A run's numbers, missing where it blanks them."""
        shift, own = runs.shifts[column, run], self.numbers[column]
        own = np.where(self.late, own + shift, own) if shift else own
        return np.where(runs.kept[column, self.cell, run], own, np.nan)


def _chunks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[Chunk]:
    held, count = [], 0

    def whole() -> Chunk:
        table = pa.Table.from_batches(held)
        cell, late, side, *numbers = (c.to_numpy() for c in table.columns[:3 + columns])
        return Chunk(cell.astype(np.int64), late.astype(bool), side, tuple(np.asarray(x, np.float64) for x in numbers))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= CHUNK:
            yield whole()
            held, count = [], 0
    if held:
        yield whole()


#: The series of a chunk, one for each statistic: its number, values (NaN: missing) and the run.
Measure = Callable[[Chunk], Iterator[tuple[int, np.ndarray, int]]]


def _summaries(runs: Runs, measure: Measure):
    """Tasks that give each statistic's number of values and evenly spaced order statistics of each chunk."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, runs.columns):
            found = []
            for stat, values, run in measure(chunk):
                weight = np.where(np.isnan(values), 0, runs.copies[chunk.cell, run])
                order = np.argsort(values, kind="stable")
                order = order[weight[order] > 0]
                if len(order):
                    cum = np.cumsum(weight[order])
                    at = np.searchsorted(cum, np.linspace(0, cum[-1] - 1, min(STEPS, int(cum[-1])) + 1).astype(np.int64), side="right")
                    found.append((stat, int(cum[-1]), values[order][at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                                  pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["stat", "mass", "points"])

    return task


def _brackets(point: float):
    """From a statistic's summaries the values between which the wanted rank is certain to lie."""

    def group(table: pa.Table) -> pa.Table:
        mass = table["mass"].to_numpy()
        points = [np.asarray(p.values) for p in table["points"]]
        total = int(mass.sum())
        every = np.unique(np.concatenate(points))
        least, most = np.zeros(len(every)), np.zeros(len(every))  # values at or below, and values below
        for m, p in zip(mass, points, strict=True):
            step = (m - 1) / (len(p) - 1)
            through = np.searchsorted(p, every, side="right")
            least += np.where(through > 0, np.floor((through - 1) * step), 0)
            most += np.where(through < len(p), np.minimum(m, np.ceil(np.searchsorted(p, every, side="left") * step) + 1), m)
        rank = point * (total - 1)
        under, over = every[most <= np.floor(rank)], every[least > np.ceil(rank) + 1]
        return pa.table({"stat": [table["stat"][0].as_py()], "total": [total], "low": [float(under[-1]) if len(under) else -np.inf],
                         "high": [float(over[0]) if len(over) else np.inf]})

    return group


def _near(runs: Runs, measure: Measure, ends: dict[int, tuple[float, float]]):
    """Tasks that count the values below each bracket and give those inside with their counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, runs.columns):
            found = []
            for stat, values, run in measure(chunk):
                if stat not in ends:
                    continue
                weight, (low, high) = runs.copies[chunk.cell, run], ends[stat]
                inside = (values >= low) & (values <= high) & (weight > 0)
                own, place = np.unique(values[inside], return_inverse=True)
                found.append((stat, int(weight[values < low].sum()), own, np.bincount(place, weight[inside], len(own)).astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array([f[3] for f in found], pa.list_(pa.int64()))],
                    ["stat", "below", "values", "counts"])

    return task


def _ranked(point: float, totals: dict[int, int]):
    """The linearly interpolated quantile of a statistic from the values in its bracket."""

    def group(table: pa.Table) -> pa.Table:
        stat, below = table["stat"][0].as_py(), int(table["below"].to_numpy().sum())
        values, counts = (np.concatenate([np.asarray(x.values) for x in table[c]]) for c in ("values", "counts"))
        order = np.argsort(values)
        cum = below + np.cumsum(counts[order])
        rank = point * (totals[stat] - 1)
        at = np.searchsorted(cum, [np.floor(rank), np.ceil(rank)], side="right")
        if below > np.floor(rank) or at[1] >= len(values):
            raise ValueError(f"rank {rank} lies outside its bracket")
        low, high = values[order][at]
        return pa.table({"stat": [stat], "value": [float(low + (high - low) * (rank - np.floor(rank)))]})

    return group


def quantile(rows: DataFrame, runs: Runs, measure: Measure, stats: int, point: float) -> np.ndarray:
    """The exact interpolated quantile of each statistic; NaN where it has no values."""
    summaries = rows.mapInArrow(_summaries(runs, measure), "stat long, mass long, points array<double>")
    ends = bounded_rows(summaries.groupBy("stat").applyInArrow(_brackets(point), "stat long, total long, low double, high double"), stats)
    near = rows.mapInArrow(_near(runs, measure, {r["stat"]: (r["low"], r["high"]) for r in ends}),
                           "stat long, below long, values array<double>, counts array<long>")
    found = near.groupBy("stat").applyInArrow(_ranked(point, {r["stat"]: r["total"] for r in ends}), "stat long, value double")
    out = np.full(stats, np.nan)
    for r in bounded_rows(found, stats):
        out[r["stat"]] = r["value"]
    return out


def anomaly_p99(rows: DataFrame, runs: Runs) -> np.ndarray:
    """p99 of the row anomaly score of each run: the mean distance of a row's numbers from the median, in MADs."""
    n, columns = len(runs), runs.columns

    def numbers(chunk: Chunk):
        for stat in range(columns * n):
            yield stat, chunk.number(runs, stat // n, stat % n), stat % n

    medians = quantile(rows, runs, numbers, columns * n, 0.5)

    def gaps(chunk: Chunk):
        for stat, values, run in numbers(chunk):
            yield stat, np.abs(values - medians[stat]), run

    mads = quantile(rows, runs, gaps, columns * n, 0.5)

    def scores(chunk: Chunk):
        for run in range(n):
            total, used = np.zeros(len(chunk.cell)), np.zeros(len(chunk.cell), np.int64)
            for stat in (c * n + run for c in range(columns)):
                if mads[stat] > 0:
                    part = np.abs(chunk.number(runs, stat // n, run) - medians[stat]) / mads[stat]
                    total, used = total + np.where(np.isnan(part), 0.0, part), used + ~np.isnan(part)
            yield run, np.where(used > 0, total / np.maximum(used, 1), np.nan), run

    return quantile(rows, runs, scores, n, 0.99)


@dataclass(frozen=True)
class Units:
    """Columns under one shift: the runs that share it, and the cut points of its ranges of values."""

    column: tuple[int, ...]
    shift: tuple[float, ...]
    runs: tuple[np.ndarray, ...]
    cuts: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, runs: Runs, cuts: list[np.ndarray]) -> Units:
        """``cuts`` are cut points of each column's unshifted numbers; those of shifted ones lie between and beyond them."""
        found = [(c, s) for c in range(runs.columns) for s in np.unique(runs.shifts[c])]
        return cls(tuple(c for c, _ in found), tuple(float(s) for _, s in found), tuple(np.flatnonzero(runs.shifts[c] == s) for c, s in found),
                   tuple(cuts[c] if not s else np.unique(np.concatenate((cuts[c], cuts[c] + s))) for c, s in found))

    def placed(self, chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each unit the rows of both sides that have a number, their numbers and the range of each."""
        for unit, (c, shift) in enumerate(zip(self.column, self.shift, strict=True)):
            own = chunk.numbers[c]
            values = np.where(chunk.late, own + shift, own) if shift else own
            rows = np.flatnonzero((chunk.side >= 0) & ~np.isnan(values))
            yield unit, rows, values[rows], np.searchsorted(self.cuts[unit], values[rows])

    def weights(self, runs: Runs, unit: int) -> np.ndarray:
        """How often each run of a unit takes the number of a row of a cell (cells x runs)."""
        return runs.copies[:, self.runs[unit]] * runs.kept[self.column[unit]][:, self.runs[unit]]


def _cut_points(columns: int, count: int):
    """Tasks that give a chunk's evenly spaced numbers of each column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, columns):
            for c, own in enumerate(chunk.numbers):
                own = np.sort(own[~np.isnan(own)])
                if len(own):
                    points = own[np.linspace(0, len(own) - 1, 4 * count).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([points])], ["stat", "mass", "points"])

    return task


def _cuts(count: int):
    def group(table: pa.Table) -> pa.Table:
        points = [np.asarray(p.values) for p in table["points"]]
        values, weight = np.concatenate(points), np.repeat(table["mass"].to_numpy(), [len(p) for p in points])
        order = np.argsort(values)
        cum = np.cumsum(weight[order])
        at = np.searchsorted(cum, cum[-1] * np.arange(1, count) / count)
        return pa.table({"stat": [table["stat"][0].as_py()], "cuts": pa.array([np.unique(values[order][at])])})

    return group


def _totals(runs: Runs, units: Units):
    """Tasks that give, for each unit and side, the rows that every run takes in each range (ranges x runs, flat)."""
    cells = len(runs.copies)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for chunk in _chunks(batches, runs.columns):
            for unit, rows, _, slot in units.placed(chunk):
                for side in (0, 1):
                    here = chunk.side[rows] == side
                    counts = np.bincount(slot[here] * cells + chunk.cell[rows][here], minlength=(len(units.cuts[unit]) + 1) * cells)
                    taken = counts.reshape(-1, cells) @ units.weights(runs, unit)
                    sums[unit, side] = sums[unit, side] + taken if (unit, side) in sums else taken
        for (unit, side), taken in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([2 * unit + side], pa.int64()), pa.array([taken.ravel()], pa.list_(pa.int64()))], ["stat", "taken"])

    return task


def _summed(table: pa.Table) -> pa.Table:
    taken = sum(np.asarray(x.values) for x in table["taken"])
    return pa.table({"stat": [table["stat"][0].as_py()], "taken": pa.array([taken], pa.list_(pa.int64()))})


def _dealt(columns: int, units: Units):
    """Tasks that give the rows of both sides by unit and range of values."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, columns):
            for unit, rows, values, slot in units.placed(chunk):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), unit, np.int32)), pa.array(slot.astype(np.int32)), pa.array(values),
                     pa.array((2 * chunk.cell[rows] + chunk.side[rows]).astype(np.int32))], ["unit", "slot", "value", "cell"])

    return task


def _gaps(runs: Runs, units: Units, before: dict[int, np.ndarray], all_: dict[int, np.ndarray]):
    """Tasks that give the largest gap between both sides' shares after any value, from rows sorted by (unit, slot, value)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {unit: np.zeros(len(own)) for unit, own in enumerate(units.runs)}
        last, carried = None, None

        def judge(unit: int, cum: list[np.ndarray]) -> None:
            share = [cum[side] / np.maximum(all_[2 * unit + side], 1) for side in (0, 1)]
            most[unit] = np.maximum(most[unit], np.abs(share[0] - share[1]).max(axis=0, initial=0.0))

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, slot, value, cell = (c.to_numpy() for c in batch.columns)
            fresh = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (slot[1:] != slot[:-1])))
            for a, b in zip(fresh, np.append(fresh[1:], len(unit)), strict=True):
                key = int(unit[a]), int(slot[a])
                if last is not None and last != (*key, value[a]):  # the value that ended the last piece ended there
                    judge(last[0], carried)
                u = key[0]
                start = carried if last is not None and last[:2] == key else [before[2 * u + side][key[1]][None] for side in (0, 1)]
                weight = units.weights(runs, u)[cell[a:b] >> 1]
                cum = [start[side] + np.cumsum(weight * ((cell[a:b] & 1) == side)[:, None], axis=0) for side in (0, 1)]
                ends = np.flatnonzero(value[a:b - 1] != value[a + 1:b])
                judge(u, [c[ends] for c in cum])
                last, carried = (*key, value[b - 1]), [c[-1:] for c in cum]
        if last is not None:
            judge(last[0], carried)
        found = [(unit, int(run), float(gap)) for unit, gaps in most.items() for run, gap in zip(units.runs[unit], gaps, strict=True) if gap > 0]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                          pa.array([f[2] for f in found], pa.float64())], ["unit", "run", "gap"])

    return task


def largest_ks(rows: DataFrame, runs: Runs, minimum: int = 20) -> np.ndarray:
    """The largest KS distance between both sides over the columns of each run; NaN where no column has enough numbers on either side."""
    columns, count, n = runs.columns, interval_count(rows), len(runs)
    points = rows.mapInArrow(_cut_points(columns, count), "stat long, mass long, points array<double>")
    cuts = [np.zeros(0)] * columns
    for r in bounded_rows(points.groupBy("stat").applyInArrow(_cuts(count), "stat long, cuts array<double>"), columns):
        cuts[r["stat"]] = np.array(r["cuts"])
    units = Units.of(runs, cuts)
    sums = rows.mapInArrow(_totals(runs, units), "stat long, taken array<long>").groupBy("stat").applyInArrow(_summed, "stat long, taken array<long>")
    taken = {s: np.zeros((len(units.cuts[s // 2]) + 1, len(units.runs[s // 2])), np.int64) for s in range(2 * len(units.column))}
    for r in bounded_rows(sums, len(taken)):
        taken[r["stat"]] = np.array(r["taken"], np.int64).reshape(taken[r["stat"]].shape)
    before = {s: np.cumsum(t, axis=0) - t for s, t in taken.items()}
    all_ = {s: t.sum(axis=0) for s, t in taken.items()}
    dealt = (rows.mapInArrow(_dealt(columns, units), "unit int, slot int, value double, cell int")
             .repartition(count, "unit", "slot").sortWithinPartitions("unit", "slot", "value"))
    gaps = dealt.mapInArrow(_gaps(runs, units, before, all_), "unit long, run long, gap double").groupBy("unit", "run").agg({"gap": "max"})
    found = {(r["unit"], r["run"]): r["max(gap)"] for r in bounded_rows(gaps, columns * n)}
    out = np.full(n, np.nan)
    for unit, own in enumerate(units.runs):
        enough = (all_[2 * unit] >= minimum) & (all_[2 * unit + 1] >= minimum)
        for run in own[enough]:
            out[run] = np.fmax(out[run], found.get((unit, int(run)), 0.0))
    return out
