"""Product quantisation of vectors with equal-average nearest-neighbour search.

Vectors are scaled to integers and cut into equal parts, each with a codebook that a few rounds of k-means move. A codebook is sorted
by the sum of its entries' components. By Cauchy-Schwarz the squared gap of two sums over the dimension never exceeds the squared
distance, so a search starts at the part's own sum and goes outward until that bound is strictly above the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components are held to this, so that a squared distance fits 64 bits.
LARGEST = 1 << 26
#: Entries on each side that a step of the search looks at; vectors that a task searches at a time.
STEP, AT_A_TIME = 8, 1024


def scaled(values: np.ndarray) -> np.ndarray:
    """Components as integers: floor(1024 * x)."""
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Scaled vectors as rows of ``width`` integers; shorter ones end in zeros."""
    flat = scaled(vectors.flatten().to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Codebook:
    """Entries of one part, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray) -> None:
        sums = entries.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.order], sums[self.order]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (of equally near ones the lowest) and the squared distance."""
        n, last = len(rows), len(self.sums)
        own = rows.sum(1)
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, last)
        right = np.searchsorted(self.sums, own)
        left = right - STEP
        for side, start, step in ((0, left, -STEP), (1, right, STEP)):
            open_, at = np.arange(n), start.copy()
            while len(open_):
                here = at[:, None] + np.arange(STEP)
                inside = (here >= 0) & (here < last)
                here = np.clip(here, 0, last - 1)
                far = rows[open_][:, None, :] - self.entries[here]
                far = np.where(inside, np.einsum("ijk,ijk->ij", far, far), np.iinfo(np.int64).max)
                least = far.min(1)
                entry = np.where((far == least[:, None]) & inside, self.order[here], last).min(1)
                better = (least < best[open_]) | ((least == best[open_]) & (entry < index[open_]))
                best[open_[better]], index[open_[better]] = least[better], entry[better]
                at = at + step
                # the next entry outward, and with it all beyond, is out of reach if its gap of sums alone is
                edge = at if side else at + STEP - 1
                there = (edge >= 0) & (edge < last)
                gap = self.sums[np.clip(edge, 0, last - 1)] - own[open_]
                go = there & (gap * gap <= best[open_] * rows.shape[1])
                open_, at = open_[go], at[go]
        return index, best


def _assigned(books: list[Codebook], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of all parts of some vectors, a column for each part."""
    cut_up = np.split(vectors, PARTS, axis=1)
    found = [[books[p].nearest(part[i:i + AT_A_TIME]) for i in range(0, len(part), AT_A_TIME)] for p, part in enumerate(cut_up)]
    return (np.stack([np.concatenate([x for x, _ in f]) for f in found], 1), np.stack([np.concatenate([d for _, d in f]) for f in found], 1))


def _summed(codes: np.ndarray, width: int):
    """Tasks that add up the parts of each entry: a row for each entry that a task has used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in codes]
        sums, counts = np.zeros(codes.shape, np.int64), np.zeros(codes.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(0), width)
                index, _ = _assigned(books, vectors)
                for p, part in enumerate(np.split(vectors, PARTS, axis=1)):
                    np.add.at(sums[p], index[:, p], part)
                    counts[p] += np.bincount(index[:, p], minlength=codes.shape[1])
        p, e = np.nonzero(counts)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return task


def _coded(codes: np.ndarray, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in codes]
        for batch in batches:
            if not batch.num_rows:
                continue
            index, error = _assigned(books, matrix(batch.column(2), width))
            names = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(error.sum(1))],
                                             ["vec_id", "label", "code", "error"])

    return task


def usable(table: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds numbers only, neither null nor infinite, its components as doubles."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.filter(F.col("embedding").isNotNull() & ~odd).select("vec_id", "label", vector.alias("embedding"))


def trained(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks of all parts (part, entry, position) from usable rows.

    They start as the parts of the vectors with the smallest ids (equal ids by vector, a null id last). Each round reads the table once;
    what comes to the driver is one row for each entry, a bound that no table moves.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    start = matrix(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width) if first else np.zeros((0, width), np.int64)
    codes = np.stack(np.split(start, PARTS, axis=1))
    if not first:
        return codes
    k = width // PARTS
    for _ in range(rounds):
        parts = rows.select("embedding").mapInArrow(_summed(codes, width), "part int, entry int, n long, sums array<long>")
        moved = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(k)]).alias("sums"))
        codes = codes.copy()
        for r in moved.collect():
            codes[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return codes


def digest(codes: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, codes.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row of (vec_id, embedding, label, ...), and the codebooks.

    A row is dropped if its vector is null or holds a null or non-finite component; others each get a row, repeated ones too, whatever
    their id or label. Vectors shorter than the longest are read as if zeros followed, up to a multiple of four components.
    Scaled components beyond 2 ** 26 count as that. An empty table gives an empty one and empty codebooks. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = usable(table)
    codes = trained(rows, rounds, entries)
    kinds = dict(rows.dtypes)
    width = codes.shape[2] * PARTS
    return rows.select("vec_id", "label", "embedding").mapInArrow(
        _coded(codes, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), codes


def restored(codes: np.ndarray, code: str) -> np.ndarray:
    """The scaled vector that a code stands for."""
    return np.concatenate([codes[p, int(code[2 * p:2 * p + 2], 16)] for p in range(PARTS)])


def coded_with_sums(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; equal labels, nulls together, share their errors' sum."""
    found, codes = compress(table)
    found = cut(found)  # read twice; the search is not repeated
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return (found.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest(codes)).alias("codebooks_sha256")))
