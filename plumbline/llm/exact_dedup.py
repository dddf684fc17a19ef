"""Exact deduplication with counting quotient filters.

Each partition keeps the 64-bit fingerprints of its texts in counting quotient filters, one for each range of the hash space.
The filters of a range meet in one task and merge without loss, because a quotient and its sorted remainders give back the
sorted fingerprints. Fingerprints with a count above one send their texts to a comparison of the bytes; other documents are
unique and their text is never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import ascii_lower, partitions, text_of

#: Fingerprints that a partition gathers before it gives its filters out; more fill further filters.
GATHER = 1 << 21
#: Tasks that the rows of one fingerprint are dealt to before their texts are counted.
SALTS = 16


@dataclass
class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints that share their first ``64 - width`` bits.

    A fingerprint's lower ``width`` bits are split into a quotient of ``q`` bits and a remainder. ``occupied`` has a bit for each
    quotient with a run, ``run_end`` one for each slot that ends a run; slots hold the remainders, sorted inside each run.
    ``repeated`` marks the slots whose fingerprint came more than once, ``counters`` holds their counts.
    """

    width: int
    q: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    repeated: np.ndarray
    counters: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """From strictly rising fingerprints and their counts."""
        q = min(width, max(1, int(len(prints)).bit_length()))
        low = prints & np.uint64((1 << width) - 1) if width < 64 else prints
        shift = np.uint64(width - q)
        quotient = (low >> shift).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True) if len(prints) else np.zeros(0, bool)
        more = counts > 1
        return cls(width, q, np.packbits(occupied), np.packbits(ends), low & ((np.uint64(1) << shift) - np.uint64(1)),
                   np.packbits(more), counts[more].astype(np.int64))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted lower bits of all fingerprints and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.run_end, count=n).astype(bool)
        runs = np.concatenate(([0], np.cumsum(ends)[:-1])) if n else np.zeros(0, np.int64)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        counts = np.ones(n, np.int64)
        counts[np.unpackbits(self.repeated, count=n).astype(bool)] = self.counters
        return (quotients[runs] << np.uint64(self.width - self.q)) | self.remainders, counts

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Merges two sorted filters; counts of a common fingerprint add up."""
        (a, na), (b, nb) = self.fingerprints(), other.fingerprints()
        prints = np.insert(a, np.searchsorted(a, b), b)
        counts = np.insert(na, np.searchsorted(a, b), nb)
        first = np.append(True, prints[1:] != prints[:-1]) if len(prints) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        return QuotientFilter.build(prints[starts], np.add.reduceat(counts, starts) if len(starts) else counts, self.width)

    def to_bytes(self) -> bytes:
        size = np.array([self.width, self.q, len(self.remainders), len(self.counters)], np.int64)
        wide = np.uint32 if self.width - self.q <= 32 else np.uint64
        return b"".join(x.tobytes() for x in (size, self.remainders.astype(wide), self.counters, self.occupied, self.run_end,
                                              self.repeated))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        width, q, n, m = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, parts = 32, []
        wide = np.uint32 if width - q <= 32 else np.uint64
        for kind, count in ((wide, n), (np.int64, m), (np.uint8, ((1 << q) + 7) // 8), (np.uint8, (n + 7) // 8), (np.uint8, (n + 7) // 8)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        remainders, counters, occupied, ends, repeated = parts
        return cls(width, q, occupied, ends, remainders.astype(np.uint64), repeated, counters)


def _filters(bits: int):
    """Tasks that turn fingerprints into filters, one for each of the 2 ** bits ranges of the hash space."""
    width = 64 - bits

    def give(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.concatenate(gathered), return_counts=True)
        ranges = (prints >> np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(prints)), strict=True):
            data = QuotientFilter.build(prints[a:b], counts[a:b], width).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([ranges[a]], pa.int64()), pa.array([data], pa.binary())], ["range", "filter"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            gathered.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(gathered[-1])
            if size >= GATHER:
                yield from give(gathered)
                gathered, size = [], 0
        if size:
            yield from give(gathered)

    return task


def _merged(bits: int):
    """Tasks that merge the filters of each range and give the fingerprints with a count above one."""
    width = np.uint64(64 - bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, QuotientFilter] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = QuotientFilter.from_bytes(data.as_buffer())
                whole[key] = whole[key].merge(one) if key in whole else one
        for key, one in whole.items():
            prints, counts = one.fingerprints()
            again = prints[counts > 1] | (np.uint64(key) << width)
            yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(counts[counts > 1])], ["print", "seen"])

    return task


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(print, seen) of every value of a one-column frame of 64-bit fingerprints that occurs more than once."""
    n = partitions(prints.sparkSession)
    bits = max(1, (4 * n - 1).bit_length())  # some ranges for each task, so that they are dealt evenly
    filters = prints.mapInArrow(_filters(bits), "range long, filter binary")
    return filters.repartition(n, "range").mapInArrow(_merged(bits), "print long, seen long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of (doc_id, text, ...).

    Texts are equal when their bytes are equal after lower-casing A to Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays (a null id is the smallest); where rows repeat that id and text, one of them. An empty table gives an
    empty table; other columns are ignored.
    """
    normal = ascii_lower(text_of())
    rows = docs.select("doc_id", normal.alias("normal")).withColumn("print", F.xxhash64("normal"))
    slim = (rows.select("doc_id", "print", F.sha2("normal", 256).alias("text_sha256"))
            .groupBy("doc_id", "print", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    again = repeated_fingerprints(rows.select("print")).select("print")
    # a fingerprint may stand for a third of all texts: its rows go to several tasks, and meet only as counts of each text
    salts = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    compared = (salted.join(salts, ["print", "_salt"], "left_semi").groupBy("print", "normal")
                .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
                .select(F.col("print").alias("_print"), F.sha2("normal", 256).alias("_sha"), "group_size", "keep_id"))
    same = (F.col("print") == F.col("_print")) & (F.col("text_sha256") == F.col("_sha"))
    joined = slim.join(compared, same, "left")
    keep = F.when(F.col("_print").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (joined.withColumn("keep_id", keep)
            .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of a table that stay, with all their columns; rows that are equal in id and text count as one."""
    name, sha = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(ascii_lower(text_of()), 256)
    stays = exact_dedup(docs).filter("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    return (docs.withColumn("_kept_id", name).withColumn("_kept_sha", sha)
            .join(stays, ["_kept_id", "_kept_sha"], "left_semi").dropDuplicates(["_kept_id", "_kept_sha"])
            .drop("_kept_id", "_kept_sha"))
