"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints that differ in at most three bits agree in two of five blocks, so each distinct fingerprint goes to the ten cells of its block
pairs. A cell above a size limit is parted again by blocks of the bits that are still free, so no task compares an unbounded
group and no link is lost. Inside cells, fingerprints are held as vertical bit planes: 64 of them meet one query in each word operation,
carry-save counters keep the distances, and words of lanes that are all beyond the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import cut, partitions, text_of
from plumbline.llm.components import components

RADIUS = 3
#: Distinct fingerprints above which a cell is parted by further blocks.
CELL = 2048
#: Pairs of a query and a word of 64 lanes that a task compares at a time.
AT_A_TIME = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, or of all words where there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(j, seed) for j in joined], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at:at + 65_536].astype(">u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(size: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(shingle_hashes(t.as_py(), size, seed)) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], [*batch.schema.names[:-1], "print"])

    return task


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print) of every row of (doc_id, text, ...): the SimHash of its word shingles, repeats counted.

    A to Z are lowered; words are parted by the six ASCII white space characters; a null or empty text has fingerprint zero.
    """
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _fingerprints(size, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, print long")


def near_pairs(prints: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j), i < j, of fingerprints of one cell that differ in at most three bits.

    ``prints`` holds cells one after another; ``first`` and ``last`` are the bounds of each row's cell.
    """
    n = len(prints)
    lanes = np.zeros(-(-n // 64) * 64, np.uint64)
    lanes[:n] = prints
    bits = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # a row for each fingerprint
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)  # 64 planes of words of 64 lanes
    flips = bits[:n].T.astype(np.uint64) * ALL
    row = np.arange(n)
    words = (last - 1) // 64 - (row + 1) // 64 + 1  # words with lanes after the row in its cell
    words = np.where(row + 1 < last, words, 0)
    ends = np.cumsum(words)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, "right")))
        query = np.repeat(row[at:to], words[at:to])
        word = np.arange(len(query)) - np.repeat(np.cumsum(words[at:to]) - words[at:to], words[at:to]) + (query + 1) // 64
        low, high = np.maximum(query + 1 - word * 64, 0), np.minimum(last[query] - word * 64, 64)
        valid = (ALL << low.astype(np.uint64)) & (ALL >> (64 - high).astype(np.uint64))
        one, two, four = np.zeros_like(valid), np.zeros_like(valid), ~valid  # the last sticks: more than the radius
        for b in range(64):
            differs = planes[b][word] ^ flips[b][query]
            carry = one & differs
            one ^= differs
            four |= two & carry
            two ^= carry
            if b % 8 == 7:
                live = np.flatnonzero(four != ALL)
                if len(live) < len(four):
                    query, word, one, two, four = query[live], word[live], one[live], two[live], four[live]
                    if not len(live):
                        break
        if len(query):
            within = np.unpackbits((~four).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(within)
            yield query[k], word[k] * 64 + lane
        at = to


def _star(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each index the smallest one that it is linked to, directly or not."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            high, low = np.maximum(a, b), np.minimum(a, b)
            if not (high != low).any():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (mask, cell, print) sorted by cell; a cell may go on in the next batch."""
    held = np.zeros((3, 0), np.int64)

    def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        prints = rows[2].view(np.uint64)
        fresh = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
        sizes = np.diff(np.append(fresh, rows.shape[1]))
        first, last = np.repeat(fresh, sizes), np.repeat(fresh + sizes, sizes)
        root = _star(len(prints), near_pairs(np.ascontiguousarray(prints), first, last))
        k = np.flatnonzero(root != np.arange(len(root)))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(rows[2][k]), pa.array(rows[2][root[k]])], ["a", "b"])

    for batch in batches:
        rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])), axis=1)
        same = (rows[:2] == rows[:2, -1:]).all(axis=0) if rows.shape[1] else np.zeros(0, bool)
        start = len(same) if not len(same) else int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if rows.shape[1] - start < rows.shape[1] and rows.shape[1] > 20_000:
            yield from give(rows[:, :start])
            held = rows[:, start:]
        else:
            held = rows
    yield from give(held)


def _blocks(bits: list[int], count: int) -> list[int]:
    """The bits dealt into ``count`` masks of nearly the same size."""
    return [reduce(int.__or__, (1 << b for b in part), 0) for part in (bits[i * len(bits) // count:(i + 1) * len(bits) // count] for i in range(count))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius; ``prints`` has distinct longs ``print``.

    A cell gives at most one edge less than it has fingerprints: a star for each group that it connects.
    """
    spark = prints.sparkSession
    blocks = _blocks(list(range(64)), RADIUS + 2)
    masks = [(a | b) for a, b in combinations(blocks, 2)]
    held = cut(prints.select("print"))
    found = None
    rows = held.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "print")
    while True:
        rows = rows.withColumn("cell", F.col("print").bitwiseAND(F.col("mask"))).select("mask", "cell", "print")
        sizes = cut(rows.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        fit = (rows.join(sizes.filter(F.col("size") <= cell).drop("size"), ["mask", "cell"], "left_semi")
               .repartition(partitions(spark), "mask", "cell").sortWithinPartitions("mask", "cell", "print"))
        edges = cut(fit.mapInArrow(_linked, "a long, b long").distinct())
        found = edges if found is None else found.union(edges)
        large = sizes.filter(F.col("size") > cell)
        used = [r["mask"] for r in large.select("mask").distinct().collect()]  # a mask each, whatever the data's size
        if not used:
            return found
        finer = {}
        for m in used:
            free = [b for b in range(64) if not (m & ((1 << 64) - 1)) >> b & 1]
            finer[m] = [_signed((m & ((1 << 64) - 1)) | s) for s in _blocks(free, RADIUS + 1)]
        choice = reduce(lambda c, m: c.when(F.col("mask") == m, F.array(*[F.lit(x) for x in finer[m]])), finer, F)
        rows = cut(rows.join(large.drop("size"), ["mask", "cell"], "left_semi")
                   .select(F.explode(choice).alias("mask"), "print").distinct())


def near_components(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text, ...).

    Documents are linked when their fingerprints differ in at most three bits; ``component_id`` is the smallest doc_id that
    a document reaches by links, itself included. Fingerprints are 16 lowercase hex digits. Texts without words share fingerprint zero and are
    linked like others; repeated rows get a row each; null ids are ignored in the smallest id unless there is no other. Other
    columns are ignored, and an empty table gives an empty table.
    """
    rows = cut(fingerprints(docs, size, seed))
    classes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes))
    named = classes.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("print").alias("_print"), "component_id")
    return (rows.join(of, F.col("print") == F.col("_print"))
            .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))


def first_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each component of a table's rows those with one id and text, all columns; rows that are equal in both count as one.

    ``rows`` has (doc_id, sha, print) of every row, ``roots`` (node, root) of the prints that are linked. The smallest (doc_id, sha) stays, null
    ids last.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("least")
    named = rows.groupBy("print").agg(least).join(roots, F.col("print") == F.col("node"), "left")
    stays = (named.groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("least").alias("least"))
             .select(F.col("least.doc_id").alias("_kept_id"), F.col("least.sha").alias("_kept_sha")))
    keyed = docs.withColumn("_sha", text_sha())
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def text_sha() -> Column:
    return F.sha2(text_of(), 256)


def without_near_copies(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """The rows of a table that stay, with all columns: of each component those with the smallest (doc_id, text hash), null ids last.

    Rows that are equal in id and text count as one; rows that share only an id, or have none, are rows of their own.
    """
    rows = cut(docs.select("doc_id", text_sha().alias("sha"), text_of().alias("text"))
               .mapInArrow(_fingerprints(size, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, sha string, print long"))
    return first_of_each(docs, rows, components(links(rows.select("print").distinct())))
