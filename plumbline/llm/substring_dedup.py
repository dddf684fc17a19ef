"""Removal of every byte that a repeated long string covers, by suffix arrays of shards.

A string of 200 bytes goes to the shard of its smallest hash of 50 bytes, so two equal strings meet in one shard wherever they stand. Neighbouring
strings mostly share that hash: a text is cut into windows of a few dozen strings each. Windows whose hash occurs once hold no repeat
and are never moved. In a shard, the other windows are put one after another, their suffixes are sorted by induced sorting, and permuted common
prefixes show which strings start again. A hash with very many windows is parted by the hashes of the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import cut, partitions, text_of
from plumbline.llm.suffix_array import repeated_starts

LENGTH, CORE = 200, 50
#: Starts in a window at most. Bytes of windows whose suffixes are sorted together; windows of one hash above which it is parted.
STARTS, SHARD, MANY = 1024, 600_000, 2048
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xBF58476D1CE4E5B9)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int, base: np.uint64 = MIX) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes: a polynomial one, by doubling, then mixed."""
    with np.errstate(over="ignore"):
        part, power, have = data.astype(np.uint64) + np.uint64(1), base, 1
        out, length = None, 0
        while True:
            if size & have:
                out = part if out is None else out[:len(part) - length] * power + part[length:][:len(out)]
                length += have
            if length == size:
                break
            part = part[:-have] * power + part[have:]
            power = power * power
            have *= 2
        out = out[:len(data) - size + 1]
        out = (out ^ (out >> np.uint64(29))) * FOLD
        return out ^ (out >> np.uint64(32))


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def least_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all cores of a text, and for each start of a string the smallest one inside it."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = gram_hashes(np.frombuffer(data, np.uint8), CORE)
    return hashes, sliding(np.minimum, hashes, LENGTH - CORE + 1)


def smallest_cores(data: bytes) -> np.ndarray:
    """Hashes of the cores that are the smallest of some string, one for each place: a hash that occurs once is in no repeated string."""
    hashes, least = least_hashes(data)
    if not len(least):
        return least
    pad = np.zeros(LENGTH - CORE, np.uint64)
    return hashes[sliding(np.maximum, np.concatenate((pad, least, pad)), LENGTH - CORE + 1) == hashes]


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts) of every window: a run of starts whose strings have the same smallest hash."""
    least = least_hashes(data)[1]
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(least)))
    pieces = -(-sizes // STARTS)  # the long windows of periodic texts are cut; their pieces share the hash
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, ends = np.repeat(first, pieces) + nth * STARTS, np.repeat(first + sizes, pieces)
    return np.repeat(least[first], pieces), starts, np.minimum(ends - starts, STARTS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the smallest cores with their counts in a batch."""
    for batch in batches:
        found = [smallest_cores(t.as_py().encode()) for t in batch.column(0)]
        keys, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the windows are: (key, _id, _row, start, size)."""
    for batch in batches:
        found = [windows(t.as_py().encode()) for t in batch.column(2)]
        if not found:
            continue
        of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        keys, starts, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of),
                                          pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32))], ["key", "_id", "_row", "start", "size"])


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the moves between tasks; the last column is the text."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = pa.array([press.compress(t.as_py().encode()) for t in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], [*batch.schema.names[:-1], "pressed"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows wanted of each text: (key, print, _id, _row, start, data), the bytes once in a task for each (key, print) seen lately."""
    unpress, sent = zstandard.ZstdDecompressor(), set()
    names = ["key", "print", "_id", "_row", "start", "data"]
    for batch in batches:
        keys, prints, of, starts, data = [], [], [], [], []
        size = 0
        for k, (pressed, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            text = unpress.decompress(pressed.as_py()) if wanted is not None else b""
            for w in wanted.as_py() or ():
                piece = text[w["start"]:w["start"] + w["size"] + LENGTH - 1]
                mark = (w["key"], xxhash.xxh64_intdigest(piece))
                keys.append(w["key"])
                prints.append(mark[1])
                of.append(k)
                starts.append(w["start"])
                data.append(None if mark in sent else piece)
                if mark not in sent:
                    sent.add(mark)
                    size += len(piece)
                if size > 8 << 20 or len(keys) >= 50_000:
                    place = pa.array(of)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(0).take(place),
                                                      batch.column(1).take(place), pa.array(starts, pa.int32()), pa.array(data, pa.binary())], names)
                    keys, prints, of, starts, data, size = [], [], [], [], [], 0
            if len(sent) > 200_000:
                sent.clear()
        if keys:
            place = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(0).take(place),
                                              batch.column(1).take(place), pa.array(starts, pa.int32()), pa.array(data, pa.binary())], names)


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, one after the last)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return list(zip(starts[np.append(0, cuts)].tolist(), (starts[np.append(cuts, len(starts)) - 1] + 1).tolist(), strict=True))


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, spans): repeated starts of windows (key, print, n, data) that come sorted by key; keys stay together in a shard."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def give() -> pa.RecordBatch:
        found = repeated_starts([h[3] for h in held], LENGTH)
        spans = [[(0, len(h[3]) - LENGTH + 1)] if h[2] > 1 else _spans(f) for h, f in zip(held, found, strict=True)]
        spans = [[{"a": a, "b": b} for a, b in x] for x in spans]
        some = [i for i, x in enumerate(spans) if x]
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.int64()), pa.array([held[i][1] for i in some], pa.int64()),
                                           pa.array([spans[i] for i in some], SPANS)], ["key", "print", "spans"])

    for batch in batches:
        for key, mark, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD and held[-1][0] != key:
                yield give()
                held, size = [], 0
            held.append((key, mark, n, data))
            size += len(data)
    if held:
        yield give()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of windows (key, print, n, data), with its place."""
    for batch in batches:
        for key, mark, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.frombuffer(data, np.uint8)
            one, two = gram_hashes(raw, LENGTH), gram_hashes(raw, LENGTH, SECOND)
            m = len(one)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(m, key, np.int64)),
                                              pa.array(np.full(m, mark, np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(np.arange(m, dtype=np.int32))],
                                             ["h1", "h2", "key", "print", "n", "at"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that the strings at the given starts cover; the last two columns are the text and the spans of starts."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        kept, cells = [], []
        for pressed, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            text = unpress.decompress(pressed.as_py())
            parts, at, gone, runs = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                end = b + LENGTH - 1
                if runs and a <= at:
                    gone += max(0, end - at)
                    at = max(at, end)
                    continue
                parts.append(text[at:a])
                gone += end - a
                runs += 1
                at = end
            parts.append(text[at:])
            kept.append(b"".join(parts))
            cells.append((len(text), gone, runs, hashlib.sha256(kept[-1]).hexdigest()))
        numbers = list(zip(*cells, strict=True)) if cells else [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *[pa.array(x, k) for x, k in zip(numbers, kinds, strict=True)]],
                                         ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def substring_dedup(docs: DataFrame, many: int = MANY) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text, ...).

    Texts are UTF-8 bytes, null being empty. Every byte covered by a string of 200 bytes that starts again anywhere, in the same text or another, goes;
    ``kept`` has the other bytes, which need not be valid UTF-8 where a character is cut. Rows that repeat id and text are documents of their own, so
    all their bytes are repeated if there are 200. Other columns are ignored, and an empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_row", F.xxhash64("text"))
    texts = rows.select(F.col("doc_id").alias("_id"), "_row", "text")
    # written tables, so that Spark can split the rows of a frequent hash in the joins
    again = cut(texts.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))
    wanted = (texts.mapInArrow(_places, f"key long, _id {kind}, _row long, start int, size int").join(again, "key", "left_semi")
              .groupBy("_id", "_row").agg(F.collect_set(F.struct("key", "start", "size")).alias("wanted")))
    pressed = texts.mapInArrow(_pressed, f"_id {kind}, _row long, pressed binary")
    same = pressed["_id"].eqNullSafe(wanted["_id"]) & (pressed["_row"] == wanted["_row"])
    found = cut(pressed.join(wanted, same).select(pressed["_id"], pressed["_row"], "pressed", "wanted")
                .mapInArrow(_cut_out, f"key long, print long, _id {kind}, _row long, start int, data binary"))
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.filter(F.col("n") > many).select("key"))
    one = found.join(hot, "key", "left_anti").repartition(partitions(spark), "key").groupBy("key", "print").agg(
        F.count(F.lit(1)).alias("n"), F.max("data").alias("data"))
    sorted_shards = one.sortWithinPartitions("key", "print").mapInArrow(_sorted_shards, "key long, print long, spans array<struct<a:int,b:int>>")
    other = found.join(hot, "key", "left_semi").groupBy("key", "print").agg(F.count(F.lit(1)).alias("n"), F.max("data").alias("data"))
    strings = cut(other.mapInArrow(_strings, "h1 long, h2 long, key long, print long, n long, at int"))
    twice = cut(strings.groupBy("h1", "h2").agg(F.sum("n").alias("times")).filter("times > 1").select("h1", "h2"))
    parted = (strings.join(twice, ["h1", "h2"], "left_semi").groupBy("key", "print")
              .agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans")))
    repeated = sorted_shards.union(parted)
    covered = (found.select("key", "print", "_id", "_row", "start").join(repeated, ["key", "print"])
               .select("_id", "_row", F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))).alias("spans"))
               .groupBy("_id", "_row").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    whole = rows.select("doc_id", "_row", "text").mapInArrow(_pressed, f"doc_id {kind}, _row long, pressed binary")
    match = whole["doc_id"].eqNullSafe(covered["_id"]) & (whole["_row"] == covered["_row"])
    return (whole.join(covered, match, "left").select("doc_id", "pressed", "spans")
            .mapInArrow(_removed, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
