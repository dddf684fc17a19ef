"""Language identification by rank-order profiles of n-grams (out-of-place distance).

A language's profile is the list of its most frequent letter n-grams in order of frequency. A document goes to the language whose
profile is nearest to its own list: for each of its n-grams the difference of ranks, and the greatest one where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import let_go

#: n-grams in a profile; documents labelled with a language that are read for its profile, about.
PROFILE, SAMPLE = 400, 4000
UNKNOWN = "und"
#: Bytes of text that a task gives on at a time, and n-grams of which it holds counts.
AT_A_TIME, HELD = 4_000_000, 2_000_000


@cache
def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of one to three letters, a word's ends counted as letters, packed into 63 bits each."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(letter_table()[code], code, 0)
    code = np.concatenate(([0], code, [0]))
    code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # one end between words
    if len(code) < 3:
        return np.zeros(0, np.int64)
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    return np.concatenate((code[code > 0], two | (np.int64(1) << 62), three[code[1:-1] > 0]))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the smaller code first."""
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Profiles of all languages, each sorted by n-gram so that a document's ranks are found by binary search."""

    def __init__(self, lists: dict[str, np.ndarray]) -> None:
        self.names = sorted(lists)
        self.size = max([1, *map(len, lists.values())])
        orders = [np.argsort(lists[n]) for n in self.names]
        self.sorted = [(lists[n][o], o) for n, o in zip(self.names, orders, strict=True)]

    def distances(self, text: str) -> np.ndarray | None:
        """For each language the mean out-of-place distance, from 0 to 1; None for a text without letters."""
        keys, counts = np.unique(grams(text), return_counts=True)
        if not len(keys):
            return None
        own = ranked(keys, counts, self.size)
        place = np.arange(len(own))
        out = []
        for keys, ranks in self.sorted:
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = keys[at] == own
            out.append(np.where(found, np.minimum(np.abs(ranks[at] - place), self.size), self.size).mean() / self.size)
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - its distance; equally near ones by name; ``und`` and 0 for null or no letter."""
        far = self.distances(text) if text and self.names else None
        if far is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best])


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text; a longer text comes alone."""
    at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        yield batch.slice(at, to - at)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams for each language, given on where a task holds many."""
    let_go()
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for some in _slices(batch, 1, AT_A_TIME // 8):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    keys, place = np.unique(np.concatenate((held[lang][0], keys)), return_inverse=True)
                    counts = np.bincount(place, np.concatenate((held[lang][1], counts)), len(keys))
                held[lang] = keys, counts.astype(np.int64)
            if sum(len(keys) for keys, _ in held.values()) > HELD:
                yield from give()
    yield from give()


def fit(docs: DataFrame, profile: int = PROFILE, sample: int | None = SAMPLE) -> Profiles:
    """Profiles from rows of (doc_id, text, lang); rows without text or language are not used.

    Of each language about ``sample`` documents are read, those of the smallest hashes of id and text: a bound on the model's input, not on
    what is classified; without ``sample`` all are. What comes to the driver is ``profile`` n-grams of each language.
    """
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    some = rows if sample is None else _sample(rows, sample)
    counts = some.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        lists.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({k: np.array([g for _, g in sorted(v)], np.int64) for k, v in lists.items()})


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each language, those of the smallest hashes of id and text."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id", "text"), 11).cast("double") / float(1 << 53)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language, as the model
    share = F.lit(0.0)
    if sizes:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample / n)])[F.col("lang")]
    return rows.filter(draw < share)


def _predicted(profiles: Profiles, names: tuple[str, str], read: int, kept: int):
    """Tasks that read column ``read`` and give the first ``kept`` columns on, some megabytes of text at a time."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for batch in _slices(whole, read, AT_A_TIME):
                got = [profiles.predict(t.as_py()) for t in batch.column(read)]
                columns = [*batch.columns[:kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:kept], *names])

    return task


def identify(docs: DataFrame, train: Column, keep: list[str] | None = None, profile: int = PROFILE, sample: int | None = SAMPLE,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (doc_id by default) of every row of (doc_id, text, lang, ...), with lang_pred and score under the given names.

    Profiles are learned from rows where ``train`` holds and text and lang are there; only the text is used to predict. A text that is null or
    has no letter gets ``und`` and score 0, as do all where nothing could be learned. Repeated rows get a row each.
    """
    keep = [c for c in keep or ["doc_id"] if c not in names]
    profiles = fit(docs.filter(train), profile, sample)
    # a text that is kept anyway is not sent a second time
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_read"))
    read = keep.index("text") if "text" in keep else len(keep)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:len(keep)])
    return source.mapInArrow(_predicted(profiles, names, read, len(keep)), f"{spec}, {names[0]} string, {names[1]} double")
