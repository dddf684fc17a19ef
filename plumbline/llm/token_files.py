"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their ids and sorted, so each file holds a range and file order is id order. A file's rows carry
their place inside the file; the places of the files follow from their totals, which are read from the files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import byte_letters, kept_in_worker, partitions, shared_folder, text_of, without_collector

#: Distinct words that a task keeps encoded; beyond it starts afresh, which costs time and changes nothing.
KEPT_WORDS = 400_000
#: Bytes of such words, so that long ones count as what they are.
KEPT_BYTES = 24 << 20
#: Characters of text that a task encodes at a time.
AT_A_TIME = 2_000_000
# What the writer is told about stripes, row groups and Bloom filters.
ORC_OPTIONS = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true",
               "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


# Texts of visible ASCII, composed Latin letters and white space, which normalisation only lowers; words of the same letters; and
# how such texts are parted before the merges. All other words, and those that may hold a special token, go through the library's whole chain.
PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-įĲ-ňŊ-ž]*")
PLAIN = re.compile("(?!.*<\\|)[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\t-\r a-z0-9ß-öø-ž]+")
LETTERS = {b: c for c, b in byte_letters().items()}


def _letters(word: str) -> str:
    """A word in the letters of a byte-level vocabulary."""
    return word if word.isascii() else "".join([LETTERS[b] for b in word.encode()])


class WordEncoder:
    """Encodes texts by a tokenizer in which white space always parts tokens and has none of its own.

    A plain text is cut into its parts at once, any other into words; every distinct one goes through the tokenizers library once, and
    texts are put together from their ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str | bytes, int] = {}
        self.held = 0
        self.parts: dict[str, list[int]] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def part_ids(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(_letters(part))]

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of whole words, each of which may hold anything but white space."""
        texts = [w.decode() for w in words]
        plain = [bool(PLAIN.fullmatch(t)) for t in texts]
        parts = [PARTS.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        for p in set().union(*parts).difference(self.parts):
            self.parts[p] = self.part_ids(p)
        rest = self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False)
        others, known = iter(rest), self.parts
        return [[i for x in xs for i in known[x]] if p else next(others).ids for xs, p in zip(parts, plain, strict=True)]

    def learn(self, new: set[str | bytes]) -> None:
        pieces, words = [p for p in new if isinstance(p, str)], [p for p in new if isinstance(p, bytes)]
        got = [self.part_ids(p) for p in pieces] + (self.word_ids(words) if words else [])
        pieces += words
        self.held += sum(map(len, pieces))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.index.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)

    def encode(self, texts: Sequence[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text ended by ``end``, and the number of ids of each text."""
        parts = [PARTS.findall(t.lower()) if PLAIN_TEXT.fullmatch(t) and "<|" not in t else t.encode().split() for t in texts]
        if len(self.index) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.forget()
        new = set().union(*parts).difference(self.index)
        if new:
            self.learn(new)
        get, n = self.index.__getitem__, [len(p) for p in parts]
        words = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, sum(n))
        size = self.sizes[words]
        total = np.concatenate(([0], np.cumsum(size)))
        bounds = total[np.cumsum(n)]  # where each text ends among the ids of its parts
        ids = self.flat[np.repeat(self.starts[words] - total[:-1], size) + np.arange(total[-1])]
        return np.insert(ids, bounds, end), np.diff(bounds, prepend=0) + 1


def _encoded(path: str, end: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(f"words {path}", lambda: WordEncoder(path))
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < AT_A_TIME:
                    size += len(texts[to])
                    to += 1
                with without_collector():
                    ids, counts = encoder.encode(texts[at:to], end)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(np.full(to - at, part, np.int32)), pa.array(before + ends - counts),
                     pa.array(counts), lists], ["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(ends[-1])
                at = to

    return task


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Writes (doc_id, part, before, n_tokens, ids) of every row of (doc_id, text, ...) as ORC, in ascending order of ids.

    Each text's ids are followed by ``end``; null is an empty text. ``before`` counts the ids before the document in its part.
    Rows that repeat an id stand next to each other, by text. A null id comes first. Other columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, part int, before long, n_tokens long, ids array<int>"
    dealt.mapInArrow(_encoded(tokenizer, end), schema).write.options(**ORC_OPTIONS).orc(path)


def read_token_ids(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``start`` counts the ids of all documents before.

    Given some document ids, stripes and row groups that hold none of them are skipped by index and Bloom filter.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        counts = pa.array(np.diff(bounds).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(sums, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files that are written and read back."""
    path = shared_folder(docs.sparkSession)
    write_token_ids(docs, path, tokenizer, end)
    return read_token_ids(docs.sparkSession, path).mapInArrow(
        _checked, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")
