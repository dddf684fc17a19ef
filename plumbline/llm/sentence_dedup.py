"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences is hashed, runs meet by hash over all documents, and sentences covered by a repeated run
go from every place but the first. Only hashes move until the last step; a first pass over the 64-bit part of the hash leaves
the runs that occur once behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import cut, text_of

# A sentence ends at these marks or at a line's end, and takes the white space after them along.
SENTENCE = re.compile("[^.!?。！？\n]*+[.!?。！？\n]++[ \t\n\x0b\f\r]*+|[^.!?。！？\n]++")


def sentences(text: str) -> list[str]:
    """The text cut into sentences; joined, they give the text again."""
    return SENTENCE.findall(text)


def runs(parts: list[str], span: int, min_words: int, long_chars: int) -> Iterator[tuple[int, int, int]]:
    """(first sentence, number of sentences, hash of 96 bits) of every run.

    A run has ``span`` sentences, or more until it has ``min_words`` words; a shorter text is one run. One sentence less is a run too where its
    characters reach ``long_chars``; a run whose both parts of one sentence less are such runs says nothing that they don't.
    """
    plain = [p.strip().lower() for p in parts]
    words = np.concatenate(([0], np.cumsum([len(p.split()) for p in plain])))
    last, n = len(parts), len(parts)
    ends = np.maximum(np.searchsorted(words, words[:-1] + min_words), np.arange(n) + span)
    if n and ends[0] > last and words[-1]:
        ends[0] = last
    less = span - 1
    chars = np.concatenate(([0], np.cumsum([len(p) for p in plain])))
    long = chars[less:] - chars[:n + 1 - less] >= long_chars if long_chars and 0 < less and span <= n else np.zeros(0, bool)
    starts = [(i, end) for i, end in enumerate(ends.tolist()) if end <= last
              and not (end - i == span and i + 1 < len(long) and long[i] and long[i + 1])]
    for i, end in starts + [(i, i + less) for i in np.flatnonzero(long).tolist()]:
        yield i, end - i, xxhash.xxh3_128_intdigest("\x00".join(plain[i:end])) >> 32


def _hashes(span: int, min_words: int, long_chars: int, whole: bool):
    """Tasks that give the hash of every run, with its place if ``whole``."""
    names = ["a", "b", "_id", "_row", "first", "length"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            a, b, doc, at, size = [], [], [], [], []

            def give() -> pa.RecordBatch:
                key = pa.array(np.array(a, np.uint64).view(np.int64))
                if not whole:
                    return pa.RecordBatch.from_arrays([key], ["a"])
                place = pa.array(doc, pa.int64())
                return pa.RecordBatch.from_arrays([key, pa.array(np.array(b, np.uint32).view(np.int32)), ids.take(place), rows.take(place),
                                                   pa.array(at, pa.int32()), pa.array(size, pa.int32())], names)

            for k, text in enumerate(batch.column(2).to_pylist()):
                for first, length, key in runs(sentences(text), span, min_words, long_chars):
                    a.append(key >> 32)
                    b.append(key & 0xFFFFFFFF)
                    doc.append(k)
                    at.append(first)
                    size.append(length)
                if len(a) > 100_000:
                    yield give()
                    a, b, doc, at, size = [], [], [], [], []
            if a:
                yield give()

    return task


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the covered sentences out of each text."""
    for batch in batches:
        texts = []
        numbers = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            parts = sentences(text)
            gone = np.zeros(len(parts) + 1, np.int64)
            for s in spans or ():
                gone[s["first"]] += 1
                gone[s["first"] + s["length"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = "".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)
            texts.append(kept)
            numbers.append((len(parts), int(gone.sum()), len(text) - len(kept), hashlib.sha256(kept.encode()).hexdigest()))
        cells = list(zip(*numbers, strict=True)) if numbers else [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *[pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]],
                                         ["doc_id", "kept_text", "n_sentences", "n_removed", "chars_removed", "kept_sha256"])


def sentence_span_dedup(docs: DataFrame, span: int = 3, min_words: int = 0, long_chars: int = 200) -> DataFrame:
    """(doc_id, kept_text, n_sentences, n_removed, chars_removed, kept_sha256) of every row of (doc_id, text, ...).

    Every ``span`` consecutive sentences are a run, however short; a text with less is one run. One sentence less is a run as well if it has
    ``long_chars`` characters (0: never), which holds in scripts without spaces too: a passage of two long sentences goes, a stock opening of two
    short ones stays. With ``min_words`` a run goes on until it has so many words, and what is left at a text's end with less is no run;
    words are split at white space. Texts are read whole, whatever their length; a task holds the runs of some texts at a time. White
    space at a sentence's ends and case do not count. Of equal runs the one with the smallest (doc_id, text hash, position)
    is the first; all sentences of the others go. A null id comes first; rows that repeat both id and text count as one row
    and share its result. A null text is empty, and nothing is removed from it. Other columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    # 128 bits name a text: rows whose ids repeat or are null must not share a name by chance
    rows = rows.withColumn("_row", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    texts = rows.select(F.col("doc_id").alias("_id"), "_row", "text")
    # written tables, so that Spark can split a frequent run's rows in the joins
    again = cut(texts.mapInArrow(_hashes(span, min_words, long_chars, False), "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("a"))
    schema = f"a long, b int, _id {dict(docs.dtypes)['doc_id']}, _row binary, first int, length int"
    places = cut(texts.mapInArrow(_hashes(span, min_words, long_chars, True), schema).join(again, "a", "left_semi"))
    where = F.struct("_id", "_row", "first")
    first = cut(places.groupBy("a", "b").agg(F.min(where).alias("_first"), F.max(where).alias("_last")).filter("_first != _last"))
    later = (places.join(first, ["a", "b"]).filter(~where.eqNullSafe(F.col("_first")))
             .groupBy("_id", "_row").agg(F.collect_set(F.struct("first", "length")).alias("_spans")))
    same = rows["doc_id"].eqNullSafe(later["_id"]) & (rows["_row"] == later["_row"])
    return (rows.join(later, same, "left").select("doc_id", "text", "_spans")
            .mapInArrow(_cleaned, f"doc_id {dict(docs.dtypes)['doc_id']}, kept_text string, n_sentences long, n_removed long, "
                        "chars_removed long, kept_sha256 string"))
