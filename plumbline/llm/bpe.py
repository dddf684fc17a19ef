"""Byte-level BPE in numpy: merge rounds over the symbols of many words in one flat array.

A round finds each word's pair of lowest rank by binary search over the sorted pair keys and merges all its places; words that have
no pair left drop out. Distinct words are merged once for a task's batch and texts are put together from their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import byte_letters, kept_in_worker, text_of, without_collector

# The public pattern of byte-level BPE that parts text into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text that a task keeps encoded; beyond it starts afresh, which costs time and changes nothing.
KEPT_PIECES = 150_000
#: Bytes of such pieces, so that long ones count as what they are.
KEPT_BYTES = 12 << 20
#: Characters of text that a task encodes at a time.
AT_A_TIME = 500_000
NONE = np.int64(1) << 40


class Bpe:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        by_id = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.width = np.int64(len(pieces))
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.words = regex.compile(WORDS)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.commas: list[bytes] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the sorted keys, -1 where it is no merge."""
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at, -1)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        pair = np.full(len(symbols), -1, np.int64)
        inner = word[1:] == word[:-1]
        pair[:-1][inner] = self._found(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            rank = np.where(pair >= 0, self.ranks[pair], NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            live = best < NONE
            if not live.all():
                keep = np.repeat(live, lengths)
                done_symbols.append(symbols[~keep])
                done_words.append(word[~keep])
                symbols, word, pair, rank = symbols[keep], word[keep], pair[keep], rank[keep]
                best, lengths = best[live], lengths[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, lengths)
            at = np.flatnonzero(hit)
            # of places that overlap (a pair of equal symbols in a row), every second one from the left
            fresh = np.append(True, at[1:] != at[:-1] + 1)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            dirty = np.zeros(len(symbols), bool)
            dirty[at] = True
            symbols, word, pair, dirty = symbols[keep], word[keep], pair[keep], dirty[keep]
            dirty[:-1] |= dirty[1:]
            look = np.flatnonzero(dirty)
            pair[look] = -1
            look = look[look + 1 < len(symbols)]
            look = look[word[look] == word[look + 1]]
            pair[look] = self._found(symbols[look], symbols[look + 1])
        ids = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_words) if done_words else word
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves: cut before a space that stands between two other characters."""
        if self.split and any(t in text for t in self.special):
            return [p for part in self.split.split(text) if part for p in ([part] if part in self.special else SPACED.split(part))]
        if not UNEVEN.search(text):
            head, *rest = text.split(" ")
            return [head, *[" " + r for r in rest]] if text else []
        return [p for p in SPACED.split(text) if p]

    def learn(self, pieces: list[str]) -> None:
        words = [[p] if p in self.special else self.words.findall(p) for p in pieces]
        unique = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws if w not in self.special))}
        ids, counts = self.merge([w.encode() for w in unique])
        ends = np.cumsum(counts)
        lists = [ids[a:b].tolist() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        got = [[i for w in ws for i in ([self.special[w]] if w in self.special else lists[unique[w]])] for ws in words]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.index.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        self.held += sum(map(len, pieces))
        self.commas.extend(",".join(map(str, g)).encode() for g in got)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.flat = np.append(self.flat, np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum())))
        self.sizes = np.append(self.sizes, sizes)

    def encode(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """The ids of each text, and the same as decimals joined by commas."""
        parts = [self.pieces(t) for t in texts]
        if len(self.index) > KEPT_PIECES or self.held > KEPT_BYTES:
            self.forget()
        new = set().union(*parts).difference(self.index)
        if new:
            self.learn(list(new))
        ids, joined, get, commas = [], [], self.index.__getitem__, self.commas
        for part in parts:
            places = list(map(get, part))
            joined.append(b",".join([commas[i] for i in places]))
            at = np.array(places, np.int64)
            size = self.sizes[at]
            total = np.cumsum(size)
            ids.append(self.flat[np.repeat(self.starts[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)])
        return ids, joined

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids in UTF-8; bytes that are no text become the replacement character."""
        size = self.byte_sizes[ids]
        total = np.cumsum(size)
        raw = self.bytes[np.repeat(self.byte_starts[ids] - total + size, size) + np.arange(total[-1] if len(total) else 0)].tobytes()
        return raw.decode("utf-8", "replace").encode()


#: A space between two characters that are no white space; and texts where it isn't so for every space.
SPACED = re.compile(r"(?<=\S)(?= \S)")
UNEVEN = re.compile(r"\s | \s|^ | $")


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < AT_A_TIME:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _digests(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                with without_collector():
                    ids, joined = bpe.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                     pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return task


def _ids(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bpe.encode(texts[a:b])[0], pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])

    return task


def _texts(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return task


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text, ...); a null or empty text has no ids. Other columns are ignored."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_ids(path), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(_texts(path), f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded from the ids again.

    The digests are of the decimal ids joined by commas and of the decoded text, lowercase hex. A null text is empty. Strings of special
    tokens in a text are their ids, as in the vocabulary's own library. Rows that repeat get a row each; other columns are ignored.
    """
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _digests(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
