"""Language model scoring by subword lattices.

A word's probability sums over all its segmentations into the pieces of an existing vocabulary (forward recursion in log space). Piece
probabilities start from the vocabulary's scores and are re-estimated on the distinct training words by expected counts. A known
word has one more way through its lattice, itself as a whole, weighted by its count in the training documents (absolute
discounting). Such a model is learned for each language of the training documents and for all together; a document's probability sums
over these as it does over segmentations.

Documents are packed in blocks of bounded size: a block's distinct words go to the word table and come back with their
probabilities, so what moves is words of blocks, not tokens of documents.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import cut, held_out, text_of

#: Bytes of text in a block.
BLOCK = 32 << 20
#: Characters of the longest piece of the 32k vocabulary, for reference: lattices go by the vocabulary that is loaded.
LONGEST = 16
#: Words whose lattices a task holds at a time; rounds of re-estimation.
WORDS, ROUNDS = 1 << 14, 2
#: Shares of words that are spelled letter by letter, and of spelled words among those that a class has not; pseudo-counts of the prior.
FLAT, SPELLED, PRIOR = 0.02, 0.8, 300.0
#: Languages with a model of their own; the rest share one.
CLASSES = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x2581  # the letter that begins a word in the vocabulary


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Pieces:
    """A vocabulary: sorted hashes of its pieces, their log probabilities (a column for each model), those of the 256 bytes, and the
    characters of its longest piece."""

    keys: np.ndarray
    logs: np.ndarray
    bytes: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a sentencepiece model; the piece of score -i weighs 1 / (i + 100)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[int, float] = {}
        longest = 1
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or chr(SPACE) in piece[1:]:
                continue
            found[_hash(piece)] = 1 / (100 + min(-score, 1e6))
            longest = max(longest, len(piece))
        keys = np.array(sorted(found), np.uint64)
        weights = np.array([found[int(k)] for k in keys])
        weights /= weights.sum()
        return cls(keys, np.log(weights * 0.99)[:, None], np.full((256, 1), np.log(0.01 / 256)), longest)


def lattices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: their places in the list and a matrix of letters, the letter for a word's beginning first."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(sizes[order]) != 0)) if len(words) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(words)).tolist(), strict=True):
        size = int(sizes[order[a]])
        step = max(1, WORDS * 8 // (size + 1))
        for at in range(a, b, step):
            rows = order[at:min(b, at + step)]
            letters = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), size)
            yield rows, np.concatenate((np.full((len(rows), 1), SPACE, np.uint32), letters), axis=1)


def arcs(letters: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, piece) of all pieces in words of equal length, by the place where they end."""
    count, size = letters.shape
    prefix = np.zeros((size + 1, count), np.uint64)
    power = np.ones(pieces.longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            prefix[j + 1] = prefix[j] * BASE + letters[:, j] + np.uint64(1)
        for k in range(pieces.longest):
            power[k + 1] = power[k] * BASE
        for to in range(1, size + 1):
            for k in range(1, min(pieces.longest, to) + 1):
                want = prefix[to] - prefix[to - k] * power[k]
                at = np.minimum(np.searchsorted(pieces.keys, want), len(pieces.keys) - 1)
                rows = np.flatnonzero(pieces.keys[at] == want)
                if len(rows):
                    yield to - k, to, rows, at[rows]


def byte_logs(letters: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of each letter spelled in bytes, by place, word and model."""
    codes, inverse = np.unique(letters, return_inverse=True)
    logs = np.array([pieces.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum(axis=0) for c in codes])
    return np.swapaxes(logs[inverse.reshape(letters.shape)], 0, 1)


def forward(letters: np.ndarray, pieces: Pieces, keep: list | None = None) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix, by length, word and model."""
    count, size = letters.shape
    spelled = byte_logs(letters, pieces)
    alpha = np.full((size + 1, count, pieces.logs.shape[1]), -np.inf)
    alpha[0] = 0
    now = 0
    for a, b, rows, at in arcs(letters, pieces):
        for j in range(now + 1, b + 1):
            alpha[j] = alpha[j - 1] + spelled[j - 1]
        now = max(now, b)
        alpha[b, rows] = np.logaddexp(alpha[b, rows], alpha[a, rows] + pieces.logs[at])
        if keep is not None:
            keep.append((a, b, rows, at))
    for j in range(now + 1, size + 1):
        alpha[j] = alpha[j - 1] + spelled[j - 1]
    return alpha


def marginal(words: list[str], pieces: Pieces) -> np.ndarray:
    """Log probability of each word under each model, summed over all its segmentations."""
    out = np.zeros((len(words), pieces.logs.shape[1]))
    for rows, letters in lattices(words):
        out[rows] = forward(letters, pieces)[-1]
    return out


def expected(words: list[str], weights: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected counts of pieces, then of bytes, in some words under a single model; a column for each column of weights."""
    width = weights.shape[1]
    counts = np.zeros((len(pieces.keys) + 256, width))
    for places, letters in lattices(words):
        found: list = []
        alpha, spelled = forward(letters, pieces, found)[..., 0], byte_logs(letters, pieces)[..., 0]
        size, weight = letters.shape[1], weights[places]
        beta = np.full(alpha.shape, -np.inf)
        beta[size] = 0
        whole, by_start, pieces_hit, rows_hit, shares = alpha[size], {}, [], [], []
        for arc in found:
            by_start.setdefault(arc[0], []).append(arc)
        for a in range(size - 1, -1, -1):
            beta[a] = beta[a + 1] + spelled[a]
            for _, b, rows, at in by_start.get(a, ()):
                log = pieces.logs[at, 0]
                beta[a, rows] = np.logaddexp(beta[a, rows], beta[b, rows] + log)
                pieces_hit.append(at)
                rows_hit.append(rows)
                shares.append(alpha[a, rows] + log + beta[b, rows] - whole[rows])
        if shares:
            at, rows, share = np.concatenate(pieces_hit), np.concatenate(rows_hit), np.exp(np.concatenate(shares))
            for k in range(width):
                counts[:, k] += np.bincount(at, share * weight[rows, k], len(counts))
        share = np.exp(alpha[:-1] + spelled + beta[1:] - whole).T
        codes, inverse = np.unique(letters, return_inverse=True)
        for k in range(width):
            for c, n in zip(codes.tolist(), np.bincount(inverse.ravel(), (share * weight[:, k:k + 1]).ravel()).tolist(), strict=True):
                np.add.at(counts[:, k], [len(pieces.keys) + b for b in chr(c).encode("utf-8", "surrogatepass")], n)
    return counts


def _packed(classes: list[str]):
    """Tasks that give a block's distinct words with their training counts by class, and its documents as places of words."""
    of = {c: i for i, c in enumerate(classes)}
    width = len(classes) + 1
    names = ["block", "word", "place", "counts", "doc_id", "held_out", "n_tokens", "packed"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, number = zstandard.ZstdCompressor(level=1), 0
        index: dict[bytes, int] = defaultdict(itertools.count().__next__)  # a new word gets the next place
        counts = np.zeros((1 << 16, width), np.int64)
        size = 0

        def rows(block: int, n: int, word=None, place=None, count=None, doc=None, out=None, tokens=None, packed=None) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), doc_kind, pa.bool_(), pa.int64(), pa.binary())
            cells = [pa.nulls(n, k) if c is None else pa.array(c, k) if not isinstance(c, pa.Array) else c
                     for c, k in zip((word, place, count, doc, out, tokens, packed), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), *cells], names)

        def vocabulary(block: int) -> Iterator[pa.RecordBatch]:
            words = [w.decode() for w in index]
            for at in range(0, len(words), 50_000):
                part = counts[at:min(at + 50_000, len(words))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
                yield rows(block, len(part), words[at:at + 50_000], np.arange(at, at + len(part), dtype=np.int32), lists)

        for batch in batches:
            doc_kind = batch.schema.field(0).type
            outs, packed, tokens = batch.column(1).to_pylist(), [], []
            block, start = TaskContext.get().partitionId() << 32 | number, 0
            langs = batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(3)):
                raw = (text.as_py() or "").encode().lower()
                words = raw.split()
                places = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                if len(index) > len(counts):
                    counts = np.concatenate((counts, np.zeros((max(len(counts), len(index)), width), np.int64)))
                own, n = np.unique(places, return_counts=True)
                if not outs[k]:
                    counts[own, of.get(langs[k], width - 1)] += n
                data = np.concatenate((np.diff(own, prepend=0), n)).astype(np.uint32).tobytes()
                packed.append(press.compress(data))
                tokens.append(len(words) + 1)
                size += len(raw)
                if size >= BLOCK:
                    yield rows(block, len(packed), doc=batch.column(0).slice(start, len(packed)), out=outs[start:k + 1], tokens=tokens, packed=packed)
                    yield from vocabulary(block)
                    index, size, number = defaultdict(itertools.count().__next__), 0, number + 1
                    counts = np.zeros((1 << 16, width), np.int64)
                    packed, tokens, start, block = [], [], k + 1, TaskContext.get().partitionId() << 32 | number
            if packed:
                yield rows(block, len(packed), doc=batch.column(0).slice(start, len(packed)), out=outs[start:], tokens=tokens, packed=packed)
        if index:
            yield from vocabulary(TaskContext.get().partitionId() << 32 | number)

    return task


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _expectations(pieces: Pieces, width: int, each: bool):
    """Expected counts over distinct words: of every class that has them and of all together, or only of all together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = _matrix(batch.column(1), width) > 0
            weights = np.append(seen, seen.any(axis=1, keepdims=True), axis=1) if each else seen.any(axis=1, keepdims=True)
            total = total + expected(batch.column(0).to_pylist(), weights.astype(float), pieces)
        if isinstance(total, np.ndarray):
            at, of = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of), pa.array(total[at, of])], ["piece", "model", "n"])

    return task


def estimated(counts: np.ndarray, pieces: Pieces) -> Pieces:
    """Probabilities from expected counts; the last column is all classes' and the prior of the others."""
    every = counts[:, -1:] + 0.1
    every = every / every.sum()
    logs = np.log((counts + PRIOR * every) / (counts.sum(axis=0) + PRIOR))
    return Pieces(pieces.keys, logs[:-256], logs[-256:], pieces.longest)


@dataclass
class Totals:
    """Of all training tokens and of each class: how many, how many distinct, and the discount of a count."""

    tokens: np.ndarray
    distinct: np.ndarray
    discount: float
    ends: np.ndarray


def flat_logs(words: list[str]) -> np.ndarray:
    """Log probability of each word letter by letter, for strings that are no language: half a letter or digit, half any other."""
    plain = np.array([sum(c.isascii() and c.isalnum() for c in w) for w in words], float)
    size = np.fromiter(map(len, words), float, len(words))
    return np.log(0.1) + (size - 1) * np.log(0.9) + plain * np.log(0.5 / 36) + (size - plain) * np.log(0.5 / 0x110000)


def word_logs(words: list[str], counts: np.ndarray, pieces: Pieces, totals: Totals) -> np.ndarray:
    """log10 probabilities of words: a column for each class, and the last one for all classes together."""
    spelled = np.logaddexp(np.log(1 - FLAT) + marginal(words, pieces), np.log(FLAT) + flat_logs(words)[:, None])
    if spelled.shape[1] == 1:
        spelled = np.repeat(spelled, len(totals.tokens), axis=1)
    every = counts.sum(axis=1, keepdims=True)
    whole = float(totals.tokens[-1])
    own = np.append(counts, every, axis=1)
    many = np.maximum(totals.tokens, 1)
    with np.errstate(divide="ignore"):  # the log of no count
        back = np.logaddexp(np.log(SPELLED) + spelled, np.log((1 - SPELLED) * every / whole)) if whole else spelled.copy()
        back[:, -1] = spelled[:, -1]
        kept = np.log(np.maximum(own - totals.discount, 0) / many)
    rest = np.log(np.where(totals.tokens > 0, totals.discount * totals.distinct / many, 1.0))
    return np.logaddexp(kept, rest + back) / np.log(10)


def _scored(pieces: Pieces, totals: Totals):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(totals.tokens) - 1
            counts = _matrix(batch.column(1), width)
            logs = word_logs(batch.column(0).to_pylist(), counts, pieces, totals).astype(np.float32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1, dtype=np.int32) * (width + 1)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(axis=1)), cells], ["word", "c", "logs"])

    return task


def _totalled(totals: Totals, shares: np.ndarray, doc_kind: pa.DataType):
    """Scores of a block's documents from its words' probabilities."""
    tokens, distinct = int(totals.tokens[-1]), int(totals.distinct[-1])

    def block(words: pa.Table, docs: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        n = words.num_rows
        order = np.argsort(words.column("place").to_numpy())
        c = words.column("c").to_numpy()[order]
        logs = (words.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[order].astype(np.float64)
                if n else np.zeros((0, len(totals.tokens))))
        base = np.log10((c + 1) / (tokens + distinct + 1))
        many = np.maximum(totals.tokens, 1)
        ends = np.log10(np.where(totals.ends > 0, totals.ends / many, 1 / (many + 1)))
        known, total, marginals = [], [], []
        last = np.log10((int(totals.ends[-1]) + 1) / (tokens + distinct + 1))
        for data in docs.column("packed").to_pylist():
            own = np.frombuffer(unpress.decompress(data), np.uint32).astype(np.int64) if data else np.zeros(0, np.int64)
            at, times = np.cumsum(own[:len(own) // 2]), own[len(own) // 2:]
            known.append(int(times[c[at] > 0].sum()) + int(totals.ends[-1] > 0))
            total.append(float((times * base[at]).sum() + last))
            by = np.log10(shares) + times @ logs[at] + ends if len(at) else np.log10(shares) + ends
            top = by.max()
            marginals.append(float(top + np.log10((10 ** (by - top)).sum())))
        size = docs.num_rows
        return pa.table({"doc_id": docs.column("doc_id").cast(doc_kind), "held_out": docs.column("held_out"), "n_tokens": docs.column("n_tokens"),
                         "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * size, pa.int64()),
                         "base_score": pa.array(total, pa.float64()), "score": pa.array(marginals, pa.float64())})

    return block


def score(docs: DataFrame, vocabulary: str, modulus: int = 7, rest: int = 2, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text, lang, ...).

    Learns from rows whose crc32 of the id leaves another remainder than ``rest``. Tokens are words after lower-casing A to Z, and one end for
    each text; a null text is empty. ``base_score`` is the add-one unigram score, ``score`` the log10 probability of the text
    under the lattice model, summed over segmentations and over the models of ``classes`` languages, of the rest together, and of all. A
    language is only read in learning. Rows that repeat get a row each; if nothing is left to learn from, the vocabulary's
    own scores are the model. What comes to the driver is bounded by the vocabulary and the number of classes.
    """
    kind = dict(docs.dtypes)["doc_id"]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), F.coalesce(lang, F.lit("")).alias("lang"),
                       text_of().alias("text"))
    common = rows.filter("not held_out").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(classes).collect()
    names = [r["lang"] for r in common]
    store = cut(rows.mapInArrow(_packed(names), "block long, word string, place int, counts array<long>, "
                                f"doc_id {kind}, held_out boolean, n_tokens long, packed binary"))
    words = store.filter("word is not null").select("block", "word", "place", "counts")
    width = len(names) + 1
    table = cut(words.groupBy("word").agg(*[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(width)])
                .select("word", F.array(*[F.col(f"n{i}") for i in range(width)]).alias("counts")))
    every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = [F.col("counts")[i] for i in range(width)] + [every]
    facts = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"t{i}") for i, c in enumerate(cells)],
                      *[F.count_if(c > 0).alias(f"d{i}") for i, c in enumerate(cells)],
                      F.count_if(every == 1).alias("once"), F.count_if(every == 2).alias("twice")).first()
    trained = dict(rows.filter("not held_out").groupBy(F.when(F.col("lang").isin(names), F.col("lang")).alias("lang"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.array([trained.get(n, 0) for n in names] + [trained.get(None, 0)] + [sum(trained.values())], np.int64)
    tokens = np.array([facts[f"t{i}"] for i in range(width + 1)], np.int64) + ends
    distinct = np.array([facts[f"d{i}"] for i in range(width + 1)], np.int64) + (ends > 0)
    discount = facts["once"] / (facts["once"] + 2 * facts["twice"]) if facts["once"] else 0.5
    totals = Totals(tokens, distinct, min(max(discount, 0.1), 0.95), ends)
    pieces = Pieces.load(vocabulary)
    for turn in range(rounds if tokens[-1] > ends[-1] else 0):
        each = turn == rounds - 1
        found = (table.filter(every > 0).mapInArrow(_expectations(pieces, width, each), "piece long, model long, n double")
                 .groupBy("piece", "model").agg(F.sum("n").alias("n")).collect())  # a row for each piece and model at most
        counts = np.zeros((len(pieces.keys) + 256, width + 1 if each else 1))
        for r in found:
            counts[r["piece"], r["model"]] = r["n"]
        pieces = estimated(counts, pieces)
    shares = np.append(ends[:-1], max(1, int(ends[-1]) // 4)).astype(float) + 0.5
    scored = table.mapInArrow(_scored(pieces, totals), "word string, c long, logs array<float>")
    back = words.select("block", "word", "place").join(scored, "word").select("block", "place", "c", "logs")
    packed = store.filter("word is null").select(F.col("block").alias("of"), "doc_id", "held_out", "n_tokens", "packed")
    doc_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return (back.groupBy("block").cogroup(packed.groupBy("of"))
            .applyInArrow(_totalled(totals, shares / shares.sum(), doc_kind),
                          f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
