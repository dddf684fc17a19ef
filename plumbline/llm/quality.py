"""Document quality by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a threshold at a score quantile.

Every text becomes a short vector of shares and sizes. Of two labelled documents the one of quality 1 is preferred; the model gives
each document a worth, and the chance that it is preferred is the logistic function of the difference of the two worths.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import cut, text_of
from plumbline.operators.distribution import quantiles, value_counts
from plumbline.operators.series import positions

#: Pairs of each preferred document.
PARTNERS = 4
#: The score at the threshold.
AT_THRESHOLD = 0.3
# Marks that end sentences, marks of plain prose, and names of the features in order.
STOPS, PROSE = ".!?。！？", ".,;:!?'\"-()。、！？"
FEATURES = ("characters", "words", "word length", "letters", "capitals", "digits", "prose marks", "other marks", "exclamations",
            "words without a letter", "words that end in marks", "distinct words", "most frequent word", "word repeated at once",
            "repeated lines", "line length", "lines without a stop", "empty")
LINES = re.compile("[\n\r]+")


def features(text: str) -> list[float]:
    """Shares and log sizes of one whole text; an empty text has zeros and its own mark."""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    chars = Counter(text)
    letters = sum(n for c, n in chars.items() if c.isalpha())
    capitals = sum(n for c, n in chars.items() if c.isupper())
    digits = sum(n for c, n in chars.items() if c.isdigit())
    blanks = sum(n for c, n in chars.items() if c.isspace())
    prose = sum(chars[c] for c in PROSE)
    size, n = len(text) - blanks, len(words)
    kinds = Counter(words)
    bare = sum(k for w, k in kinds.items() if not any(map(str.isalpha, w)))
    marked = sum(k for w, k in kinds.items() if not w[-1].isalnum() and w[-1] not in PROSE)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x.strip() for x in LINES.split(text) if x.strip()]
    return [float(np.log1p(len(text))), float(np.log1p(n)), float(np.log1p(size / n)), letters / size, capitals / max(1, letters), digits / size,
            prose / size, (size - letters - digits - prose) / size, chars["!"] / size, bare / n, marked / n, len(kinds) / n,
            max(kinds.values()) / n, again / n, 1 - len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))),
            sum(x[-1] not in STOPS for x in lines) / len(lines), 0.0]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "features"])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the features of every whole text; texts stay where they are."""
    kinds = dict(docs.dtypes)
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text_of().alias("_text")).mapInArrow(_measured, f"{spec}, features array<double>")


@dataclass
class Ranking:
    """Worths: a weight for each feature, and the worth at the threshold."""

    weights: np.ndarray
    threshold: float

    def worth(self) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(self.weights.tolist()):
            total = total + F.col("features")[i] * w
        return total

    def score(self) -> Column:
        """From 0 to 1: the chance of being preferred to a document whose score is 0.5; at the threshold it is ``AT_THRESHOLD``."""
        shift = float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)))
        return 1 / (1 + F.exp(-(self.worth() - self.threshold + shift)))


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The value with ``share`` of all weight at or below it; the middle of two values if the share ends exactly between them."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    target = share * total[-1]
    at = min(int(np.searchsorted(total, target * (1 - 1e-12))), len(order) - 1)
    low = values[order[at]]
    ends = at + 1 < len(order) and abs(total[at] - target) <= 1e-9 * total[-1]
    return float((low + values[order[at + 1]]) / 2 if ends else low)


def fit(rows: DataFrame, sample: int | None = None, partners: int = PARTNERS) -> Ranking:
    """A ranking from rows of (doc_id, features, quality), quality 0 or 1.

    All rows are learned from; with ``sample`` about that many of each class, those of the smallest hashes.
    Each preferred document meets ``partners`` others, each of the others about equally often. The threshold is the quantile of the
    worths, each class in its share of all rows, at the share of quality 0. Without rows of both classes all worths are 0 and the threshold is
    as far below them as makes every score 0.5.
    """
    sizes = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Ranking(np.zeros(len(FEATURES)), float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))))
    draw = F.xxhash64(F.lit("quality"), "doc_id", "features")
    drawn = rows.withColumn("_draw", draw)
    if sample is not None:
        share = F.when(F.col("quality") == 0, sample / sizes[0]).otherwise(sample / sizes[1])
        drawn = drawn.filter(F.shiftrightunsigned("_draw", 11).cast("double") / float(1 << 53) < share)
    some = cut(drawn.select("features", "quality", "_draw"))
    scale = some.agg(*[F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(len(FEATURES))]).first()
    scale = np.array([s or 0.0 for s in scale])
    ranked = positions(some, ["quality"], ["_draw", "features"], F.shiftright("_draw", 52)).withColumn("_at", F.col("_pos") - 1)
    counts = {r["quality"]: r["n"] for r in ranked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):  # a class of a few rows that the hash left out
        return fit(rows, None, partners)
    good = (ranked.filter("quality = 1").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(partners - 1))))
            .select(F.col("features").alias("good"), F.pmod(F.col("_at") * partners + F.col("_r"), F.lit(counts[0])).alias("_at"), "_r", F.col("_at").alias("_own")))
    pairs = good.join(ranked.filter("quality = 0").select(F.col("features").alias("bad"), "_at"), "_at")
    # half of the pairs are turned round, so that both outcomes are there
    turn = F.when(F.pmod(F.col("_own") + F.col("_r"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    apart = F.array(*[turn * (F.col("good")[i] - F.col("bad")[i]) / F.lit(float(s) if s > 1e-12 else 1.0) for i, s in enumerate(scale)])
    table = pairs.select(array_to_vector(apart).alias("difference"), ((turn + 1) / 2).alias("preferred"))
    model = LogisticRegression(featuresCol="difference", labelCol="preferred", fitIntercept=False, standardization=False, regParam=0.001,
                               maxIter=60, tol=1e-8).fit(table)
    weights = np.round(model.coefficients.toArray(), 6) / np.where(scale > 1e-12, scale, 1.0)
    found = Ranking(weights, 0.0)
    if sample is None:  # between the last worth within the share of quality 0 and the next
        middle = (sizes[0] - 0.5) / (sizes[0] + sizes[1] - 1)
        worths = value_counts(some.select(F.lit(1).alias("key"), found.worth().alias("value")), ["key"])
        found.threshold = quantiles(worths, ["key"], {"t": middle}).first()["t"]
        return found
    worths = some.select(found.worth().alias("w"), "quality").collect()  # bounded by the sample
    values, kinds = np.array([r["w"] for r in worths]), np.array([r["quality"] for r in worths])
    each = np.where(kinds == 0, sizes[0] / max(1, (kinds == 0).sum()), sizes[1] / max(1, (kinds == 1).sum()))
    found.threshold = weighted_quantile(values, each, sizes[0] / (sizes[0] + sizes[1]))
    return found


def scored(docs: DataFrame, labels: DataFrame, train: Column, sample: int | None = None, partners: int = PARTNERS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) of every row of (doc_id, text, ...), with score and predicted.

    Labels are rows of (doc_id, quality, ...); those with a null id or with another quality than 0 and 1 are not used, repeated ones count once,
    and a document labelled both ways counts for both. Only documents where ``train`` holds are learned from; only the text is scored. A null text is
    empty; empty texts share one score. Texts are read whole, whatever their length. Rows that repeat an id get a row each; an
    empty table gives an empty one. Where nothing can be learned every score is 0.5.
    """
    keep = keep or ["doc_id"]
    table = cut(measured(docs.withColumn("_train", train), [*keep, "_train"]))  # read for the fit and for the scores
    known = (labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
             .distinct())
    rows = table.filter("_train").join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "features", "quality")
    found = fit(rows, sample, partners)
    with_score = table.withColumn("_score", found.score())
    return with_score.select(*keep, F.col("_score").alias("score"), (F.col("_score") >= AT_THRESHOLD).cast("int").alias("predicted"))


def best(documents: DataFrame, share: float) -> DataFrame:
    """Of scored documents those at or above the score that about ``1 - share`` of them stay below."""
    limit = documents.agg(F.percentile_approx("score", 1 - share, 10_000)).first()[0]
    return documents.filter(F.col("score") >= F.lit(limit)) if limit is not None else documents
