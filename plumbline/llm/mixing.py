"""Mixing of sources to target weights: weighted sampling with exponential keys, in whole epochs first.

Every document draws a key -ln(u) / quality, u from a hash of its id and text (Efraimidis and Spirakis 2006). Within its source the
documents in key order fill the token budget that is left after the complete epochs. The order is never made in one task:
keys fall into fixed buckets, bucket sums are prefix-summed per source, and only inside a bucket rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import WORD, cut, text_of

BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(salt: str, *key: Column) -> Column:
    """A number in (0, 1) from a hash; the same for the same key in every run."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 11).cast("double") + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """Targets per source from (skey, source, source_size): water filling under the cap ``most`` x size.

    The table has a row for each source, so its windows are small whatever the number of documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    ranked = sizes.withColumn("weight", share).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "skey")
    everything = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * float(total)
    level = ranked.withColumn("level", (budget - before) / rest).withColumn("full", F.col("level") >= F.col("ratio"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return (level.withColumn("final", final)
            .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight")))
            .select("skey", "source_size", "target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), total: float = 1.5,
        most: float = 2.0, salt: str = "mix", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row of (doc_id, text, source, ...), with size, source_size, target and taken.

    ``size`` is the number of words; sources in code point order (null last) carry ``weights`` in turn and share ``total``
    times all words, none above ``most`` times its own. ``taken`` counts the words that the mix takes of a document: its
    complete epochs, plus what falls below the rest of the budget in key order. The document at the budget's edge is taken
    in part, so a source's taken words equal its rounded target. Documents without words take 0. ``labels`` (doc_id,
    quality) weigh the draw: 2 where good, 0.5 where bad, 1 where unknown; of several labels the best. Rows that repeat an
    id and its text share a key; their order does not matter. An empty table gives an empty table. Texts move only if
    carried.
    """
    kept = [c for c in carry if c not in ("size", "source_size", "target", "taken")]
    base = docs.select(F.struct(*kept).alias("_carried"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), word_count(text_of()).alias("size"),
                       uniform(salt, F.col("doc_id"), text_of()).alias("_uniform"))
    if "text" not in kept:
        base = cut(base)  # small rows, read by all that follows
    weight = F.lit(1.0)
    if labels is not None:
        best = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality"))
        base = base.join(best, F.col("_id") == F.col("_labelled"), "left")
        weight = F.when(F.col("_quality") >= 1, 2.0).when(F.col("_quality") < 1, 0.5).otherwise(1.0)
    rows = (base.withColumn("_draw", -F.log("_uniform") / weight)
            .withColumn("_skey", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("")))
            .withColumn("_bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("_draw"))) * BUCKETS)).cast("int")))
    sums = (rows.groupBy("_skey", "_bucket").agg(F.sum("size").alias("bucket_size"), F.first("_source").alias("source")))
    sizes = sums.groupBy(F.col("_skey").alias("skey")).agg(F.first("source").alias("source"),
                                                           F.sum("bucket_size").alias("source_size"))
    plan = source_targets(sizes, weights, total, most)
    earlier = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (sums.withColumn("_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
               .join(plan, F.col("_skey") == plan["skey"])
               .select(F.col("_skey").alias("_k"), F.col("_bucket").alias("_b"), "_before", "source_size", "target"))
    joined = rows.join(buckets, (F.col("_skey") == F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    inside = (Window.partitionBy("_skey", "_bucket").orderBy("_draw", "_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.round("target").cast("long") - F.col("_epochs") * F.col("source_size")
    done = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("_done")))
    return (joined.withColumn("_epochs", epochs).withColumn("_done", done)
            .withColumn("taken", F.col("_epochs") * F.col("size") + part)
            .select("_carried.*", "size", "source_size", "target", "taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken; where a copy is taken in part, its first words."""
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    wanted = F.concat(F.array_repeat(F.lit(None).cast("long"), whole),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = mixed.withColumn("_part", F.explode(wanted))
    words = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_part").cast("int"))
    return rows.withColumn("text", F.when(F.col("_part").isNull(), F.col("text")).otherwise(F.array_join(words, ""))).drop("_part")

