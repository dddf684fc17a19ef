"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's tokens are its runs of up to 16 characters without white space; in a longer run, every eight consecutive characters are one. A
window of three tokens is an anchor when the token with the smallest hash stands at one of its edges: that depends on the window alone,
so equal passages have equal anchors wherever they stand, also inside text without white space. All anchors count: two texts are as like as
the shares of their sets of anchors that are common, and a fingerprint is a digest of the set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import partitions, text_of

#: The first group is a short run, which is taken whole, or the eight characters from each place of a longer one.
TOKEN = r"(?=((?<!\S)\S{1,16}+(?!\S)|\S{8}))(?:(?<!\S)\S{1,16}+(?!\S))?+"
LEAST = -(1 << 63)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def placed(text: Column) -> Column:
    """(position, anchor) of all closed syncmers of a text in order; a text of one or two tokens has its tokens.

    A position is the number of tokens before the anchor.
    """

    def at(i: Column, anchor: Column) -> Column:
        return F.struct(i.cast("int").alias("position"), anchor.alias("anchor"))

    def of(h: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)
            return F.when(F.least(a, c) <= b, at(i, F.xxhash64(a, b, c)))

        windows = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - 3), window), lambda x: x.isNotNull())
        return F.when(F.size(h) < 3, F.transform(h, lambda x, i: at(i, x))).otherwise(windows)

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: F.xxhash64(t)), of)


def anchors(text: Column) -> Column:
    """Hashes of all closed syncmers of a text in order."""
    return F.transform(placed(text), lambda x: x["anchor"])


def anchor_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, position, anchor): a row for each anchor of every row of (doc_id, text, ...); none for a text without tokens."""
    return docs.select("doc_id", F.inline(placed(text_of())))


def distinct(text: Column) -> Column:
    """The set of a text's anchors, sorted."""
    return F.sort_array(F.array_distinct(anchors(text)))


def shown(marks: Column) -> Column:
    """SHA-256 of a sorted set of anchors as hex digits; empty for none."""
    return F.when(F.size(marks) == 0, "").otherwise(F.sha2(F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x), 16, "0")), ""), 256))


def likeness(a: Column, b: Column) -> Column:
    """The resemblance of two sets of anchors: common ones among all; 1 for two empty ones."""
    common = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, *columns, next) of every row, ``next`` being a struct of the columns of the row with the next larger id.

    After the last row comes the first. Rows that repeat an id stand in order of the columns; a null id comes first. Ranges of ids are
    dealt to tasks, and each range also gets a copy of the first row of the one after it, so rows move once.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    count = partitions(spark)
    shares = [i / count for i in range(1, count)] or [0.5]
    cuts, first = docs.agg(F.percentile_approx(order, shares, 10_000), F.min(order)).first()
    cuts = sorted({c for c in cuts or [] if c != first})  # at most as many as shuffle partitions
    starts = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    at = F.size(F.filter(starts, lambda c: c <= F.col("_order")))
    places = F.when(F.col("_order") == F.lit(first), F.array(F.col("_range"), F.lit(len(cuts))))
    places = places.when(F.array_contains(starts, F.col("_order")), F.array(F.col("_range"), F.col("_range") - 1))
    rows = (docs.select("doc_id", *columns).withColumn("_order", order).withColumn("_range", at)
            .select("*", F.posexplode(places.otherwise(F.array(F.col("_range")))).alias("_copy", "_place")))
    # a copy of the next range's first row comes after all rows of a range
    ahead = Window.partitionBy("_place").orderBy("_copy", "_order", *columns)
    return (rows.withColumn("next", F.lead(F.struct(*columns)).over(ahead)).filter("_copy = 0").select("doc_id", *columns, "next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of (doc_id, text, ...) and of its edited text.

    The edited text has the last quarter of its code points replaced by as many of the next document's, or by all of them. Gives (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A null text is empty; an empty text has an empty
    fingerprint, alike only to itself. Repeated rows get a row each; an only row is its own next one. Other columns are ignored.
    """
    # anchors are made where they are compared: only texts move
    pairs = with_next(docs.select("doc_id", text_of().alias("body")), ["body"])
    quarter = F.floor(F.char_length("body") / 4).cast("int")
    text = F.concat(F.substring(F.col("body"), F.lit(1), F.char_length("body") - quarter),
                    F.substring(F.col("next.body"), F.lit(1), quarter))
    edited = pairs.select("doc_id", F.char_length("body").cast("long").alias("n_chars"), text.alias("edited"), "body",
                          F.col("next.body").alias("next_body"))
    made = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), distinct(F.col("body")).alias("marks"),
                         distinct(F.col("edited")).alias("edited_marks"), distinct(F.col("next_body")).alias("next_marks"))
    return made.select("doc_id", "n_chars", "edited_sha256", shown(F.col("marks")).alias("fingerprint"),
                       shown(F.col("edited_marks")).alias("edited_fingerprint"),
                       likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
                       likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
