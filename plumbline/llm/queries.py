"""Registered queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import (
    bpe, conversations, exact_dedup, language, lattice_lm, mixing, oracles, quality, sentence_dedup, simhash, substring_dedup, syncmers,
    token_files, vector_codes)
from plumbline.llm.common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the package is part of every worker's Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated strings of 200 bytes are removed."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).drop("kept")


@query
def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all texts under a subword lattice model of the documents that are not held out."""
    return lattice_lm.score(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their connected components."""
    return simhash.near_components(documents(spark, sf_dir))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting quotient filters, then comparison of the bytes."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


ORACLES["op4_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t"""


@query
def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed syncmer fingerprints of every text and of its edited text."""
    return syncmers.edited_fingerprints(documents(spark, sf_dir))


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back."""
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by rank-order profiles that are learned from the documents that are not held out."""
    out = held_out(F.col("doc_id"), 4)
    docs = documents(spark, sf_dir).withColumn("held_out", out)
    return language.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to ORC files and read back."""
    return token_files.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; labelled quality makes a document more or less likely in the fractional epoch."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return mixing.mix(documents(spark, sf_dir), labels)


@query
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that repeat an earlier run of sentences are removed."""
    cleaned = sentence_dedup.sentence_span_dedup(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "chars_removed", "kept_sha256")


@query
def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of all texts, learned from labels of the documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    return quality.scored(docs, labels, ~F.col("held_out"), keep=["doc_id", "held_out"])


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product quantisation codes of all vectors, nearest entries by equal-average search."""
    return vector_codes.coded_with_sums(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are damaged by a hash and repaired by the cheapest edits."""
    return conversations.repair(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"), conversations.damage_kind)


ORACLES |= {"op12_vector_codes": oracles.vector_codes(), "op13_conversation_repair": oracles.conversation_repair()}
