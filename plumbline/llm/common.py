"""Shared helpers of the corpus operators: shared folder, cut lineage, text normalisation, row identity."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The ASCII letters that normalisation lowers, and the characters that end a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the place that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a folder of this session's own is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{root.rstrip('/')}/plumbline-llm-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows as a table to the shared folder and reads it back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker has made stays for its next tasks of that name: a tokenizer with the words that it has met.

    A worker keeps one such thing; what another operator has left goes first.
    """
    store = sys.modules.setdefault("plumbline_kept", types.ModuleType("plumbline_kept"))
    if not hasattr(store, name):
        let_go()
        setattr(store, name, make())
    return getattr(store, name)


def let_go() -> None:
    """Frees what earlier tasks of other operators have left in this Python worker."""
    store = sys.modules.get("plumbline_kept")
    for name in [n for n in vars(store or types.SimpleNamespace()) if not n.startswith("__")]:
        delattr(store, name)


@contextmanager
def without_collector() -> Iterator[None]:
    """For code that makes very many small lists and no cycles: the garbage collector would only walk over them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself where visible, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}
