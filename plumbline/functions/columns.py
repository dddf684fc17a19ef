"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Personal-data patterns.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_like": r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}\b",
    "ip_v4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "credit_card_like": r"\b(?:\d[ -]*?){13,19}\b",
}

TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy",
    "dd.MM.yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM",
)


def col(name: str) -> Column:
    """A top-level column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def coarse_type(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_datetime(dtype):
        return "datetime"
    return "nested" if is_nested(dtype) else "categorical"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if f.name not in skip and is_numeric(f.dataType)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema
            if f.name not in skip and coarse_type(f.dataType) == "categorical"]


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: coercing cast, NaN read as missing."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    value = col(name).try_cast("double") if isinstance(dtype, T.StringType) else col(name).cast("double")
    if isinstance(dtype, (T.StringType, T.FloatType, T.DoubleType)):
        return F.nanvl(value, F.lit(None).cast("double"))
    return value


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so that one notion of missing remains."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(*[
        (F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)) for c in df.columns])


def missing_flag(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return (c.isNull() | F.isnan(c)).cast("int")
    return c.isNull().cast("int")


def identity(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Grouping keys that identify row content, nulls equal.

    Long strings travel as their SHA-256, so a shuffle never carries whole texts; nested values
    are compared by their JSON text because maps cannot be grouped.
    """
    keys = []
    for name in columns:
        dtype = df.schema[name].dataType
        value = F.to_json(F.struct(col(name))) if is_nested(dtype) else col(name)
        if isinstance(dtype, T.BinaryType):
            value = F.sha2(value, 256)
        elif isinstance(dtype, T.StringType) or is_nested(dtype):
            value = F.when(F.length(value) > 64, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        keys.append(value.alias(name))
    return keys


def timestamp_of(df: DataFrame, name: str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Coercing timestamp: unparseable text becomes null."""
    dtype = df.schema[name].dataType
    if is_datetime(dtype):
        return col(name).cast("timestamp_ntz")
    text = col(name).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def slice_label(ts: Column, mode: str) -> Column | None:
    """Period label of a timestamp; labels sort like the periods they name."""
    if mode == "month":
        return F.date_format(ts, "yyyy-MM")
    if mode == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if mode == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    if mode == "week":
        monday = F.date_trunc("week", ts)
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(monday.cast("date"), 6), "yyyy-MM-dd"))
    return None


def slice_bounds(ts: datetime, mode: str) -> tuple[datetime, datetime]:
    """Start of the period that holds a timestamp, and of the next one: the inverse of ``slice_label``."""
    day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
    if mode == "day":
        return day, day + timedelta(days=1)
    if mode == "week":
        monday = day - timedelta(days=day.weekday())
        return monday, monday + timedelta(days=7)
    months = 3 if mode == "quarter" else 1
    first = day.year * 12 + (day.month - 1) // months * months
    return tuple(day.replace(year=m // 12, month=m % 12 + 1, day=1) for m in (first, first + months))


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch of a zone-less timestamp, fraction included."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def uniform(seed: int, *keys: Column) -> Column:
    """Reproducible number in [0, 1) from row keys; used wherever a random draw is needed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds floating columns for reports."""
    return df.select(*[
        (F.round(col(f.name), digits).alias(f.name)
         if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name))
        for f in df.schema])


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of failing on an empty denominator."""
    return F.when(denominator != 0, numerator / denominator)


def slug(value: Column) -> Column:
    """File-name-safe form of a text."""
    cleaned = F.regexp_replace(F.trim(value), "[^A-Za-z0-9_.-]+", "-")
    short = F.substring(F.regexp_replace(cleaned, "^-+|-+$", ""), 1, 80)
    return F.when(short == "", F.lit("dataset")).otherwise(short)
