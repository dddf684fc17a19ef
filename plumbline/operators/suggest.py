"""Suggests column roles from names, cardinalities, date parsing and split-like values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import TIMESTAMP_FORMATS, is_datetime, is_numeric
from plumbline.operators.distribution import bounded_rows, value_counts
from plumbline.operators.profile import _texts
from plumbline.roles import Roles


@dataclass(frozen=True)
class RoleRule:
    """Score of a role: weight per matching name pattern plus points for conditions on the profile."""

    role: str
    patterns: tuple[str, ...]
    weight: float
    bonuses: tuple[tuple[str, float], ...]
    threshold: float
    limit: int = 1
    date_points: float = 0.0
    takes: bool = True


# Name patterns, weights, conditions and thresholds per role.
_MANY = "distinct BETWEEN 2 AND 50"
TABULAR_ROLES = (
    RoleRule("label", (r"\blabel\b", r"\btarget\b", r"\boutcome\b", r"\bclass\b", r"\bgt\b", r"\by\b"), 3.0,
             (("distinct BETWEEN 2 AND least(50, floor(0.01 * rows) + 2)", 2), ("ratio < 0.2", 1), ("ratio > 0.9", -2), ("dates > 0.8", -2)), 2.0, takes=False),
    RoleRule("split", (r"\bsplit\b", r"\bfold\b", r"\bset\b", r"\bpartition\b"), 3.0,
             (("distinct <= 20", 2), ("split_like", 2), ("ratio > 0.5", -2)), 2.0, takes=False),
    RoleRule("time", (r"\btime\b", r"\bdate\b", r"\btimestamp\b", r"\bcreated\b", r"\bupdated\b"), 3.0,
             (("dates < 0.3", -1.5),), 2.0, date_points=2.0, takes=False),
    RoleRule("ids", (r"\bid\b", r"\buuid\b", r"\bguid\b", r"\buser[_\s-]?id\b", r"\bserial\b"), 3.0,
             (("ratio > 0.95", 2.5), ("dates > 0.8", -2)), 3.5, 3),
    RoleRule("groups", (r"\bgender\b", r"\bsex\b", r"\bage\b", r"\bregion\b", r"\bcountry\b", r"\bgroup\b", r"\bsite\b"), 2.0,
             ((_MANY, 2), ("ratio > 0.5", -1), ("dates > 0.8", -2)), 2.5, 3),
)
SERIES_ROLES = (
    RoleRule("time", (r"\btime\b", r"\bdate\b", r"\btimestamp\b", r"\bcreated\b", r"\bupdated\b"), 3.0,
             (("dates < 0.3", -2),), 2.0, date_points=3.0, takes=False),
    RoleRule("label", (r"\blabel\b", r"\btarget\b", r"\boutcome\b", r"\bclass\b"), 3.0,
             (("dates > 0.8", -3), ("ratio > 0.9", -2), (_MANY, 2)), 2.0, takes=False),
    RoleRule("entities", (r"\bentity\b", r"\bseries\b", r"\bdevice\b", r"\bsensor\b", r"\buser\b", r"\bsite\b"), 2.5,
             (("numeric", -2), ("dates > 0.8", -3), ("distinct BETWEEN 2 AND least(2000, floor(0.2 * rows) + 2)", 2)), 2.5, 2),
    RoleRule("ids", (r"\bid\b", r"\buuid\b", r"\bguid\b", r"\bserial\b"), 2.5, (("ratio > 0.95", 3), ("dates > 0.8", -3)), 3.0, 3),
    RoleRule("groups", (r"\bgender\b", r"\bsex\b", r"\bage\b", r"\bregion\b", r"\bcountry\b"), 2.0, ((_MANY, 2), ("dates > 0.8", -2)), 2.5, 3),
)
ASSET_ROLES = (
    RoleRule("label", (r"\blabel\b", r"\btarget\b", r"\boutcome\b", r"\bclass\b", r"\bground[_\s-]?truth\b", r"\bgt\b", r"\bcategory\b"), 3.0,
             (("distinct BETWEEN 2 AND least(100, floor(0.02 * rows) + 2)", 2), ("ratio < 0.3", 1), ("ratio > 0.9", -2)), 2.0, takes=False),
    RoleRule("split", (r"\bsplit\b", r"\bfold\b", r"\bset\b", r"\bpartition\b", r"\btrain[_\s-]?test\b"), 3.0,
             (("distinct <= 30", 2), ("split_like", 2), ("ratio > 0.5", -2)), 2.0, takes=False),
    RoleRule("time", (r"\btime\b", r"\bdate\b", r"\btimestamp\b", r"\bcreated\b", r"\bupdated\b", r"\bcaptured\b"), 3.0, (), 2.0,
             date_points=2.0, takes=False),
    RoleRule("path", (r"\bpath\b", r"\bfilepath\b", r"\bfile\b", r"\bimage\b", r"\bimg\b", r"\buri\b", r"\burl\b", r"\bfilename\b"), 3.0,
             (("ratio > 0.7", 1),), 2.0, takes=False),
    RoleRule("ids", (r"\bid\b", r"\buuid\b", r"\bguid\b", r"\brecord[_\s-]?id\b", r"\bimage[_\s-]?id\b"), 3.0, (("ratio > 0.95", 2.5),), 3.5, 3),
    RoleRule("groups", (r"\bgender\b", r"\bsex\b", r"\bage\b", r"\bregion\b", r"\bcountry\b", r"\bethnicity\b", r"\brace\b", r"\bgroup\b",
                        r"\bskin[_\s-]?tone\b", r"\bphenotype\b"), 3.0, ((_MANY, 2), ("ratio > 0.6", -1)), 2.5, 5),
    RoleRule("sources", (r"\bsource\b", r"\borigin\b", r"\bprovider\b", r"\bacquisition\b", r"\bcamera\b", r"\bsensor\b", r"\bdevice\b"), 3.0,
             (("distinct BETWEEN 2 AND 500", 1.5),), 2.5, 3),
    RoleRule("conditions", (r"\bweather\b", r"\blighting\b", r"\blight\b", r"\billumination\b", r"\bblur\b", r"\bnoise\b", r"\bocclusion\b",
                            r"\bviewpoint\b", r"\bangle\b", r"\bscale\b", r"\bseason\b", r"\btime[_\s-]?of[_\s-]?day\b"), 3.0, (), 2.5, 6),
    RoleRule("annotators", (r"\bannotator\b", r"\blabeler\b", r"\brater\b", r"\breview\b"), 3.0, (), 2.5, 3),
)
SPLIT_WORDS = "train|test|val|valid|dev"


def split_like_columns(values: DataFrame, words: str = SPLIT_WORDS) -> DataFrame:
    """Columns whose twelve most frequent lower-cased values contain a split word."""
    counts = values.groupBy("column", F.lower("value").alias("value")).agg(F.sum("n").alias("n"))
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("_r", F.row_number().over(best)).filter("_r <= 12")
    return top.groupBy("column").agg(F.max(F.col("value").rlike(words)).alias("split_like"))


def role_profile(df: DataFrame, words: str = SPLIT_WORDS) -> DataFrame:
    """One row per column: position, numeric, rows, distinct, ratio, date success, split words.

    Dates are tried once per distinct value, not once per row.
    """
    values = value_counts(_texts(df, df.columns), ["column"])
    parsed = F.coalesce(*[F.try_to_timestamp("value", F.lit(f)) for f in TIMESTAMP_FORMATS]).isNotNull()
    stats = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum(F.when(parsed, F.col("n")).otherwise(0)).alias("_dates"))
    kinds = df.sparkSession.createDataFrame(
        [(i, f.name, is_numeric(f.dataType), is_datetime(f.dataType)) for i, f in enumerate(df.schema)],
        "position int, column string, numeric boolean, datetime boolean")
    rows = df.agg(F.count(F.lit(1))).scalar()
    joined = kinds.join(F.broadcast(stats), "column", "left").join(F.broadcast(split_like_columns(values, words)), "column", "left")
    framed = joined.withColumn("rows", F.greatest(F.lit(1), rows))
    dates = F.when(F.col("datetime"), 1.0).when(F.col("numeric"), 0.0).otherwise(F.coalesce("_dates", F.lit(0)) / F.col("rows"))
    return framed.select("position", "column", "numeric", "rows", F.coalesce("distinct", F.lit(0)).alias("distinct"),
                         (F.coalesce("distinct", F.lit(0)) / F.col("rows")).alias("ratio"), dates.alias("dates"),
                         F.coalesce("split_like", F.lit(False)).alias("split_like"))


def _score(rule: RoleRule) -> Column:
    name = F.lower(F.trim("column"))
    hits = sum((name.rlike(p).cast("int") for p in rule.patterns), F.lit(0))
    points = sum((F.when(F.expr(cond), float(p)).otherwise(0.0) for cond, p in rule.bonuses), F.lit(0.0))
    return hits * rule.weight + points + F.col("dates") * rule.date_points


def role_scores(df: DataFrame, rules: Sequence[RoleRule] = TABULAR_ROLES, words: str = SPLIT_WORDS) -> DataFrame:
    """(role, column, position, score) of every column for every role."""
    cells = F.array(*[F.struct(F.lit(r.role).alias("role"), _score(r).alias("score")) for r in rules])
    return role_profile(df, words).select("column", "position", F.explode(cells).alias("c")).select("c.role", "column", "position", "c.score")


def suggest_roles(df: DataFrame, rules: Sequence[RoleRule] = TABULAR_ROLES, words: str = SPLIT_WORDS, **explicit) -> Roles:
    """Roles with the best-scoring columns; explicitly given roles win over suggestions.

    Only scores (columns x roles) reach the driver. Single roles are chosen first, then the list roles
    in rule order, each from the columns that are still free.
    """
    scores = bounded_rows(role_scores(df, rules, words), len(df.columns) * len(rules))
    taken, chosen = set(), {}
    for rule in rules:
        ranked = sorted((r for r in scores if r["role"] == rule.role and r["score"] >= rule.threshold),
                        key=lambda r: (-r["score"], r["position"]))
        free = [r["column"] for r in ranked if not rule.takes or r["column"] not in taken][:rule.limit]
        taken.update(free)
        chosen[rule.role] = tuple(free) if rule.takes else (free[0] if free else None)
    return replace(Roles(**chosen), **{k: v for k, v in explicit.items() if v is not None})
