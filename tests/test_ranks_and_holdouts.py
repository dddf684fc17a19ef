"""Ranks with frequent values, periods and their ranges, stratified hold-outs, fitted categories, own checks."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import slice_bounds, slice_label
from plumbline.operators import drift, labels
from plumbline.operators.distribution import average_ranks
from plumbline.plans import audit
from plumbline.roles import Roles


def test_average_ranks_with_a_frequent_value(spark):
    rows = [(k, None if i % 11 == 0 else 5 if i % 3 else i % 40, i) for k in ("a", "b", None) for i in range(300)]
    got = average_ranks(spark.createDataFrame(rows, "k string, v int, i int").repartition(5), ["k"], "v", "r").collect()
    pdf = pd.DataFrame(rows, columns=["k", "v", "i"])
    pdf["r"] = pdf.groupby(pdf["k"].fillna("~"))["v"].rank(method="average")
    want = {(k, i): None if pd.isna(r) else r for k, i, r in zip(pdf["k"], pdf["i"], pdf["r"])}
    assert len(got) == len(rows)
    assert all(r["r"] == want[r["k"], r["i"]] for r in got)


@pytest.mark.parametrize("mode", ["day", "week", "month", "quarter"])
def test_periods_have_the_range_of_their_label(spark, mode):
    start = datetime(2019, 12, 20)
    days = [start + timedelta(hours=11 * i) for i in range(900)]
    frame = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz").select("ts", slice_label(F.col("ts"), mode).alias("s")).toPandas()
    for ts, label in zip(frame["ts"], frame["s"]):
        low, high = slice_bounds(ts.to_pydatetime(), mode)
        assert low <= ts < high
        inside = frame[(frame["ts"] >= low) & (frame["ts"] < high)]
        assert set(inside["s"]) == {label} and (frame["s"] == label).sum() == len(inside)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_end_slices_reach_the_scan(spark, tmp_path, kind):
    df = spark.range(4000).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"), (F.col("id") % 97).alias("x"))
    df.select(F.col("ts").cast(kind).alias("ts"), "x").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    roles = Roles(time="ts")
    pair, ends = drift.end_slices(table, roles)
    assert ends == ("2021-01", "2021-06") and pair.select(drift.SLICE).distinct().count() == 2
    plan = pair._jdf.queryExecution().executedPlan().toString()
    assert "Or(LessThan(ts" in plan.split("PushedFilters")[1].split("]")[0]
    whole = drift.drift_first_last(drift.with_slices(table, roles), ["x"]).collect()
    assert drift.drift_of_ends(table, roles, ["x"]).collect() == whole
    assert drift.drift_of_ends(table.limit(0), roles, ["x"]).count() == 0


def test_holdout_is_stratified(spark):
    rows = [(i, ("a", "b", None)[0 if i % 10 else 1 if i % 20 else 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string").repartition(4)
    train, test = labels.holdout(df, "y", [F.col("id")], 0.25)
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {"a": 225, "b": 12, None: 12}
    assert train.unionByName(test).select("id").distinct().count() == 1000
    again = labels.holdout(df.repartition(9), "y", [F.col("id")], 0.25)[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}


def test_fitted_categories(spark):
    rows = [("x", "p"), ("x", None), ("y", "q"), (None, "q"), (None, "r"), ("z", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    plan = {r["column"]: (r["mode"], r["pooled"], r["kept"]) for r in labels.category_plan(df, ["a", "b"]).collect()}
    assert plan == {"a": ("x", ["y", "z"], ["x"]), "b": ("q", ["p", "r"], ["q"])}
    got = labels.with_categories(df, {c: p[:2] for c, p in plan.items()}).collect()
    assert [r["a"] for r in got] == ["x", "x", labels.POOLED, "x", "x", labels.POOLED]


def test_planted_label_noise_ranks_on_top(spark):
    rows = [(i, float(i % 2) * 4 + (i * 37 % 100) / 100, "n" if i % 9 else None, str(i % 2 if i % 50 else 1 - i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    noise = labels.label_noise(df, "y", ["x", "c"], ["id"])
    top = labels.noise_candidates(noise, 12).collect()
    assert {r["id"] for r in top} == set(range(0, 600, 50))


def test_own_checks_share_the_scan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "b")], "x int, c string")
    checks = [audit.Check("quality", "mean of x", F.avg("x"), above=1.0, finding="x is large"), audit.Check("quality", "rows", F.count(F.lit(1)), below=1)]
    found = {r["check"]: (r["value"], r["finding"]) for r in audit.own_findings(audit.audit(df, Roles(), checks=checks)).collect()}
    assert found == {"mean of x": (1.5, "x is large"), "rows": (3.0, None)}


def test_correlation_with_a_constant_side_is_null(spark):
    from plumbline.operators import validity
    rows = [("flat", "m", 76.5, 0.1 * i) for i in range(4)] + [("line", "m", float(i), 2.0 * i) for i in range(4)] + [("some", "m", float(i * i), 2.0 * i) for i in range(4)]
    runs = spark.createDataFrame(rows, "dataset string, model string, score double, auc double")
    found = {r["dataset"]: r for r in validity.correlation(runs, ["dataset", "model"], "score", "auc").collect()}
    assert found["flat"]["pearson_r"] is None and found["flat"]["t_statistic"] is None and found["flat"]["n"] == 4
    assert found["line"]["pearson_r"] == 1.0 and abs(found["some"]["pearson_r"] - 0.9583148) < 1e-6
    mean = validity.fisher_mean(validity.correlation(runs, ["dataset", "model"], "score", "auc"), ["model"], "pearson_r")
    assert 0.99 < mean.first()["fisher_mean"] < 1.0
    assert validity.spearman(runs.filter("dataset = 'flat'"), ["model"], "score", "auc").first()["spearman_rho"] is None
