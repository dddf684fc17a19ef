"""End-to-end audits, scores, gate and history on small data with planted faults."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import faults, gate, labels, scoring, suggest
from plumbline.plans import audit
from plumbline.roles import Roles
from plumbline.sources import tables


@pytest.fixture(scope="module")
def leaky(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(80):
        day = datetime.date(2025, 1, 1) + datetime.timedelta(days=i)
        rows.append((f"s{i}", str(day), "train" if i % 4 else "test", "abc"[i % 3], float(rng.normal(50, 5)), float(rng.normal(100, 9)),
                     "call me" if i else "write to jo@example.com", i % 2))
    rows.append((*rows[1][:2], "test", *rows[1][3:]))
    return spark.createDataFrame(rows, "sample_id string, timestamp string, split string, site string, temp double, pressure double, note string, target int")


def test_leaky_table_is_flagged(spark, leaky):
    roles = Roles(label="target", split="split", time="timestamp", groups=("site",), ids=("sample_id",))
    metrics = audit.audit(leaky, roles, dataset="leaky")
    report = audit.report(metrics)
    row = report.first()
    assert row["verdict"] == "Needs review"
    assert any("PII" in f for f in row["findings"]) and any("leakage" in r.lower() for r in row["recommendations"])
    assert row["split_leakage"] > 0
    status = gate.gate(gate.gate_checks(report, presets=[gate.DEFAULT_POLICY])).first()["status"]
    assert status == "FAIL"


def test_clean_table_scores_full_points(spark):
    clean = spark.range(100).select(F.concat(F.lit("row"), "id").alias("sample_id"), (F.col("id") % 10).alias("a"),
                                    (F.col("id") % 7).alias("b"), F.lit("fine").alias("status"))
    row = audit.report(audit.audit(clean, Roles(ids=("sample_id",)), dataset="clean")).first()
    assert row["score"] == 100 and row["grade"] == "A"
    assert [row[f"{d}_points"] for d in scoring.DEFAULT_WEIGHTS] == [35.0, 25.0, 20.0, 10.0, 10.0]
    assert row["verdict"].startswith("Looks OK")


def _runs(spark, **values):
    row = {m: None for m in scoring.METRICS} | {"run_id": "r"} | values
    schema = "run_id string, " + ", ".join(f"{m} double" for m in scoring.METRICS)
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


def test_heavy_faults_score_below_25(spark):
    bad = _runs(spark, missingness=0.15, duplicate_rate=0.05, split_leakage=0.01, pii_flag_count=1.0, pii_worst_rate=0.2,
                max_drift_ks=0.6, p99_anomaly=30.0, mean_disparity_credit=0.0)
    row = scoring.health_score(bad).first()
    assert row["score"] < 25 and row["grade"] == "F"


def test_weights():
    assert scoring.normalised_weights({"quality": 0, "security": 0, "reliability": 0, "robustness": 0, "fairness": 0}) == scoring.normalised_weights()
    partial = scoring.normalised_weights({"quality": 70, "fairness": -1, "robustness": "x"})
    assert abs(sum(partial.values()) - 100) < 1e-9 and partial["fairness"] == partial["robustness"] == 0
    assert abs(sum(scoring.asset_budget({"quality": 1, "transparency": 10}).values()) - 100) < 1e-9


@pytest.mark.parametrize("values, policy, status", [
    (dict(missingness=0.0, duplicate_rate=0.0, score=95), "Balanced (default)", "PASS"),
    (dict(missingness=0.2, duplicate_rate=0.05, split_leakage=0.01, max_drift_ks=0.6, pii_flag_count=1.0, score=40), "Balanced (default)", "FAIL"),
    (dict(missingness=0.2, duplicate_rate=0.1, split_leakage=0.02, max_drift_ks=0.6, max_positive_rate_disparity=0.5, score=60), "Balanced (default)", "FAIL"),
    (dict(missingness=0.2, duplicate_rate=0.1, split_leakage=0.02, max_drift_ks=0.6, max_positive_rate_disparity=0.5, score=60), "Lenient development", "PASS"),
    (dict(pii_flag_count=3.0, score=80), "Exploratory research", "PASS"),
])
def test_gate_cases(spark, values, policy, status):
    score = values.pop("score")
    runs = _runs(spark, **values).withColumn("score", F.lit(score))
    checks = gate.gate_checks(runs, presets=[policy])
    assert gate.gate(checks).first()["status"] == status
    missing = {r["check"] for r in checks.collect() if r["status"] == "not_applicable"}
    assert ("Max drift KS" in missing) == ("max_drift_ks" not in values)


def test_history_round_trip_skips_corrupt_files(spark, tmp_path):
    runs = _runs(spark, missingness=0.1, duplicate_rate=0.05).unionByName(_runs(spark, missingness=0.02, duplicate_rate=0.0).withColumn("run_id", F.lit("s")))
    scored = scoring.health_score(runs).withColumns({
        "dataset_name": F.lit("d"), "analyzer": F.lit("tabular"), "file_sha256": F.lit("abc"), "verdict": F.lit("v"),
        "findings": F.array(F.lit("f")), "recommendations": F.array(F.lit("q"))})
    stamped = scored.withColumn("t", F.when(F.col("run_id") == "r", "2025-01-01 00:00:00").otherwise("2025-02-01 00:00:00"))
    path = str(tmp_path / "history")
    tables.write_records(gate.audit_records(stamped, F.col("t")), path)
    (tmp_path / "history" / "analyzer=tabular" / "broken.json").write_text("{not json")
    back = tables.read_records(spark, path)
    assert [r["run_id"] for r in back.collect()] == ["s", "r"]
    assert back.first()["metrics"]["missingness"] == 0.02
    wide = back.select("dataset_name", "run_id", "created_at_utc", *[F.col("metrics")[m].alias(m) for m in gate.COMPARED])
    changes = {r["metric"]: r["direction"] for r in gate.compare_consecutive(wide).collect()}
    assert changes["Missingness"] == changes["Duplicate rate"] == "improved" and changes["Max drift KS"] == "not_applicable"


def test_readers(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double")
    frame.write.parquet(str(tmp_path / "t.parquet"))
    tables.write_csv(frame, str(tmp_path / "t.csv"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).filter("b is null").count() == 1
    assert tables.read_table(spark, str(tmp_path / "t.csv")).filter("b is null").count() == 1
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.xlsx"))


def test_flipped_labels_are_found(spark):
    rng = np.random.default_rng(12)
    flips = {4, 11, 23, 92, 107, 135}
    rows = []
    for i in range(160):
        side = i >= 80
        centre = 3.0 if side else -3.0
        shown = side != (i in flips)
        rows.append((i, float(rng.normal(centre, 0.45)), float(rng.normal(centre, 0.45)), "b" if shown else "a", float(i)))
    df = spark.createDataFrame(rows, "id int, x double, y double, label string, unused double")
    noise = labels.label_noise(df, "label", ["x", "y"], ["id"])
    found = {r["id"] for r in labels.noise_candidates(noise).collect()}
    assert len(found & flips) >= 5
    summary = labels.noise_summary(noise).first()
    assert summary["evaluated_rows"] == 160 and summary["out_of_fold_accuracy"] > 0.9 and summary["suspected_label_noise_rate"] >= 0.03


def test_many_label_values_are_skipped(spark):
    df = spark.range(60).select("id", F.concat(F.lit("c"), "id").alias("label"))
    assert labels.label_noise(df, "label", ["id"]).scored is None


def test_roles_are_suggested(spark, leaky):
    roles = suggest.suggest_roles(leaky)
    assert (roles.split, roles.time, roles.label) == ("split", "timestamp", "target")
    assert "site" in roles.groups
    assert suggest.suggest_roles(leaky, label="site").label == "site"


def test_injected_severity_is_recovered(spark):
    base = faults.sensor_table(spark, 4000, 7)
    assert base.count() == 4000 and base.select("split").distinct().count() == 3
    keyed = base.select("sample_id", "timestamp", "split", "sensor_temp", "operator_note", "target")
    draw = faults.keyed_draw(3, "sample_id")
    holes = faults.missingness(keyed, ["sensor_temp"], 0.2, draw).filter("sensor_temp is null").count()
    assert abs(holes / 4000 - 0.2) < 0.03
    more = faults.missingness(keyed, ["sensor_temp"], 0.3, draw).filter("sensor_temp is null").select("sample_id")
    less = faults.missingness(keyed, ["sensor_temp"], 0.1, draw).filter("sensor_temp is null").select("sample_id")
    assert less.join(more, "sample_id", "left_anti").count() == 0
    copies = faults.duplicates(keyed, 0.1, draw).count() - 4000
    assert abs(copies / 4000 - 0.1) < 0.02
    hits = faults.personal_data(keyed, "operator_note", "sample_id", 0.05, draw).filter("operator_note like '%@%'").count()
    assert abs(hits / 4000 - 0.05) < 0.02
    again = faults.repeated_duplicates(keyed, 0.5, draw).count() - 4000
    assert abs(again / 4000 - 0.5) < 0.06


def test_scenarios_with_like_rows_are_measured_once(spark, tmp_path):
    """Every scenario gets the metrics it gets when it is measured by itself, with repeated, null and conflicting keys."""
    import datetime
    from pyspark.sql import functions as F
    from plumbline.plans import grid, scenarios
    day = datetime.datetime(1995, 1, 1)
    rows = [(None if i % 17 == 0 else i // 2 % 90, i % 11, None if i % 13 == 0 else float(i % 9) * 1000, day + datetime.timedelta(days=i % 50),
             None if i % 19 == 0 else ("1-URGENT", "5-LOW")[i % 2]) for i in range(240)]
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows + rows[:20], schema).write.parquet(f"{tmp_path}/orders.parquet")
    late = F.when(F.dayofyear("o_orderdate") < 15, 0).when(F.dayofyear("o_orderdate") > 35, 1)
    kinds, severities, seeds = grid.FAULTS, (0.0, 0.4), (7, 11)
    clean = grid.clean_orders(spark, str(tmp_path))
    tagged = grid.corrupt(grid.scenarios(clean, kinds, severities, seeds), 788900000.0).drop("fault", "severity", "seed")
    measure = [tagged, "run_id", late, "split", ["o_totalprice", "o_custkey"], ["o_orderpriority", "note"], ["o_orderpriority"], "target"]
    alone, shared = scenarios.run_metrics(*measure), scenarios.run_metrics(*measure, twin=grid.twin(kinds, seeds))
    columns = sorted(alone.columns)
    got = [sorted(map(str, f.select("run_id", *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(f.dtypes) if c != "run_id"]).collect()))
           for f in (alone, shared)]
    assert sorted(shared.columns) == columns and len(got[0]) == 24
    assert got[0] == got[1]


def test_grid_counts_alike_rows_like_all_rows(spark, tmp_path):
    """The grid's metrics, counted from rows that scenarios hit alike, are those of the multiplied rows: keys repeat, are null, negative or alone."""
    import datetime
    from pyspark.sql import functions as F
    from plumbline.plans import grid, scenarios
    day = datetime.datetime(1995, 1, 1)
    rows = [(None if i % 23 == 0 else (i if i % 2 else i // 4 % 40) * 37 - 900, None if i % 29 == 0 else i % 11, (None, float("nan"))[i % 2] if i % 13 == 0 else float(i % 9) * 1000,
             None if i % 31 == 0 else day + datetime.timedelta(days=i % 50), None if i % 19 == 0 else ("1-URGENT", "5-LOW", "to a@b.com")[i % 3]) for i in range(300)]
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows + rows[:40], schema).write.parquet(f"{tmp_path}/orders.parquet")
    late = F.when(F.dayofyear("o_orderdate") < 15, 0).when(F.dayofyear("o_orderdate") > 35, 1)
    for kinds, severities, seeds in [(grid.FAULTS, (0.0, 0.4), (7,)), (("pii", "drift", "split_leakage"), (0.2,), (7, 11))]:
        clean = grid.clean_orders(spark, str(tmp_path))
        tagged = grid.corrupt(grid.scenarios(clean, kinds, severities, seeds), 788900000.0).drop("fault", "severity", "seed")
        alone = scenarios.run_metrics(tagged, "run_id", late, "split", ["o_totalprice", "o_custkey"], ["o_orderpriority", "note"], ["o_orderpriority"], "target")
        counted = grid.grid_metrics(clean, late, 788900000.0, kinds, severities, seeds)
        got = [sorted(map(str, f.select("run_id", *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(alone.dtypes) if c != "run_id"]).collect()))
               for f in (alone, counted)]
        assert got[0] == got[1] and len(got[0]) == len(kinds) * len(severities) * len(seeds) and sorted(counted.columns) == sorted(alone.columns)


def test_quantiles_near_their_rank(spark):
    """Brackets give the quantiles that sorting everything gives, with ties, nulls and runs of one value; a null run has none."""
    import random
    from pyspark.sql import functions as F
    from plumbline.operators.distribution import melt, near_rank_quantiles, quantiles, value_counts
    draw = random.Random(3)
    rows = [(draw.choice("abc"), float(draw.choice([draw.randrange(9), draw.random() * 1e4])), draw.choice([None, draw.gauss(0, 1)])) for _ in range(30000)]
    rows += [("one", 4.0, None), ("void", None, None)]
    frame = spark.createDataFrame(rows, "run string, x double, y double").repartition(5)
    for accuracy in (500, 20):
        for p in (0.0, 0.5, 0.99, 1.0):
            got = near_rank_quantiles(frame, "run", {"x": p, "y": p}, accuracy)
            want = quantiles(value_counts(melt(frame, ["x", "y"], ["run"]), ["run", "column"]), ["run", "column"], {"q": p})
            wide = want.groupBy("run").agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in ("x", "y")])
            known = sorted(map(str, got.filter("x is not null or y is not null").select("run", "x", "y").collect()))
            assert known == sorted(map(str, wide.select("run", "x", "y").collect())) and len(known) == 4


def test_numbers_of_scenarios_are_not_multiplied(spark, tmp_path, monkeypatch):
    """Order statistics of runs that weigh, blank and shift rows equal those of multiplied rows, and no row of the table is multiplied for them."""
    import numpy as np
    from pyspark.sql import functions as F
    from plumbline.operators import weighted_runs
    from plumbline.plans import grid
    rng = np.random.default_rng(3)
    cell, late, side = rng.integers(0, 6, 900), rng.random(900) < 0.3, rng.integers(-1, 2, 900)
    numbers = np.round(rng.normal(size=(2, 900)) * 5, 0)
    numbers[0, ::11] = np.nan
    runs = weighted_runs.Runs(rng.integers(0, 3, (6, 4)), rng.random((2, 6, 4)) < 0.8, np.array([[0.0, 0.0, 2.5, 0.0], [0.0, 0.0, -1.0, 0.0]]))
    rows = spark.createDataFrame([(int(c), bool(a), int(s), None if np.isnan(x) else float(x), float(y)) for c, a, s, x, y in zip(cell, late, side, *numbers)],
                                 "cell int, late boolean, side int, x double, y double").repartition(5)
    monkeypatch.setattr(weighted_runs, "CHUNK", 64)
    ks, p99 = weighted_runs.largest_ks(rows, runs), weighted_runs.anomaly_p99(rows, runs)
    for r in range(4):
        times = runs.copies[cell, r]
        views = [np.repeat(np.where(runs.kept[c, cell, r], numbers[c] + np.where(late, runs.shifts[c, r], 0), np.nan), times) for c in (0, 1)]
        sides, gap = np.repeat(side, times), []
        for v in views:
            a, b = (np.sort(v[(sides == s) & ~np.isnan(v)]) for s in (0, 1))
            at = np.unique(np.concatenate((a, b)))
            gap.append(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())
        far = [np.abs(v - np.nanmedian(v)) / np.nanmedian(np.abs(v - np.nanmedian(v))) for v in views]
        known = ~np.isnan(far).all(axis=0)
        assert abs(ks[r] - max(gap)) < 1e-12
        assert abs(p99[r] - np.quantile(np.nanmean(np.array(far)[:, known], axis=0), 0.99)) < 1e-9

    multiplied = []
    real = grid.scenarios_of
    monkeypatch.setattr(grid, "scenarios_of", lambda df, chosen: multiplied.append(df.count()) or real(df, chosen))
    (spark.range(20000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), (F.col("id") % 701).cast("double").alias("o_totalprice"),
                               F.lit("1995-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"))
     .write.parquet(f"{tmp_path}/orders.parquet"))
    grid.grid_metrics(grid.clean_orders(spark, str(tmp_path)), F.lit(0), 788900000.0, ("drift",), (0.0, 0.4), (7,))
    assert max(multiplied) < 10000
