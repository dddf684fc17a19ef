"""Queries on full audits, scores, verdicts, policy gate, history and evidence."""

from pyspark.sql import functions as F

from plumbline.functions.columns import PII_PATTERNS
from plumbline.operators import evidence, gate, scoring
from plumbline.plans import audit
from plumbline.plans.catalogue_drift import _ks_sql
from plumbline.plans.registry import query
from plumbline.plans.scenarios import metric_rows, run_metrics
from plumbline.roles import Roles
from plumbline.sources import fixtures as fx
from plumbline.sources.tables import materialized, written

ORDER_ROLES = Roles(label="big", split="split", time="o_orderdate", groups=("o_orderpriority", "o_orderstatus"), ids=("o_orderkey",))
_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "split", "big", "note"]
_TEXT = ["o_orderstatus", "o_orderpriority", "note"]


def _mark_sql(columns, source: str) -> str:
    """Fingerprint and encoded size of a table: sums of the 32-bit words of each row's digest."""
    cells = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    words = ", ',', ".join(f"CAST(coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT), 0) AS VARCHAR)" for i in range(8))
    return (f"mark AS (SELECT CAST(sum(b) AS BIGINT) AS encoded_bytes, sha256(concat({words})) AS fingerprint FROM (SELECT sha256(e) AS h, strlen(e) AS b FROM (SELECT {cells} AS e FROM {source})))")


def _audit_sql(prelude: str, src: str, columns, numbers, texts, label: str, kind: str, slice_sql: str | None = None, split: str | None = None, groups=(), ids=(), entities=None,
               time: str | None = None) -> str:
    """The metric table of an audit of a CTE as ``am``: the SQL twin of ``audit.audit``."""
    med = ", ".join(f"median({c}) AS m_{c}" for c in numbers)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in numbers)
    parts = " + ".join(f"coalesce(CASE WHEN d_{c} > 0 THEN abs({c} - m_{c}) / d_{c} END, 0)" for c in numbers)
    used = " + ".join(f"(d_{c} > 0 AND {c} IS NOT NULL)::INT" for c in numbers)
    rows, n, order = [], len(columns), f"max({label}) AS hi, count(DISTINCT {label}) AS k"

    def add(dimension, check, key, value, source, subject="''", text="NULL"):
        rows.append(f"SELECT '{dimension}', '{check}', {subject}, '{key}', CAST({value} AS DOUBLE), {text} FROM {source}")

    add("reliability", "schema_consistency", "num_rows", "count(*)", src)
    add("reliability", "schema_consistency", "num_cols", str(n), "(SELECT 1)")
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    add("quality", "missingness", "overall_missing_rate", f"({missing}) / (count(*) * {n}.0)", src)
    for c in columns:
        add("quality", "missingness", "missing_rate", f"1 - count({c}) / count(*)", src, f"'{c}'")
        rows.append(f"SELECT * FROM (SELECT 'reliability', 'schema_consistency', '{c}', 'constant_column', 1.0, NULL FROM {src} HAVING count(DISTINCT {c}) + (count({c}) < count(*))::INT <= 1)")
    add("quality", "label_stats", "label_missing_rate", f"1 - count({label}) / count(*)", src)
    for c in texts:
        for p, r in PII_PATTERNS.items():
            rows.append(f"SELECT * FROM (SELECT 'security', 'confidentiality_pii_heuristics', '{c}', 'hit_rate', avg(regexp_matches({c}, '{r}')::INT) AS v, '{p}' FROM {src}) WHERE v >= 0.01")
    flags = " + ".join("(SELECT coalesce(max(v >= 0.01)::INT, 0) FROM (" + " UNION ALL ".join(
        f"SELECT avg(regexp_matches({c}, '{r}')::INT) AS v FROM {src}" for r in PII_PATTERNS.values()) + "))" for c in texts) or "0"
    add("security", "confidentiality_pii_heuristics", "columns_with_hits", flags, "(SELECT 1)")
    for c in numbers:
        rows.append(f"SELECT 'quality', 'outliers_iqr', '{c}', 'outlier_rate', avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT * (q3 <> q1)::INT), NULL "
                    f"FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})")
    if slice_sql:
        add("reliability", "numeric_drift_ks_first_last", "top_10_ks", "ks", "d", '"column"')
        add("reliability", "missing_rate_by_slice", "missing_rate", f"({missing}) / (count(*) * {n}.0)", f"{src} GROUP BY {slice_sql}", slice_sql)
    for k, e in (("mean", "avg(score)"), ("p95", "quantile_cont(score, 0.95)"), ("p99", "quantile_cont(score, 0.99)"), ("max", "max(score)")):
        add("robustness", "row_anomaly_score_mad", k, e, "sc")
    add("quality", "duplicates", "exact_duplicate_row_rate", f"1 - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {src})) / count(*)", src)
    if split:
        add("quality", "split_leakage", "row_hash_cross_split_rate", "avg((k > 1)::INT)", f"(SELECT count(DISTINCT {split}) AS k FROM {src} GROUP BY {', '.join(c for c in columns if c != split)})")
    if ids:
        add("quality", "duplicates", "duplicate_id_rate", f"1 - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ids)} FROM {src})) / count(*)", src)
    add("quality", "label_stats", "class_share", "n / t", f"(SELECT {label} AS l, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM {src} WHERE {label} IS NOT NULL GROUP BY 1 "
        f"QUALIFY k BETWEEN 2 AND 50 ORDER BY n DESC, CAST(l AS VARCHAR) LIMIT 10)", "CAST(l AS VARCHAR)")
    add("quality", "label_stats", "label_cardinality", f"count(DISTINCT {label})", src, text=f"'{kind}'")
    if texts:
        add("robustness", "rare_category_label_concentration", "num_findings", "count(*)",
            "(SELECT c FROM (SELECT c, v, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY c, v) AS t, sum(count(*)) FILTER (l IS NOT NULL) OVER (PARTITION BY c, v) AS known FROM ("
            + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, {label} AS l FROM {src} WHERE {c} IS NOT NULL" for c in texts)
            + f") GROUP BY c, v, l) WHERE l IS NOT NULL AND t >= 5 AND t <= greatest(5, floor((SELECT count(*) FROM {src}) * 0.001)) AND n / known >= 0.95)")
    for g in groups:
        share = f"(SELECT count(*) / (SELECT count(*) FROM {src}) AS s FROM {src} GROUP BY {g})"
        for k, e in (("num_groups", "count(*)"), ("min_group_share", "min(s)"), ("max_group_share", "max(s)")):
            add("fairness", "group_checks", k, e, share, f"'{g}'")
        gaps = "greatest(" + ", ".join(f"max(m_{c}) - min(m_{c})" for c in columns) + ")"
        add("fairness", "group_checks", "max_missingness_disparity", gaps, "(SELECT " + ", ".join(
            f"1 - count({c}) / count(*) AS m_{c}" for c in columns) + f" FROM {src} GROUP BY {g} HAVING true) HAVING count(*) >= 2", f"'{g}'")
        add("fairness", "group_checks", "positive_rate_disparity", "max(p) - min(p)",
            f"(SELECT avg(({label} = hi)::INT) AS p FROM {src}, (SELECT {order} FROM {src}) WHERE k = 2 AND {label} IS NOT NULL AND {g} IS NOT NULL GROUP BY {g}) HAVING count(*) >= 2", f"'{g}'")
    steps = ""
    if time:
        who = ", ".join(entities)
        axis = "time_axis_health"
        add("quality", axis, "time_parse.parse_ok_rate", f"count({time}) / count(*)", src)
        add("quality", axis, "time_range.span_days", f"(epoch_us(max({time})) - epoch_us(min({time}))) / 86400000000.0", src)
        add("quality", axis, "duplicate_timestamps.duplicate_rate", "sum(n - 1) / sum(n)", f"(SELECT count(*) AS n FROM {src} WHERE {time} IS NOT NULL GROUP BY {who}, {time})")
        pace = "CASE WHEN count(*) >= 50 THEN {} END".format
        add("quality", axis, "cadence_global.irregularity_ratio", pace("(quantile_cont(step, 0.9) - quantile_cont(step, 0.1)) / greatest(1e-9, quantile_cont(step, 0.5))"), "st WHERE step > 0")
        add("quality", axis, "cadence_global.median_step_seconds", pace("quantile_cont(step, 0.5)"), "st WHERE step > 0")
        add("quality", axis, "gaps_global.large_gap_rate", "avg((step > 10 * med)::INT)", "st, (SELECT quantile_cont(step, 0.5) AS med FROM st)")
        add("quality", axis, "gaps_global.largest_gap_seconds", "max(step)", "st")
        steps = (f", st AS (SELECT step FROM (SELECT (epoch_us({time}) - epoch_us(lag({time}) OVER (ORDER BY {who}, {time}))) / 1e6 AS step FROM {src} WHERE {time} IS NOT NULL) WHERE step IS NOT NULL)")
    rows.append("SELECT 'security', 'integrity', '', 'sha256', NULL, fingerprint FROM mark")
    rows.append("SELECT 'security', 'availability_asset_checks', '', 'byte_size', CAST(encoded_bytes AS DOUBLE), NULL FROM mark")
    drifted = ", " + _ks_sql(numbers, src, slice_sql) if slice_sql else ""
    return ("WITH " + prelude + ", " + _mark_sql(columns, src) + drifted + steps
            + f", md AS (SELECT {med} FROM {src}), mm AS (SELECT {mad} FROM {src}, md), sc AS (SELECT CASE WHEN ({used}) > 0 THEN ({parts}) / ({used}) END AS score FROM {src}, md, mm), "
            + 'am0(dimension, "check", subject, "key", value, "text") AS (' + " UNION ALL ".join(rows) + '), am AS (SELECT * FROM am0 WHERE value IS NOT NULL OR "text" IS NOT NULL)')


_AUDIT = _audit_sql(fx.AUDITED_SQL, "audited", _ALL, _NUM, _TEXT, "big", "Binary classification", "strftime(o_orderdate, '%Y-%m')", "split", ORDER_ROLES.groups, ORDER_ROLES.ids)
_SHOWN = """ SELECT '{0}' AS run_id, '{0}' AS dataset, dimension, "check", subject, "key", round(value, 6) AS value, "text" FROM am""".format
_WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')"
_SERIES_AUDIT = _audit_sql(fx.EVENT_SQL, "ev", ["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_id", "user_id", "value"], ["props"], "event_type",
                           "Multi-class classification", _WEEK, ids=["event_id"], entities=["user_id"], time="ts")
_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "split"]
_DOC_AUDIT = _audit_sql(fx.DOC_SQL, "doc", _DOC_COLUMNS, ["doc_id", "n_chars", "toxic"], ["text", "lang", "source"], "quality", "Binary classification", "split", "split",
                        ["lang", "source"], ["doc_id"])


def _orders_audit(spark, sf, **options):
    return audit.audit(fx.audited_orders(spark, sf), ORDER_ROLES, dataset="orders", **options)


def _orders_metrics(spark, sf):
    """The metric table of the full audit as reports read it: written once, then scanned."""
    return materialized(spark, f"audit:{sf}", lambda: _orders_audit(spark, sf), (fx.table(spark, sf, "orders"),))


def _shown(metrics):
    """Metric rows that say something: a check that found nothing to measure has neither value nor text."""
    return metrics.filter("value is not null or text is not null")


@query(_AUDIT + _SHOWN("orders"))
def full_audit(spark, sf):
    return _shown(_orders_audit(spark, sf))


@query("WITH " + fx.AUDITED_SQL + """, o AS (SELECT avg((o_totalprice > 0)::INT) AS a, avg((length(note) > 2)::INT) AS b, count(*) FILTER (o_orderdate IS NULL) AS c FROM audited)
SELECT 'orders' AS run_id, 'quality' AS dimension, 'positive prices' AS "check", round(a, 6) AS value, CASE WHEN a < 0.99 THEN 'Prices are missing or not positive' END AS finding FROM o
UNION ALL SELECT 'orders', 'security', 'long notes', round(b, 6), CASE WHEN b > 0.02 THEN 'Many notes hold free text' END FROM o
UNION ALL SELECT 'orders', 'reliability', 'orders without date', c, NULL FROM o""")
def audit_own_checks(spark, sf):
    """Checks of the user's own in the full audit's shared scan."""
    checks = [audit.Check("quality", "positive prices", F.avg((F.col("o_totalprice") > 0).cast("double")), below=0.99, finding="Prices are missing or not positive"),
              audit.Check("security", "long notes", F.avg((F.length("note") > 2).cast("double")), above=0.02, finding="Many notes hold free text"),
              audit.Check("reliability", "orders without date", F.count_if(F.col("o_orderdate").isNull()), above=0)]
    return audit.own_findings(_orders_audit(spark, sf, fingerprint=False, checks=checks))


@query(_SERIES_AUDIT + _SHOWN("events"))
def series_audit(spark, sf):
    """Time-series audit of the event stream table."""
    roles = Roles(label="event_type", time="ts", entities=("user_id",), ids=("event_id",), slice_mode="week")
    return _shown(audit.audit(fx.event_series(spark, sf), roles, dataset="events", kind="series"))


@query(_DOC_AUDIT + _SHOWN("documents"))
def document_audit(spark, sf):
    """Audit of labelled documents, whole texts scanned for personal data."""
    roles = Roles(label="quality", split="split", groups=("lang", "source"), ids=("doc_id",))
    return _shown(audit.audit(fx.doc_labels(spark, sf), roles, dataset="documents"))


# Monthly runs: every month of orders is one data set of the audit history.

def monthly_runs(spark, sf):
    """The history table: audited once per application, kept in the shared folder."""
    return materialized(spark, f"monthly:{sf}", lambda: _audit_months(spark, sf), (fx.table(spark, sf, "orders"),))


def _audit_months(spark, sf):
    # rows are read by every metric: with their month they are written once
    orders = written(fx.audited_orders(spark, sf).withColumn("run_id", F.date_format("o_orderdate", "yyyy-MM")))
    late = F.when(F.col("split") == "train", 0).when(F.col("split") != "train", 1)
    runs = run_metrics(orders, "run_id", late, "split", ["o_totalprice", "o_custkey"], ["o_orderpriority", "note"],
                       ["o_orderstatus"], "big")
    return runs.withColumns({"dataset_name": F.substring("run_id", 1, 4), "created_at_utc": F.col("run_id"),
                             "analyzer": F.lit("tabular")})


def runs_sql(source: str, run: str, late: str, numeric, texts, groups, label: str, features, contents) -> str:
    """Wide headline metrics per run of a CTE; the SQL twin of ``run_metrics``."""
    miss = " + ".join(f"(count(*) - count({c}))" for c in features)
    ks = " UNION ALL ".join(f"SELECT {run}, '{c}' AS c, CAST({c} AS DOUBLE) AS v, {late} AS late FROM {source} WHERE {c} IS NOT NULL AND {late} IS NOT NULL" for c in numeric)
    hits = " UNION ALL ".join(f"SELECT {run}, '{c}' AS c, avg(regexp_matches({c}, '{r}')::INT) AS v FROM {source} GROUP BY 1" for c in texts for r in PII_PATTERNS.values())
    fair = " UNION ALL ".join(
        f"SELECT {run}, max(p) - min(p) AS gap FROM (SELECT {run}, avg(y) AS p FROM (SELECT *, CASE WHEN {label} = max({label}) OVER (PARTITION BY {run}) THEN 1 ELSE 0 END AS y, "
        f"max({label}) OVER (PARTITION BY {run}) <> min({label}) OVER (PARTITION BY {run}) AS two FROM {source} WHERE {label} IS NOT NULL) WHERE two AND {g} IS NOT NULL GROUP BY {run}, {g}) GROUP BY 1 HAVING count(*) >= 2" for g in groups)
    med = ", ".join(f"median({c}) AS m_{c}" for c in numeric)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in numeric)
    parts = " + ".join(f"coalesce(CASE WHEN d_{c} > 0 THEN abs({c} - m_{c}) / d_{c} END, 0)" for c in numeric)
    used = " + ".join(f"coalesce((d_{c} > 0 AND {c} IS NOT NULL)::INT, 0)" for c in numeric)
    return f"""r_m AS (SELECT {run}, ({miss}) / (count(*) * {len(features)}.0) AS missingness, count(*) AS n_rows FROM {source} GROUP BY 1),
r_p AS (SELECT {run}, {contents}, count(DISTINCT split) AS k, count(*) AS n, count(DISTINCT coalesce(split, '')) AS pairs FROM {source} GROUP BY {run}, {contents}),
r_c AS (SELECT {run}, (sum(n) - sum(pairs)) / sum(n) AS duplicate_rate, avg((k > 1)::INT) AS split_leakage FROM r_p GROUP BY 1),
r_h AS (SELECT {run}, CAST(count(DISTINCT c) AS DOUBLE) AS pii_flag_count, max(v) AS pii_worst_rate FROM ({hits}) WHERE v >= 0.01 GROUP BY 1),
r_l AS ({ks}), r_v AS (SELECT {run}, c, v, count(*) FILTER (late = 0) AS na, count(*) FILTER (late = 1) AS nb FROM r_l GROUP BY ALL),
r_w AS (SELECT {run}, c, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER p AS ta, sum(nb) OVER p AS tb FROM r_v WINDOW w AS (PARTITION BY {run}, c ORDER BY v), p AS (PARTITION BY {run}, c)),
r_k AS (SELECT {run}, max(CASE WHEN ta >= 20 AND tb >= 20 THEN abs(ca / ta - cb / tb) END) AS max_drift_ks FROM r_w GROUP BY 1),
r_g AS ({fair}), r_f AS (SELECT {run}, max(gap) AS max_positive_rate_disparity, avg(CASE WHEN gap <= 0.2 THEN 1 ELSE greatest(0, 1 - (gap - 0.2) / 0.3) END) AS mean_disparity_credit FROM r_g GROUP BY 1),
r_md AS (SELECT {run}, {med} FROM {source} GROUP BY 1), r_mm AS (SELECT {run}, {mad} FROM {source} JOIN r_md USING ({run}) GROUP BY 1),
r_sc AS (SELECT {run}, CASE WHEN ({used}) > 0 THEN ({parts}) / ({used}) END AS score FROM {source} JOIN r_md USING ({run}) JOIN r_mm USING ({run})),
r_a AS (SELECT {run}, quantile_cont(score, 0.99) AS p99_anomaly FROM r_sc GROUP BY 1),
runs AS (SELECT {run} AS run_id, n_rows, missingness, duplicate_rate, split_leakage, coalesce(pii_flag_count, 0) AS pii_flag_count, pii_worst_rate, max_drift_ks, p99_anomaly,
  max_positive_rate_disparity, mean_disparity_credit FROM r_m JOIN r_c USING ({run}) LEFT JOIN r_h USING ({run}) LEFT JOIN r_k USING ({run}) LEFT JOIN r_f USING ({run}) LEFT JOIN r_a USING ({run}))"""


SCORE_SQL = """scored0 AS (SELECT *,
  35.0 * ((CASE WHEN missingness <= 0.05 THEN 1 ELSE greatest(0, 1 - (missingness - 0.05) / 0.15) END)
    + (CASE WHEN duplicate_rate <= 0.01 THEN 1 ELSE greatest(0, 1 - (duplicate_rate - 0.01) / 0.09) END) + (CASE WHEN split_leakage > 0 THEN 0 ELSE 1 END)) / 3 AS quality_points,
  25.0 * greatest(0, 1 - coalesce(pii_worst_rate, 0) / 0.05) AS security_points,
  20.0 * (CASE WHEN max_drift_ks IS NULL OR max_drift_ks <= 0.3 THEN 1 ELSE greatest(0, 1 - (max_drift_ks - 0.3) / 0.3) END) AS reliability_points,
  10.0 * (CASE WHEN p99_anomaly IS NULL OR p99_anomaly <= 10 THEN 1 ELSE greatest(0, 1 - (p99_anomaly - 10) / 10) END) AS robustness_points,
  10.0 * coalesce(mean_disparity_credit, 1) AS fairness_points FROM runs),
scored AS (SELECT *, CAST(round_even(least(100, greatest(0, round(quality_points + security_points + reliability_points + robustness_points + fairness_points, 9))), 0) AS BIGINT) AS score FROM scored0),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored)"""

_CONTENTS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_RUNS = ("WITH " + fx.AUDITED_SQL + ", mo AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS rid FROM audited), " + runs_sql(
    "mo", "rid", "(CASE WHEN split = 'train' THEN 0 ELSE 1 END)", ["o_totalprice", "o_custkey"], ["o_orderpriority", "note"],
    ["o_orderstatus"], "big", _ALL, _CONTENTS) + ", " + SCORE_SQL)
_POINTS = ["quality_points", "security_points", "reliability_points", "robustness_points", "fairness_points"]


@query(_RUNS + " SELECT run_id, n_rows, round(missingness, 6) AS missingness, round(duplicate_rate, 6) AS duplicate_rate, round(split_leakage, 6) AS split_leakage, pii_flag_count, "
       "round(pii_worst_rate, 6) AS pii_worst_rate, round(max_drift_ks, 6) AS max_drift_ks, round(p99_anomaly, 6) AS p99_anomaly, "
       "round(max_positive_rate_disparity, 6) AS max_positive_rate_disparity FROM runs")
def monthly_metrics(spark, sf):
    return monthly_runs(spark, sf).select(
        "run_id", "n_rows", "missingness", "duplicate_rate", "split_leakage", "pii_flag_count", "pii_worst_rate",
        "max_drift_ks", "p99_anomaly", "max_positive_rate_disparity")


@query(_RUNS + " SELECT run_id, " + ", ".join(f"round({p}, 6) AS {p}" for p in _POINTS) + ", score, grade FROM graded")
def health_score(spark, sf):
    return scoring.health_score(monthly_runs(spark, sf)).select("run_id", *_POINTS, "score", "grade")


@query(_RUNS + """, wgt AS (SELECT run_id, round_even(least(100, round((quality_points / 35 * 50 + security_points / 25 * 25 + reliability_points) / 105 * 100
  + 0 * robustness_points + fairness_points / 105 * 100, 9)), 0) AS s FROM graded) SELECT run_id, CAST(s AS BIGINT) AS score FROM wgt""")
def health_score_custom_weights(spark, sf):
    return scoring.health_score(monthly_runs(spark, sf), weights={"quality": 50, "robustness": -3, "other": 7}).select("run_id", "score")


@query(_RUNS + """ SELECT run_id, u.d AS dimension, u.s AS status FROM (SELECT run_id, unnest([
  {'d': 'Quality', 's': CASE WHEN split_leakage > 0 OR duplicate_rate > 0.05 OR missingness > 0.15 THEN 'bad' WHEN missingness > 0.05 OR duplicate_rate > 0.01 THEN 'warn' ELSE 'ok' END},
  {'d': 'Reliability', 's': CASE WHEN max_drift_ks > 0.3 THEN 'warn' ELSE 'ok' END},
  {'d': 'Robustness', 's': CASE WHEN p99_anomaly > 10 THEN 'warn' ELSE 'ok' END},
  {'d': 'Fairness', 's': CASE WHEN max_positive_rate_disparity > 0.2 THEN 'warn' ELSE 'ok' END},
  {'d': 'Security', 's': CASE WHEN pii_flag_count > 0 THEN 'bad' ELSE 'ok' END}]) AS u FROM graded)""")
def dimension_status(spark, sf):
    return scoring.dimension_status(monthly_runs(spark, sf))


_RULE_SQL = (("missingness > 0.05", 0), ("duplicate_rate > 0.01", 1), ("pii_flag_count > 0", 2), ("split_leakage > 0", 3),
             ("max_drift_ks > 0.3", 4), ("max_positive_rate_disparity > 0.2", 5))
_REVIEW = ", rv0 AS (SELECT *, concat_ws('; ', " + ", ".join(
    f"CASE WHEN {c} THEN '{scoring.TABULAR_RULES[i][3]}' END" for c, i in _RULE_SQL) + ") AS f, concat_ws('; ', " + ", ".join(
    f"CASE WHEN {c} THEN '{scoring.TABULAR_RULES[i][4]}' END" for c, i in _RULE_SQL) + ") AS r FROM graded), rv AS (SELECT *, CASE WHEN f <> '' THEN 'Needs review' ELSE 'Looks OK (evidence-based)' END AS verdict, " \
    f"CASE WHEN f <> '' THEN f ELSE '{scoring.CLEAN_FINDING}' END AS findings, CASE WHEN r <> '' THEN r ELSE '{scoring.CLEAN_RECOMMENDATION}' END AS recommendations FROM rv0)"


@query(_RUNS + _REVIEW + " SELECT run_id, verdict, findings, recommendations FROM rv")
def verdict_and_recommendations(spark, sf):
    reviewed = scoring.review(metric_rows(monthly_runs(spark, sf)))
    return reviewed.select("run_id", "verdict", F.array_join("findings", "; ").alias("findings"),
                           F.array_join("recommendations", "; ").alias("recommendations"))


def _gate_sql() -> str:
    rows = []
    for name, p in gate.POLICIES.items():
        checks = [("score", p["min_health_score"], "<")] + [(m, p[k], ">") for _, m, k in gate._LIMITS]
        if not p["allow_pii"]:
            checks.append(("pii_flag_count", 0, ">"))
        failed = " + ".join(f"coalesce(({m} {op} {v})::INT, 0)" for m, v, op in checks)
        rows.append(f"SELECT run_id, '{name}' AS policy, CASE WHEN {failed} > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST({failed} AS BIGINT) AS violations FROM graded")
    return " UNION ALL ".join(rows)


@query(_RUNS + " " + _gate_sql())
def policy_gate(spark, sf):
    return gate.gate(gate.gate_checks(scoring.health_score(monthly_runs(spark, sf))))


@query(_RUNS + """, c AS (SELECT run_id, unnest([{'n': 'Health score', 'v': CAST(score AS DOUBLE), 'ok': score >= 65}, {'n': 'Missingness', 'v': missingness, 'ok': missingness <= 0.02},
  {'n': 'Duplicate rate', 'v': duplicate_rate, 'ok': duplicate_rate <= 0.08}, {'n': 'Split leakage', 'v': split_leakage, 'ok': split_leakage <= 0.01}, {'n': 'Max drift KS', 'v': max_drift_ks, 'ok': max_drift_ks <= 0.5},
  {'n': 'Positive-rate disparity', 'v': max_positive_rate_disparity, 'ok': max_positive_rate_disparity <= 0.4}, {'n': 'PII flags', 'v': pii_flag_count, 'ok': pii_flag_count = 0}]) AS u FROM graded)
SELECT run_id, u.n AS "check", round(u.v, 6) AS value, CASE WHEN u.ok IS NULL THEN 'not_applicable' WHEN u.ok THEN 'pass' ELSE 'fail' END AS status FROM c""")
def custom_policy_checks(spark, sf):
    checks = gate.gate_checks(scoring.health_score(monthly_runs(spark, sf)), {"tight": {"max_missingness": 0.02}}, ["tight"])
    return checks.select("run_id", "check", "value", "status")


_HIST = _RUNS + _REVIEW + ", hist AS (SELECT *, substr(run_id, 1, 4) AS dataset_name FROM rv)"
_LAGGED = " UNION ALL ".join(
    f"SELECT dataset_name, lag(run_id) OVER w AS base_run_id, run_id, '{label}' AS metric, lag({m}) OVER w AS before, {m} AS after FROM hist WINDOW w AS (PARTITION BY dataset_name ORDER BY run_id)"
    for m, label in gate.COMPARED.items() if m != "corrupt_rate")


@query(_HIST + ", l AS (" + _LAGGED + """) SELECT dataset_name, base_run_id, run_id, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta,
  CASE WHEN after - before IS NULL THEN 'not_applicable' WHEN abs(after - before) < 1e-12 THEN 'unchanged' WHEN after < before THEN 'improved' ELSE 'worse' END AS direction
  FROM l WHERE base_run_id IS NOT NULL""")
def compare_consecutive_runs(spark, sf):
    shown = {m: label for m, label in gate.COMPARED.items() if m != "corrupt_rate"}
    return gate.compare_consecutive(monthly_runs(spark, sf), shown)


def _history(spark, sf):
    runs = scoring.health_score(monthly_runs(spark, sf))
    return runs.join(scoring.review(metric_rows(monthly_runs(spark, sf))), "run_id")


@query(_HIST + ", l AS (SELECT *, lag(findings) OVER w AS pf, lag(recommendations) OVER w AS pr, lag(score) OVER w AS ps, lag(grade) OVER w AS pg FROM "
       "(SELECT * REPLACE (replace(findings, '5%; ', '5%, ') AS findings) FROM hist) WINDOW w AS (PARTITION BY dataset_name ORDER BY run_id)) "
       "SELECT dataset_name, run_id, score - ps AS score_delta, pg AS grade_before, grade AS grade_after, pf IS DISTINCT FROM findings AS findings_changed FROM l WHERE pf IS NOT NULL")
def compare_run_findings(spark, sf):
    out = gate.compare_findings(_history(spark, sf))
    changed = (F.size("new_findings") > 0) | (F.size("resolved_findings") > 0)
    return out.select("dataset_name", "run_id", "score_delta", "grade_before", "grade_after", changed.alias("findings_changed"))


def _listed_sql(at: int, clean: str) -> str:
    """The texts of the rules that hold for a run, as a list."""
    texts = ", ".join(f"CASE WHEN {c} THEN '{scoring.TABULAR_RULES[i][at]}' END" for c, i in _RULE_SQL if scoring.TABULAR_RULES[i][at])
    some = f"list_filter([{texts}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({some}) > 0 THEN {some} ELSE ['{clean}'] END"


_SETS = (", ls AS (SELECT dataset_name, run_id, " + _listed_sql(3, scoring.CLEAN_FINDING) + " AS findings, " + _listed_sql(4, scoring.CLEAN_RECOMMENDATION) + " AS recommendations FROM hist), "
         "l AS (SELECT *, lag(findings) OVER w AS p_findings, lag(recommendations) OVER w AS p_recommendations FROM ls WINDOW w AS (PARTITION BY dataset_name ORDER BY run_id)) "
         + " UNION ALL ".join(f"SELECT dataset_name, run_id, '{k}' AS kind, array_to_string(list_sort(list_filter({k}, lambda x: NOT list_contains(p_{k}, x))), ' | ') AS new, "
                              f"array_to_string(list_sort(list_filter(p_{k}, lambda x: NOT list_contains({k}, x))), ' | ') AS resolved FROM l WHERE p_{k} IS NOT NULL" for k in ("findings", "recommendations")))


@query(_HIST + _SETS)
def compare_run_finding_sets(spark, sf):
    """Findings and recommendations of each run that the run before did not have, and those that are gone."""
    out = gate.compare_findings(_history(spark, sf))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_join(f"new_{k}", " | ").alias("new"), F.array_join(f"resolved_{k}", " | ").alias("resolved"))
                     for k in ("findings", "recommendations")])
    return out.select("dataset_name", "run_id", F.explode(rows).alias("r")).select("dataset_name", "run_id", "r.*")


@query(_HIST + " SELECT 'tabular' AS analyzer, dataset_name, arg_max(run_id, run_id) AS run_id, arg_max(score, run_id) AS score, arg_max(grade, run_id) AS grade FROM hist GROUP BY dataset_name")
def latest_runs(spark, sf):
    history = scoring.health_score(monthly_runs(spark, sf)).withColumn("record_id", F.col("run_id"))
    return gate.latest_runs(history).select("analyzer", "dataset_name", F.col("record_id").alias("run_id"), "score", "grade")


@query(_HIST + " SELECT run_id, dataset_name, score, grade, round(missingness, 6) AS missingness FROM hist")
def history_newest_first(spark, sf):
    runs = scoring.health_score(monthly_runs(spark, sf))
    return runs.orderBy(F.desc("created_at_utc")).select("run_id", "dataset_name", "score", "grade", "missingness")


@query("WITH " + fx.AUDITED_SQL + " SELECT '2025-03-01T000000Z0000-tab-ular-' || substr(sha256(CAST(o_orderpriority AS VARCHAR)), 1, 12) AS record_id, o_orderpriority AS dataset_name "
       "FROM audited WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def audit_record_ids(spark, sf):
    names = fx.audited_orders(spark, sf).groupBy(F.col("o_orderpriority").alias("dataset_name")).agg(F.count(F.lit(1)).alias("n"))
    runs = names.filter("dataset_name is not null").withColumns({"analyzer": F.lit(" tab ular! "), "file_sha256": F.sha2("dataset_name", 256)})
    return gate.audit_records(runs, F.lit("2025-03-01 00:00:00")).select("record_id", "dataset_name")


@query(_RUNS + """, x AS (SELECT run_id, unnest([{'m': 'missingness', 'v': missingness}, {'m': 'split_leakage', 'v': split_leakage}, {'m': 'max_drift_ks', 'v': max_drift_ks}], recursive := true) FROM runs),
a AS (SELECT m, avg(v) AS v FROM x WHERE run_id < '1998-01' AND m <> 'max_drift_ks' GROUP BY 1), c AS (SELECT m, avg(v) AS v FROM x WHERE run_id >= '1998-01' AND m <> 'missingness' GROUP BY 1)
SELECT n.m AS metric, round(a.v, 6) AS before, round(c.v, 6) AS after, round(c.v - a.v, 6) AS delta,
  CASE WHEN c.v - a.v IS NULL THEN 'not_applicable' WHEN abs(c.v - a.v) < 1e-12 THEN 'unchanged' WHEN c.v < a.v THEN 'improved' ELSE 'worse' END AS direction FROM (VALUES ('missingness'), ('split_leakage'), ('max_drift_ks')) n(m) LEFT JOIN a ON a.m = n.m LEFT JOIN c ON c.m = n.m""")
def compare_two_runs(spark, sf):
    rows = metric_rows(monthly_runs(spark, sf), names=["missingness", "split_leakage", "max_drift_ks"])
    old = rows.filter("run_id < '1998-01' and metric <> 'max_drift_ks'").groupBy("metric").agg(F.avg("value").alias("value"))
    new = rows.filter("run_id >= '1998-01' and metric <> 'missingness'").groupBy("metric").agg(F.avg("value").alias("value"))
    return gate.compare_runs(old, new, ["missingness", "split_leakage", "max_drift_ks"])


# evidence

_REPORTED = _AUDIT + """, runs AS (SELECT 'orders' AS run_id, max(value) FILTER ("check" = 'missingness' AND "key" = 'overall_missing_rate') AS missingness,
  max(value) FILTER ("key" = 'exact_duplicate_row_rate') AS duplicate_rate, max(value) FILTER ("key" = 'row_hash_cross_split_rate') AS split_leakage,
  max(value) FILTER ("key" = 'columns_with_hits') AS pii_flag_count, max(value) FILTER ("key" = 'hit_rate') AS pii_worst_rate, max(value) FILTER ("key" = 'top_10_ks') AS max_drift_ks,
  max(value) FILTER ("check" = 'row_anomaly_score_mad' AND "key" = 'p99') AS p99_anomaly, max(value) FILTER ("key" = 'positive_rate_disparity') AS max_positive_rate_disparity,
  avg(CASE WHEN value <= 0.2 THEN 1 ELSE greatest(0, 1 - (value - 0.2) / 0.3) END) FILTER ("key" = 'positive_rate_disparity') AS mean_disparity_credit FROM am), """ + SCORE_SQL + _REVIEW


@query(_REPORTED + " SELECT '2025-01-01T000000Z0000-tabular-' || substr(fingerprint, 1, 12) AS record_id, 'orders' AS dataset_name, fingerprint AS file_sha256, score, grade, "
       + ", ".join(f"round({p}, 6) AS {p}" for p in _POINTS) + ", verdict, findings, recommendations FROM rv, mark")
def audit_report(spark, sf):
    """Record id, score, verdict, findings and recommendations of the full audit, fingerprint included."""
    report = audit.audit_history(audit.report(_orders_metrics(spark, sf)), created_at=F.lit("2025-01-01 00:00:00"))
    return report.select("record_id", "dataset_name", "file_sha256", "score", "grade", *_POINTS, "verdict", F.array_join("findings", "; ").alias("findings"),
                         F.array_join("recommendations", "; ").alias("recommendations"))


def _evidence_frames(spark, sf):
    metrics = _orders_metrics(spark, sf)
    return metrics, audit.evidence_values(metrics, audit.report(metrics))


def _evidence_sql(rules) -> str:
    counted = {n: "greatest(1, " + " + ".join(f"coalesce(({c})::INT, 0)" for c, i in _RULE_SQL if scoring.TABULAR_RULES[i][at]) + ")" for n, at in (("findings", 3), ("recommendations", 4))}
    heads = f"""{_REPORTED}, pv AS (SELECT concat_ws('.', dimension, "check", "key") AS path, max(value) AS value, max("text") AS txt FROM am GROUP BY 1
  UNION ALL SELECT 'fairness.group_checks.max_disparity', max(value), NULL FROM am WHERE dimension = 'fairness' AND "key" IN ('positive_rate_disparity', 'max_missingness_disparity')
  UNION ALL SELECT 'verdict', NULL, verdict FROM rv UNION ALL SELECT 'score', score, grade FROM rv UNION ALL SELECT 'findings', {counted['findings']}, NULL FROM rv
  UNION ALL SELECT 'recommendations', {counted['recommendations']}, NULL FROM rv UNION ALL SELECT 'config', 1.0, NULL UNION ALL SELECT 'dataset_name', NULL, 'orders')"""
    options = ", ".join(
        f"('{area}', '{m}', {i}, {p}, '{path}', {'NULL' if limit is None or path in evidence.UNBOUNDED_PATHS else 0.3 if limit == 'drift_ks' else limit}, '{risky}')"
        for i, (area, m, paths, limit, risky) in enumerate(rules) for p, path in enumerate(paths))
    return heads + f""", ru(area, metric, rule, priority, path, threshold, risky) AS (VALUES {options}),
j AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY priority) AS rn FROM pv JOIN ru USING (path) WHERE value IS NOT NULL OR txt IS NOT NULL),
ev AS (SELECT area, metric, path AS evidence_path, value, txt, threshold, CASE WHEN threshold IS NULL OR value IS NULL THEN 'Evidence'
  WHEN CASE WHEN risky = 'above' THEN value > threshold ELSE value < threshold END THEN 'Review' ELSE 'OK' END AS status FROM j WHERE rn = 1)"""


@query(_evidence_sql(evidence.REGULATION_RULES) + " SELECT area, metric, evidence_path, round(value, 6) AS value, txt AS text, CAST(threshold AS DOUBLE) AS threshold, status FROM ev")
def regulation_evidence(spark, sf):
    _, values = _evidence_frames(spark, sf)
    found = evidence.evidence(values)
    return found.select("area", "metric", "evidence_path", "value", "text", "threshold", "status")


@query(_evidence_sql(evidence.STANDARD_RULES) + " SELECT area, metric, evidence_path, round(value, 6) AS value, txt AS text, CAST(threshold AS DOUBLE) AS threshold, status FROM ev")
def standard_evidence(spark, sf):
    _, values = _evidence_frames(spark, sf)
    found = evidence.evidence(values, evidence.STANDARD_RULES)
    return found.select("area", "metric", "evidence_path", "value", "text", "threshold", "status")


@query(_evidence_sql(evidence.STANDARD_RULES) + " SELECT 'orders' AS run_id, unnest(" + str(list(evidence.STANDARD_AREAS)) + ") AS area EXCEPT SELECT 'orders', area FROM ev")
def standard_gaps(spark, sf):
    metrics, values = _evidence_frames(spark, sf)
    found = evidence.evidence(values, evidence.STANDARD_RULES)
    return evidence.coverage_gaps(found, metrics.select("run_id").distinct())


_META = Roles(label="quality", split="split", groups=("lang", "source"), sources=("source",), ids=("doc_id",), metadata={"purpose": "search"})
_FACTS = "WITH " + fx.DOC_SQL + """, fact AS (SELECT count(quality) > 0 AS label, count(split) > 0 AS split, count(lang) > 0 OR count(source) > 0 AS groups, count(lang) > 0 AND count(source) > 0 AS two_groups,
  count(source) > 0 AS sources, false AS conditions, false AS two_raters, count(split) > 0 AS split_or_time, count(source) > 0 OR count(doc_id) > 0 AS sources_or_ids, count(*) > 0 AS "columns",
  false AS annotation_files, true AS hashes, true AS purpose, false AS known_limitations, false AS intended_use FROM doc)"""


def _needs_sql(needs) -> str:
    return " AND ".join(f'"{n}"' for n in needs) or "true"


@query(_FACTS + ", s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS section, {_needs_sql(needs)} AS filled FROM fact" for name, needs in evidence.SECTION_NEEDS)
       + ") SELECT section, filled, avg(filled::INT) OVER () AS completeness_rate FROM s")
def datasheet_completeness(spark, sf):
    return evidence.datasheet_completeness(fx.doc_labels(spark, sf), _META)


@query(_FACTS + " SELECT CAST(2 + label::INT + sources::INT + conditions::INT + groups::INT AS BIGINT) AS observed, CAST(6 AS BIGINT) AS expected, "
       "round((2 + label::INT + sources::INT + conditions::INT + groups::INT) / 6, 6) AS rate FROM fact")
def observability(spark, sf):
    return evidence.observability(fx.doc_labels(spark, sf), _META)


@query(_FACTS + " " + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {_needs_sql(needs)} AS ran FROM fact" for name, needs in evidence.CHECK_NEEDS))
def check_registry(spark, sf):
    """Every check with whether the documents hold what it needs."""
    return evidence.check_registry(fx.doc_labels(spark, sf), _META)
