"""Queries on streams, change detection and Spark ML models."""

from pyspark.sql import functions as F

from plumbline.operators import faults, labels
from plumbline.plans.registry import query
from plumbline.sources.fixtures import table
from plumbline.sources.tables import work_directory
from plumbline.streaming import adaptive, monitors


def _stream(spark, sf, name):
    return monitors.read_stream(spark, sf, f"{name}.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_WINDOWS = """SELECT date_trunc('day', ts) AS window_start, count(*) AS rows, 0.0::DOUBLE AS missing_rate, round(avg(regexp_matches(props, '[0-9]{9,}')::INT), 6) AS pii_rate,
  round(avg((value < 1 OR value > 60)::INT), 6) AS out_of_range_value FROM events GROUP BY 1"""


def _window_frame(frame):
    return monitors.windowed_audit(frame, "ts", "1 day", "1 hour", ["user_id", "event_type", "value"], ["props"], {"value": (1.0, 60.0)})


#: Slices of time that the event stream arrives in.
SLICES = 5


def _slices(spark, sf, closing=False, late=False):
    """The events in slices of equal length of time, as they would arrive.

    ``late`` sends every 50th row of the first slice once more with the fourth, days behind the watermark. ``closing`` ends the stream with
    a row without content two days after the last one, which closes all windows before it.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    first, last = events.agg(F.min(at), F.max(at)).first()
    place = F.least(F.lit(SLICES - 1), F.floor((at - first) * SLICES / (last - first + 1)))
    parts = [events.filter(place == k) for k in range(SLICES)]
    if late:
        parts[3] = parts[3].unionByName(parts[0].filter("event_id % 50 = 0"))
    if closing:
        end = spark.range(1).select(F.timestamp_micros(F.lit(last + 2 * 86_400_000_000)).alias("ts"))
        parts.append(events.limit(0).unionByName(end, allowMissingColumns=True))
    return parts


_SLICED = """b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
late AS (SELECT events.* FROM events, b WHERE event_id % 50 = 0 AND (epoch_us(ts) - lo) * 5 // (hi - lo + 1) = 0)"""


def _sliced(spark, sf, build, mode="append", **feed):
    home = work_directory(spark)
    monitors.run_in_slices(_slices(spark, sf, **feed), build, monitors.write_batches(home, mode), home)
    return monitors.written_batches(spark, home).drop("batch")


@query(_WINDOWS)
def streaming_windowed_audit(spark, sf):
    """Daily quality windows of the event stream, each given out when it closes; the stream is stopped and goes on between slices."""
    return _ntz(_sliced(spark, sf, _window_frame, closing=True, late=True), "window_start")


@query(f"SELECT strftime(window_start, '%Y-%m-%dT%H:%M') AS run_id, 'Balanced (default)' AS policy, CASE WHEN missing_rate > 0.15 OR pii_rate >= 0.01 THEN 'FAIL' ELSE 'PASS' END AS status, "
       f"CAST((missing_rate > 0.15)::INT + (pii_rate >= 0.01)::INT AS BIGINT) AS violations, rows AS window_rows FROM ({_WINDOWS})")
def streaming_gate(spark, sf):
    """The policy gate inside each micro-batch: one verdict for each window, when it closes."""
    home = work_directory(spark)
    monitors.run_in_slices(_slices(spark, sf, closing=True, late=True), _window_frame, lambda w: monitors.gate_closed_windows(w, home), home)
    return monitors.written_batches(spark, home, "verdicts").select("run_id", "policy", "status", "violations", "window_rows")


@query(f"WITH {_SLICED} SELECT (SELECT count(*) FROM events) + count(*) + 1 AS arrived, (SELECT count(*) FROM events) AS judged, 1::BIGINT AS open, count(*) AS late, count(*) > 0 AS refused FROM late")
def streaming_late_rows(spark, sf):
    """Rows that arrived, that closed windows hold, that wait in an open one, and that came too late; and whether the operator reports refusals."""
    home = work_directory(spark)
    progress = monitors.run_in_slices(_slices(spark, sf, closing=True, late=True), _window_frame, lambda w: monitors.gate_closed_windows(w, home), home)
    judged = monitors.written_batches(spark, home, "verdicts").agg(F.sum("window_rows").alias("judged"))
    seen = progress.agg(F.sum("arrived").alias("arrived"), (F.sum("dropped") > 0).alias("refused"))
    return seen.crossJoin(judged).select("arrived", "judged", F.lit(1).cast("long").alias("open"), (F.col("arrived") - F.col("judged") - 1).alias("late"), "refused")


@query("WITH q AS (SELECT event_id, value, quantile_cont(value, 0.9) OVER w AS t2, quantile_cont(value, 0.7) OVER w AS t1 FROM events "
       "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT event_id, round(t2, 6) AS threshold, value > t2 AS query, "
       "CASE WHEN value > t2 THEN 'human' WHEN value > least(t1, t2) THEN 'oracle' ELSE 'none' END AS route FROM q")
def streaming_review_budget(spark, sf):
    """The trailing-quantile review budget with its window in each user's state, over several micro-batches."""
    found = _sliced(spark, sf, lambda s: adaptive.review_budget_stream(s, "user_id", ["ts", "event_id"], "value", 50, 0.1, 0.2))
    return found.select("event_id", F.col("tau2").alias("threshold"), "query", "route")


@query("""SELECT event_type, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01') AS window_start, count(*) AS n, round(avg((value > 20)::INT), 6) AS query_rate,
  round(avg((event_id % 3 = 0)::INT), 6) AS accuracy FROM events GROUP BY 1, 2""")
def streaming_rates(spark, sf):
    """Half-day rates for each event type, over several micro-batches with a watermark of an hour."""
    return _ntz(_sliced(spark, sf, lambda s: monitors.rate_windows(
        s, "ts", "12 hours", None, "1 hour", ["event_type"], query_rate=F.col("value") > 20, accuracy=F.col("event_id") % 3 == 0),
        closing=True, late=True), "window_start")


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL '6 hours']) AS window_start, value FROM events)
SELECT window_start, count(*) AS n, round(avg((value > 20)::INT), 6) AS query_rate FROM s GROUP BY 1""")
def sliding_rates(spark, sf):
    """Sliding windows on the batch frame (the same operator as on a stream)."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ntz(monitors.rate_windows(events, "ts", "12 hours", "6 hours", "1 hour", [], query_rate=F.col("value") > 20), "window_start")


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, round(sum(value), 2) AS total FROM events", digits=2)
def streaming_deduplication(spark, sf):
    """Every event twice on the stream, and some of them once more days later; the watermark of two hours holds the state small and refuses what is late."""
    out = _sliced(spark, sf, lambda s: monitors.first_occurrences(
        s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id", "ts"], "ts", "2 hours"), late=True)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"), F.sum("value").alias("total"))


_DETECTOR = adaptive.Detector(max_window=300, min_window=30, delta=0.9)


def _drifting(events):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return events.withColumn("x", F.when(late, F.col("value") / 60 + 3).otherwise(F.col("value") / 60))


#: The detector as a recursion over the rows of each user: the window is a list that an alarm cuts to its newest half.
_DETECTED = """WITH RECURSIVE x AS (SELECT user_id, ts, event_id, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value / 60 + 3 ELSE value / 60 END AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
step AS (SELECT user_id, 0::BIGINT AS pos, []::DOUBLE[] AS win, false AS alarm FROM events GROUP BY 1
  UNION ALL
  SELECT user_id, pos, CASE WHEN alarm THEN win[len(win) // 2 + 1:] ELSE win END AS win, alarm FROM (
    SELECT user_id, pos, win, len(win) >= 30 AND len(list_filter(range(15, len(win) - 14), lambda m:
      abs(list_avg(win[1:m]) - list_avg(win[m + 1:])) > sqrt(2 * ln(2 / 0.9) * (1 / m + 1 / (len(win) - m))))) > 0 AS alarm
    FROM (SELECT s.user_id, x.pos, list_append(s.win, x.x)[-300:] AS win FROM step s JOIN x ON x.user_id = s.user_id AND x.pos = s.pos + 1))),
found AS (SELECT user_id, pos, alarm FROM step WHERE pos > 0)"""
_ALARMS = _DETECTED + """ SELECT user_id, count(*) AS rows, CAST(sum(alarm::INT) AS BIGINT) AS alarms, min(pos) FILTER (alarm) AS first_alarm FROM found GROUP BY 1"""


@query(_ALARMS)
def change_detection(spark, sf):
    """Adaptive-window alarms per user on a series whose level shifts in mid January, batch twin."""
    events = _drifting(table(spark, sf, "events"))
    found = adaptive.detect_changes(events, "user_id", ["ts", "event_id"], "x", F.date_trunc("day", "ts"), _DETECTOR)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("alarm").cast("bigint")).alias("alarms"),
                                        F.min(F.when(F.col("alarm"), F.col("position"))).alias("first_alarm"))


@query(_ALARMS)
def streaming_change_detection(spark, sf):
    """The same detector with per-key state on the stream, over several micro-batches."""
    found = _sliced(spark, sf, lambda s: adaptive.detect_changes_stream(_drifting(s), "user_id", "ts", "x", _DETECTOR, idle="30 days", ties=["event_id"]))
    return found.groupBy(F.col("key").alias("user_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("alarm").cast("bigint")).alias("alarms"),
        F.min(F.when(F.col("alarm"), F.col("position"))).alias("first_alarm"))


@query(_DETECTED + """, b AS (SELECT CASE WHEN max(alarm::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 1 THEN 0.3 ELSE 0.05 END AS budget FROM found)
SELECT CAST(budget AS DOUBLE) AS budget, count(*) AS rows FROM b GROUP BY 1""")
def alarm_budget(spark, sf):
    """Rows whose label budget is raised after an alarm."""
    events = _drifting(table(spark, sf, "events"))
    found = adaptive.detect_changes(events, "user_id", ["ts", "event_id"], "x", F.date_trunc("day", "ts"), _DETECTOR)
    budgeted = adaptive.alarm_windows(found, "user_id", 20, 0.05, 0.3)
    return budgeted.groupBy("budget").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH p AS (SELECT vec_id, [abs(embedding[1]), abs(embedding[2]), abs(embedding[3])] AS a FROM embeddings), q AS (SELECT vec_id, list_transform(a, lambda x: x::DOUBLE / list_sum(a)) AS p FROM p),
s AS (SELECT vec_id, p, list_reverse_sort(p) AS r FROM q)
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: least(1, greatest(1e-12, x)) * ln(least(1, greatest(1e-12, x))))) + 0.5 * (1 - (r[1] - r[2])), 4) AS uncertainty FROM s""", digits=4)
def uncertainty_score(spark, sf):
    raw = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", adaptive.uncertainty(F.transform(raw, lambda x: x / total), 0.5).alias("uncertainty"))


# models

def _vectors(spark, sf):
    """Embeddings as 64 numeric features with every 25th label moved to the next class."""
    key = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.when(key % 25 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(64)])


def _noise(spark, sf):
    return labels.label_noise(_vectors(spark, sf), "label", [f"f{i}" for i in range(64)], ["vec_id"], max_iter=25)


@query()
def label_noise_summary(spark, sf):
    return labels.noise_summary(_noise(spark, sf))


@query()
def label_noise_candidates(spark, sf):
    return labels.noise_candidates(_noise(spark, sf), 50, 0.5)


@query()
def label_noise_by_class(spark, sf):
    return labels.noise_by_class(_noise(spark, sf), 0.5)


def _line_task(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") > 40000).cast("int").alias("y"),
        *[F.col(c) for c in ("l_quantity", "l_discount", "l_tax")])


_LINE_Y = "SELECT CAST(l_extendedprice > 40000 AS INTEGER) AS y FROM lineitem"


@query(f"SELECT y, count(*) - floor(count(*) * 0.25)::BIGINT AS train, floor(count(*) * 0.25)::BIGINT AS test FROM ({_LINE_Y}) GROUP BY y")
def stratified_holdout(spark, sf):
    """Rows of each class on both sides of the hold-out that label predictability and the learner panel use."""
    train, test = labels.holdout(_line_task(spark, sf), "y", [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    sides = train.withColumn("side", F.lit(0)).unionByName(test.withColumn("side", F.lit(1)))
    return sides.groupBy("y").agg(F.sum(1 - F.col("side")).alias("train"), F.sum("side").alias("test"))


@query("""WITH n AS (SELECT (event_id % 5)::BIGINT AS fold, x.c AS "column", x.v AS value FROM events,
  unnest([{'c': 'event_type', 'v': CASE WHEN event_id % 9 <> 0 THEN event_type END}, {'c': 'props', 'v': CASE WHEN event_id % 4 <> 0 THEN props END}]) AS t(x)),
k AS (SELECT fold, "column", value, count(*) AS n FROM n WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT fold, "column", (min({'n': -n, 'v': value})).v AS mode FROM k GROUP BY ALL), z AS (SELECT fold, "column", count(*) - count(value) AS missing FROM n GROUP BY ALL)
SELECT fold, "column", mode, count(*) FILTER (n + CASE WHEN value = mode THEN missing ELSE 0 END < 2) AS pooled,
  count(*) FILTER (n + CASE WHEN value = mode THEN missing ELSE 0 END >= 2) AS kept FROM k JOIN m USING (fold, "column") JOIN z USING (fold, "column") GROUP BY ALL""")
def category_plan(spark, sf):
    """What label noise fits on the text columns of each fold: the stand-in for missing values, values pooled and values kept."""
    key = F.col("event_id")
    events = table(spark, sf, "events").select((key % 5).alias("fold"), F.when(key % 9 != 0, F.col("event_type")).alias("event_type"), F.when(key % 4 != 0, F.col("props")).alias("props"))
    return labels.category_plan(events, ["event_type", "props"], ["fold"]).select("fold", "column", "mode", F.size("pooled").cast("long").alias("pooled"), F.size("kept").cast("long").alias("kept"))


@query()
def label_predictability_auc(spark, sf):
    return labels.predictability_auc(_line_task(spark, sf), "y", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query()
def downstream_auc(spark, sf):
    """Hold-out AUC of the learner panel trained on clean and on corrupted rows."""
    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    train, test = labels.holdout(_line_task(spark, sf), "y", key)
    draw = faults.keyed_draw(7, "l_orderkey", "l_linenumber", "l_partkey")
    features = ["l_quantity", "l_discount", "l_tax"]
    noisy = faults.label_noise(train, "y", 0.4, draw)
    clean = labels.downstream_auc(train, test, "y", features).withColumn("severity", F.lit(0.0))
    return clean.unionByName(labels.downstream_auc(noisy, test, "y", features, names=["LogReg", "DecisionTree"]).withColumn("severity", F.lit(0.4)))


