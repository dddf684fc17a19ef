"""Label noise, label predictability and downstream learners with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import as_double, col, is_nested, is_numeric, uniform
from plumbline.operators.distribution import bounded_rows, roc_auc_from_counts
from plumbline.operators.profile import _texts
from plumbline.operators.series import positions
from plumbline.sources.tables import written

MAX_CLASSES = 50
# Why an assessment of label noise is skipped.
TOO_MANY_CLASSES = "Classification labels only, with at most {most} classes."
TOO_FEW_ROWS = "Need at least {least} labeled rows; found {found}."
ONE_CLASS = "Need at least two observed classes."
LONE_ROWS = "Every class needs at least two labeled rows for out-of-fold assessment."
NO_FEATURES = "No usable non-constant features were available for label-noise assessment."


@dataclass
class LabelNoise:
    """Result of a label-noise assessment: scored rows, or the reason why there are none."""

    scored: DataFrame | None
    classes: list[str]
    note: str = ""
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()


def class_counts(df: DataFrame, label: str) -> dict[str, int] | None:
    """Rows per class, or None beyond the class limit (checked without collecting more)."""
    counts = df.filter(col(label).isNotNull()).groupBy(col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.take(MAX_CLASSES + 1)
    return None if len(rows) > MAX_CLASSES else {r["c"]: r["n"] for r in rows}


def usable_features(df: DataFrame, columns: Sequence[str], max_categories: int = 100) -> tuple[list, list, list]:
    """(numeric, categorical, dropped): constants out, text columns with too many values dropped."""
    columns = [c for c in columns if not is_nested(df.schema[c].dataType)]
    numbers = [c for c in columns if is_numeric(df.schema[c].dataType)]
    texts = [c for c in columns if c not in numbers]
    row = df.agg(*[(F.min(as_double(df, c)) < F.max(as_double(df, c))).alias(c) for c in numbers], F.lit(1).alias("_one")).first()
    numeric = [c for c in numbers if row[c]]
    kept, dropped = [], []
    if texts:
        # At most max_categories + 1 values of a column reach the count.
        values = _texts(df, texts).groupBy("column", "value").agg(F.lit(1))
        first = values.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("value")))
        sizes = {r["column"]: r["k"] for r in bounded_rows(
            first.filter(F.col("_r") <= max_categories + 1).groupBy("column").agg(F.count(F.lit(1)).alias("k")), len(texts))}
        kept = [c for c in texts if 1 < sizes.get(c, 0) <= max_categories]
        dropped = [c for c in texts if sizes.get(c, 0) > max_categories]
    return numeric, kept, dropped


def stratified_folds(df: DataFrame, key: Sequence[str], seed: int, folds: int, label: str = "_y") -> DataFrame:
    """Adds ``_fold``: rows of each class dealt in hash order, so folds differ by at most one row.

    The rank inside a class comes from ``positions`` over hash ranges; no class is sorted in one task.
    """
    drawn = df.withColumn("_draw", uniform(seed, *[col(k) for k in key]))
    ranked = positions(drawn, [label], ["_draw", *key], F.floor(F.col("_draw") * 256))
    return ranked.withColumn("_fold", ((F.col("_pos") - 1) % folds).cast("int")).drop("_draw", "_pos")


def category_plan(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, mode, pooled, kept): the value that stands for missing ones, values seen once, and values seen more often.

    The mode is the most frequent value, of equally frequent ones the smallest. Rows seen once are counted after missing values have
    become the mode, as a pipeline of two fitted steps would count them. Counts collapse map-side; there is a row for each column.
    """
    long = df.select(*by, *[col(c).cast("string").alias(c) for c in columns]).unpivot(list(by), list(columns), "column", "value")
    counts = long.filter("value is not null").groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = df.groupBy(*by).agg(*[F.sum(col(c).isNull().cast("bigint")).alias(c) for c in columns])
    missing = missing.unpivot(list(by), list(columns), "column", "missing")
    modes = counts.groupBy(*by, "column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
    filled = counts.join(modes, [*by, "column"]).join(missing, [*by, "column"])
    often = F.col("n") + F.when(F.col("value") == F.col("m.value"), F.col("missing")).otherwise(0)
    return filled.groupBy(*by, "column").agg(
        F.max("m.value").alias("mode"), F.sort_array(F.collect_list(F.when(often < 2, F.col("value")))).alias("pooled"),
        F.sort_array(F.collect_list(F.when(often >= 2, F.col("value")))).alias("kept"))


#: Stands for all values that a fit has seen once.
POOLED = "\x00pooled"


def with_categories(df: DataFrame, plan: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Text columns as a fitted plan (mode, pooled) reads them: missing values as the mode, values seen once as one value of their own."""
    out = {}
    for c, (mode, pooled) in plan.items():
        x = F.coalesce(col(c), F.lit(mode))
        out[c] = F.when(x.isin(pooled), POOLED).otherwise(x) if pooled else x
    return df.withColumns(out) if out else df


def feature_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median impute and scale; one-hot of text columns, unknown values as zeros."""
    stages, parts = [], []
    if numeric:
        stages += [Imputer(inputCols=list(numeric), outputCols=[f"_i_{c}" for c in numeric], strategy="median",
                           relativeError=0.0001),
                   VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_num"),
                   StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"_x_{c}" for c in categorical], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical])]
        parts += [f"_o_{c}" for c in categorical]
    return stages + [VectorAssembler(inputCols=parts, outputCol="_features")]


def label_noise(df: DataFrame, label: str, features: Sequence[str], ids: Sequence[str] = (), seed: int = 7,
                minimum: int = 40, max_categories: int = 100, max_iter: int = 50) -> LabelNoise:
    """Out-of-fold class probabilities of every labelled row from multinomial logistic regression.

    Rows carry label position ``_y``, probability array ``p`` and the identifying columns. All rows
    are assessed; the models train distributed, so no row cap is needed.
    """
    counts = class_counts(df, label)
    if counts is None:
        return LabelNoise(None, [], TOO_MANY_CLASSES.format(most=MAX_CLASSES))
    total = sum(counts.values())
    if total < minimum:
        return LabelNoise(None, [], TOO_FEW_ROWS.format(least=minimum, found=total))
    if len(counts) < 2:
        return LabelNoise(None, [], ONE_CLASS)
    if min(counts.values()) < 2:
        return LabelNoise(None, [], LONE_ROWS)
    numeric, categorical, dropped = usable_features(df, features, max_categories)
    if not numeric + categorical:
        return LabelNoise(None, [], NO_FEATURES)
    classes = sorted(counts)
    folds = min(5, min(counts.values()))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label).cast("string")) - 1

    def finite(c: str) -> Column:
        x = as_double(df, c)
        return F.when(F.abs(x) < float("inf"), x)

    frame = df.filter(col(label).isNotNull()).select(
        *[col(c).alias(f"_id_{c}") for c in ids], col(label).cast("string").alias("observed_label"),
        position.cast("double").alias("_y"), *[finite(c).alias(c) for c in numeric],
        *[col(c).cast("string").alias(c) for c in categorical])
    frame = stratified_folds(frame, [f"_id_{c}" for c in ids] or [*numeric, *categorical], seed, folds)
    frame = written(frame)

    def out_of_fold(fold: int) -> DataFrame:
        train, held = frame.filter(F.col("_fold") != fold), frame.filter(F.col("_fold") == fold)
        model = LogisticRegression(featuresCol="_features", labelCol="_y", family="multinomial", maxIter=max_iter,
                                   regParam=folds / (total * (folds - 1.0)), elasticNetParam=0.0, standardization=False,
                                   probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")
        plan = {r["column"]: (r["mode"], r["pooled"]) for r in bounded_rows(category_plan(train, categorical), len(categorical))} if categorical else {}
        used = [c for c in categorical if c in plan]
        fitted = Pipeline(stages=[*feature_stages(numeric, used), model]).fit(with_categories(train, plan))
        return fitted.transform(with_categories(held, plan)).select(
            *[f"_id_{c}" for c in ids], "observed_label", F.col("_y").cast("int").alias("_y"), vector_to_array("_prob").alias("p"))

    # The folds are independent jobs; the driver only waits for them, Spark runs them side by side.
    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(inheritable_thread_target(frame.sparkSession)(out_of_fold), range(folds)))
    scored = reduce(DataFrame.unionByName, parts)
    return LabelNoise(scored, classes, "", tuple(numeric), tuple(categorical), tuple(dropped))


def noise_rows(scored: DataFrame, classes: Sequence[str], confidence: float = 0.80) -> DataFrame:
    """Suggested label, confidence, noise score and suspicion of each row from its probabilities."""
    best = F.array_max("p")
    suggested = F.array_position("p", best) - 1
    assigned = F.element_at("p", F.col("_y") + 1)
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumns({
        "suggested_label": F.element_at(names, suggested.cast("int") + 1), "suggested_confidence": best,
        "assigned_probability": assigned, "noise_score": best - assigned,
        "suspected": (suggested != F.col("_y")) & (best >= confidence)})


def confident_other(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds ``confident_other``: the best class among those above their own mean confidence is another.

    The per-class thresholds (one number per class, at most 50) are fitted first.
    """
    fitted = {r["_y"]: r["t"] for r in bounded_rows(
        rows.groupBy("_y").agg(F.avg("assigned_probability").alias("t")), len(classes))}
    limits = F.array(*[F.lit(float(fitted.get(i, 1.0))) for i in range(len(classes))])
    masked = F.zip_with("p", limits, lambda p, t: F.when(p >= t, p).otherwise(-1.0))
    top = F.array_max(masked)
    return rows.withColumn("confident_other", (top >= 0) & (F.array_position(masked, top) - 1 != F.col("_y")))


def noise_summary(noise: LabelNoise, confidence: float = 0.80) -> DataFrame:
    rows = confident_other(noise_rows(noise.scored, noise.classes, confidence), noise.classes)
    hit = (F.col("suggested_label") == F.col("observed_label")).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("evaluated_rows"), F.sum(F.col("suspected").cast("bigint")).alias("suspected_label_noise_count"),
        F.avg(F.col("suspected").cast("double")).alias("suspected_label_noise_rate"),
        F.avg(F.col("confident_other").cast("double")).alias("estimated_label_noise_rate"),
        F.avg(hit).alias("out_of_fold_accuracy"), F.avg("assigned_probability").alias("mean_assigned_label_probability"))


def noise_candidates(noise: LabelNoise, k: int = 50, confidence: float = 0.80) -> DataFrame:
    """The most suspicious rows for review."""
    ids = [c for c in noise.scored.columns if c.startswith("_id_")]
    rows = noise_rows(noise.scored, noise.classes, confidence).filter("suspected")
    return rows.orderBy(F.desc("noise_score"), *ids).limit(k).select(
        *[F.col(c).alias(c[4:]) for c in ids], "observed_label", "suggested_label", "suggested_confidence",
        "assigned_probability", "noise_score")


def noise_by_class(noise: LabelNoise, confidence: float = 0.80) -> DataFrame:
    rows = noise_rows(noise.scored, noise.classes, confidence)
    return rows.groupBy("observed_label").agg(
        F.count(F.lit(1)).alias("evaluated_rows"), F.sum(F.col("suspected").cast("bigint")).alias("suspected_count"),
        F.avg(F.col("suspected").cast("double")).alias("suspected_rate"))


def holdout(df: DataFrame, label: str, key: Sequence[Column], share: float = 0.25, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the test taking exactly floor(share * n) rows of each class; a null label is a class.

    Rows of a class are dealt in hash order of their key: row number r is a test row where floor(r * share) steps up. Ranks are
    counted over hash ranges, so no class is sorted in one task, and both sides are read from one written table.
    """
    parts = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    drawn = df.select("*", uniform(seed, *key).alias("_draw"), *parts)
    names = [f"_k{i}" for i in range(len(parts))]
    ranked = positions(drawn, [label], ["_draw", *names], F.floor(F.col("_draw") * 256))
    test = F.floor(F.col("_pos") * share) > F.floor((F.col("_pos") - 1) * share)
    dealt = written(ranked.withColumn("_test", test).drop("_draw", "_pos", *names))
    return dealt.filter(~F.col("_test")).drop("_test"), dealt.filter("_test").drop("_test")


def auc_of(scored: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Exact ROC area from class counts per score."""
    counts = scored.groupBy(F.lit(1).alias("key"), score.alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"), F.sum((~positive).cast("bigint")).alias("neg"))
    return roc_auc_from_counts(counts, ["key"])


def _as_number(label: str) -> tuple:
    """Order of labels: numbers by value, after all other texts."""
    try:
        return (1, float(label), label)
    except ValueError:
        return (0, 0.0, label)


def predictability_auc(df: DataFrame, label: str, features: Sequence[str], ids: Sequence[str] = (), seed: int = 7,
                       minimum: int = 200) -> DataFrame | None:
    """AUC of a logistic regression on the numeric columns (missing as 0) on a stratified hold-out; binary labels only."""
    counts = class_counts(df, label)
    if counts is None or len(counts) != 2 or sum(counts.values()) < minimum or not features:
        return None
    high = max(counts, key=_as_number)
    key = [col(c) for c in (ids or features)]
    frame = df.filter(col(label).isNotNull()).select(
        (col(label).cast("string") == high).cast("double").alias("_y"), *[k.alias(f"_key{i}") for i, k in enumerate(key)],
        *[F.coalesce(as_double(df, c), F.lit(0.0)).alias(c) for c in features])
    train, test = holdout(frame, "_y", [F.col(f"_key{i}") for i in range(len(key))], 0.25, seed)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=100)]
    scored = Pipeline(stages=stages).fit(train).transform(test)
    return auc_of(scored, vector_to_array("probability")[1], F.col("_y") == 1.0).select("auc", "positives", "negatives")


def learners(seed: int, width: int) -> dict:
    """The learner panel: those of the study that Spark ML has."""
    common = dict(featuresCol="_features", labelCol="_y")
    return {
        "GradientBoosting": GBTClassifier(maxIter=10, maxDepth=4, seed=seed, **common),
        "RandomForest": RandomForestClassifier(numTrees=30, seed=seed, **common),
        "DecisionTree": DecisionTreeClassifier(seed=seed, **common),
        "GaussianNB": NaiveBayes(modelType="gaussian", **common),
        "LogReg": LogisticRegression(maxIter=50, **common),
        "LinearSVM": LinearSVC(maxIter=30, **common),
        "MLP": MultilayerPerceptronClassifier(layers=[width, 48, 2], maxIter=50, seed=seed, **common),
    }


def downstream_auc(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], seed: int = 7,
                   names: Sequence[str] | None = None) -> DataFrame:
    """Hold-out AUC of each learner trained on (corrupted) rows: (model, auc)."""
    def prepared(df: DataFrame) -> DataFrame:
        return df.filter(col(label).isNotNull()).select(
            col(label).cast("double").alias("_y"), *[as_double(df, c).alias(c) for c in features])

    stages = Pipeline(stages=feature_stages(features, [])).fit(prepared(train))
    fit_on = written(stages.transform(prepared(train)).select("_y", "_features"))
    held = written(stages.transform(prepared(test)).select("_y", "_features"))
    panel = {n: m for n, m in learners(seed, len(features)).items() if names is None or n in names}

    def score(name: str) -> DataFrame:
        scored = panel[name].fit(fit_on).transform(held)
        column = "rawPrediction" if name == "LinearSVM" else "probability"
        return auc_of(scored, vector_to_array(column)[1], F.col("_y") == 1.0).select(F.lit(name).alias("model"), "auc")

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(score), panel))
    return reduce(DataFrame.unionByName, rows)
