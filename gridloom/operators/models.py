"""Models behind one protocol, seeded search for their parameters, and calibration of their probabilities."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ranks import hash_order, quantiles
from gridloom.operators.adaptive import normalize_proba, softmax
from gridloom.operators.score import class_scores, regression_scores
from gridloom.operators.shape import melt
from gridloom.operators.split import stratified_folds, subsample


@dataclass
class Family:
    """A model: how to build it, and the values its parameters may take."""

    build: Callable[..., Estimator]
    space: dict[str, Sequence]
    proba: bool = True
    extra: dict = field(default_factory=dict)


def _ovr(**p):
    return OneVsRest(classifier=GBTClassifier(seed=69, **p), featuresCol="features", labelCol="label")


CLASSIFIERS: dict[str, Family] = {
    "lr": Family(lambda **p: LogisticRegression(featuresCol="features", labelCol="label", **p), {"regParam": [0.0, 1e-3, 1e-2, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}),
    "rf": Family(lambda **p: RandomForestClassifier(featuresCol="features", labelCol="label", seed=69, **p), {"numTrees": [20, 50], "maxDepth": [4, 8], "minInstancesPerNode": [1, 10]}),
    "gbt": Family(_ovr, {"maxIter": [10, 20], "maxDepth": [3, 5], "stepSize": [0.1, 0.3]}, proba=False),
    "svm": Family(lambda **p: OneVsRest(classifier=LinearSVC(**p), featuresCol="features", labelCol="label"), {"regParam": [1e-3, 1e-2, 0.1, 1.0]}, proba=False),
    "mlp": Family(lambda **p: MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", seed=69, **p), {"maxIter": [50, 100], "stepSize": [0.01, 0.03]}),
}
REGRESSORS: dict[str, Family] = {
    "elastic": Family(lambda **p: LinearRegression(featuresCol="features", labelCol="label", **p), {"regParam": [0.0, 1e-3, 1e-2, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}),
    "rf": Family(lambda **p: RandomForestRegressor(featuresCol="features", labelCol="label", seed=69, **p), {"numTrees": [20, 50], "maxDepth": [4, 8]}),
    "gbt": Family(lambda **p: GBTRegressor(featuresCol="features", labelCol="label", seed=69, **p), {"maxIter": [10, 20], "maxDepth": [3, 5]}),
}


def assemble(df: DataFrame, id_col: str, features: Sequence[str], target: str) -> DataFrame:
    """``id``, ``features``, ``label`` of rows without a missing value."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(f"`{target}`").cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(rows).select("id", "features", "label")


def dummy_scores(df: DataFrame, target: str, classify: bool) -> DataFrame:
    """Scores of models that know the target only: ``model``, ``metric``, ``score``."""
    if classify:
        counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
        p = counts.agg((F.max("n") / F.sum("n")).alias("mode"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("prior"))
        return p.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit("acc").alias("metric"), F.col(m).alias("score")) for m in ("mode", "prior")])).alias("s")).select("s.*")
    x = df.select(F.col(target).cast("double").alias("y")).where("y IS NOT NULL AND NOT isnan(y)")
    middle = x.agg(F.avg("y").alias("mean")).crossJoin(quantiles(x, [], "y", {"median": 0.5}))  # one row each
    each = x.crossJoin(F.broadcast(middle)).agg(F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mean"), F.avg(F.abs(F.col("y") - F.col("median"))).alias("median"))
    return each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit("mae").alias("metric"), F.col(m).alias("score")) for m in ("mean", "median")])).alias("s")).select("s.*")


# Metrics of one-feature models.
UNIVARIATE = {True: ("acc", "bal-acc", "f1"), False: ("mae", "msqe", "mdae", "r2", "var-exp")}


def _univariate_score(metric: str, y: np.ndarray, p: np.ndarray) -> float:
    e = y - p
    if metric in ("bal-acc", "f1"):
        classes = np.unique(y) if metric == "bal-acc" else np.union1d(y, p)
        hit = np.array([((y == c) & (p == c)).sum() for c in classes], float)
        size = np.array([(y == c).sum() if metric == "bal-acc" else ((y == c).sum() + (p == c).sum()) / 2 for c in classes], float)
        return float((hit / size).mean())
    if metric in ("r2", "var-exp"):
        spread = y.var()
        return float(1 - ((e**2).mean() if metric == "r2" else e.var()) / spread) if spread > 0 else 0.0
    return float({"acc": lambda: (e == 0).mean(), "mae": lambda: np.abs(e).mean(), "msqe": lambda: (e**2).mean(), "mdae": lambda: np.median(np.abs(e))}[metric]())


def univariate_predictions(
    df: DataFrame, id_col: str, columns: Sequence[str], target: str, classify: bool, rows: int = 1500, folds: int = 5, seed: int = 69,
    categorical: Sequence[str] = (), metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Cross-validated scores of one-feature linear models and of the dummy: ``feature``, ``model``, and a column for each of ``metrics``.

    ``columns`` are numbers, missing ones being the median; ``categorical`` ones enter by their levels,
    missing being one. The models are fitted on about ``rows`` rows, drawn by ``split.subsample``: 20 of
    each class first, or by fifths of a numeric target, so that a feature's models fit one task.
    ``metrics``: ``acc`` or ``mae`` by default, else of ``UNIVARIATE``.
    """
    metrics = list(metrics or ("acc" if classify else "mae",))
    if unknown := set(metrics) - set(UNIVARIATE[classify]):
        raise ValueError(f"unknown metrics: {sorted(unknown)}, not of {UNIVARIATE[classify]}")
    some = subsample(df.select(id_col, target, *columns, *categorical), id_col, target, rows, 20, classify, seed).withColumn("_h", hash_order(seed, id_col))
    keep = {"y": F.col(target).cast("string" if classify else "double"), "h": F.col("_h")}
    long = melt(some, columns, keep).select("*", F.lit(None).cast("string").alias("s")) if columns else None
    if categorical:
        levels = melt(some, categorical, keep, cast="string", value="s").select("y", "h", "feature", F.lit(None).cast("double").alias("x"), F.coalesce("s", F.lit("nan")).alias("s"))
        long = levels if long is None else long.unionByName(levels)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        if pdf["s"].notna().any():
            design = np.eye(pdf["s"].nunique())[np.unique(pdf["s"].to_numpy(str), return_inverse=True)[1]]
        else:
            x = pdf["x"].to_numpy(float)
            x = np.where(np.isnan(x), np.nanmedian(x) if np.isfinite(x).any() else 0.0, x)
            design = np.c_[np.ones(len(x)), (x - x.mean()) / (x.std() or 1.0)]
        fold = np.arange(len(design)) % folds
        y = np.unique(pdf["y"].to_numpy(str), return_inverse=True)[1] if classify else pdf["y"].to_numpy(float)
        onehot = np.eye(y.max() + 1)[y] if classify else None
        got = {m: {k: [] for k in metrics} for m in ("dummy", "linear")}
        for f in range(min(folds, len(design))):
            a, b = fold != f, fold == f
            if not a.any() or not b.any():
                continue
            if classify:
                w = np.zeros((design.shape[1], onehot.shape[1]))
                for _ in range(200):  # full-gradient descent of the logistic loss
                    z = design[a] @ w
                    z = np.exp(z - z.max(1, keepdims=True))
                    w -= 0.5 * design[a].T @ (z / z.sum(1, keepdims=True) - onehot[a]) / a.sum()
                guess = {"linear": (design[b] @ w).argmax(1), "dummy": np.full(b.sum(), np.bincount(y[a]).argmax())}
            else:
                guess = {"linear": design[b] @ np.linalg.lstsq(design[a], y[a], rcond=None)[0], "dummy": np.full(b.sum(), np.median(y[a]))}
            for m, p in guess.items():
                for k in metrics:
                    got[m][k].append(_univariate_score(k, y[b], p))
        name = pdf["feature"].iloc[0]
        return pd.DataFrame([(name, m, *[float(np.mean(v[k])) if v[k] else np.nan for k in metrics]) for m, v in got.items()], columns=["feature", "model", *metrics])

    return long.groupBy("feature").applyInPandas(fit, f"feature string, model string, {', '.join(f'`{m}` double' for m in metrics)}")


# Metrics of the search, by whether more is better.
CLASS_METRICS = {m: True for m in ("acc", "bal-acc", "sens", "spec", "ppv", "npv", "f1")}
NUMBER_METRICS = {"mae": False, "msqe": False, "mdae": False, "r2": True, "var-exp": True}


def _score(predicted: DataFrame, classify: bool, metric: str | None = None) -> float:
    """The metric (balanced accuracy, or the mean absolute error), negative where less is better."""
    metric = metric or ("bal-acc" if classify else "mae")
    if metric == "mae":
        v = predicted.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
        return -v if v is not None else float("-inf")
    if metric == "bal-acc":
        per = predicted.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("r"))
        return per.agg(F.avg("r")).first()[0] or 0.0
    table = (class_scores if classify else regression_scores)(predicted, [], "label", "prediction").first()
    v = table[metric.replace("-", "_")] if table else None
    higher = (CLASS_METRICS if classify else NUMBER_METRICS)[metric]
    return (0.0 if classify else float("-inf")) if v is None else v if higher else -v


@dataclass
class Tuned:
    name: str
    params: dict
    score: float
    model: object
    trials: list[tuple[dict, float]]


def tune(train: DataFrame, family: str, classify: bool, trials: int = 8, folds: int = 3, patience: int = 15, seed: int = 69, metric: str | None = None) -> Tuned:
    """Search of the defaults and seeded random parameters, scored by cross-validation, then a fit on all rows.

    ``metric`` is one of ``CLASS_METRICS`` or ``NUMBER_METRICS``; the grid bounds ``trials``.

    ``train``: ``id``, ``features``, ``label``. A trial stops after its first fold if it lies below the
    median of earlier first folds; the search stops after ``patience`` trials without a better one.
    """
    if metric is not None and metric not in (known := CLASS_METRICS if classify else NUMBER_METRICS):
        raise ValueError(f"unknown metric: {metric}, not one of {list(known)}")
    f = (CLASSIFIERS if classify else REGRESSORS)[family]
    grid = [dict(zip(f.space, v)) for v in itertools.product(*f.space.values())]
    rest = grid[1:]
    random.Random(seed).shuffle(rest)
    grid = grid[:1] + rest  # the defaults come first
    extra = {}
    if family == "mlp":
        first = train.select("features").first()
        classes = int(train.agg(F.max("label")).first()[0] or 0) + 1
        extra = {"layers": [len(first.features) if first else 1, 16, classes]}
    folded = stratified_folds(train, "id", "label" if classify else None, folds, seed).persist()
    done: list[tuple[dict, float]] = []
    firsts: list[float] = []
    best, since = None, 0
    try:
        for p in grid[:trials]:
            scores = []
            for k in range(folds):
                model = f.build(**p, **extra).fit(folded.where(F.col("fold") != k))
                scores.append(_score(model.transform(folded.where(F.col("fold") == k)), classify, metric))
                if k == 0:
                    cut = len(firsts) >= 4 and scores[0] < float(np.median(firsts))
                    firsts.append(scores[0])
                    if cut:
                        break
            score = float(np.mean(scores))
            if len(scores) == folds or not done:
                done.append((p, score))
                if best is None or score > best[1]:
                    best, since = (p, score), 0
                else:
                    since += 1
            if since >= patience:
                break
    finally:
        folded.unpersist()
    return Tuned(family, best[0], best[1], f.build(**best[0], **extra).fit(train), done)


def predict(model, rows: DataFrame, classify: bool, classes: int | None = None) -> DataFrame:
    """``id``, ``label``, ``y_pred`` and, for classes, ``proba``; models without probabilities get them from their scores."""
    out = model.transform(rows)
    if not classify:
        return out.select("id", "label", F.col("prediction").alias("y_pred"))
    if "probability" in out.columns:
        p = normalize_proba(vector_to_array("probability"))
    elif "rawPrediction" in out.columns:
        p = softmax(vector_to_array("rawPrediction"))
    else:
        p = F.transform(F.sequence(F.lit(0), F.lit((classes or 2) - 1)), lambda i: (i == F.col("prediction").cast("int")).cast("double"))
    return out.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("y_pred"), p.alias("proba"))


def out_of_fold(rows: DataFrame, family: str, params: dict, classify: bool, folds: int = 5, seed: int = 69) -> DataFrame:
    """Predictions of each row by a model fitted on the other folds."""
    f = (CLASSIFIERS if classify else REGRESSORS)[family]
    folded = stratified_folds(rows, "id", "label" if classify else None, folds, seed)
    out = None
    for k in range(folds):
        model = f.build(**params).fit(folded.where(F.col("fold") != k))
        part = predict(model, folded.where(F.col("fold") == k), classify).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def fit_platt(df: DataFrame, score: str, hit: str) -> Callable[[DataFrame], DataFrame]:
    """Sigmoid of a score for being right; returns a transform that adds ``calibrated``."""
    rows = VectorAssembler(inputCols=[score], outputCol="features", handleInvalid="skip").transform(df.select(F.col(score).cast("double").alias(score), F.col(hit).cast("double").alias("label")).dropna())
    m = LogisticRegression(featuresCol="features", labelCol="label").fit(rows)
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda d: d.withColumn("calibrated", 1 / (1 + F.exp(-(a * F.col(score) + b))))


def fit_isotonic(df: DataFrame, score: str, hit: str, increasing: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Monotonic step-linear map of a score to the chance of being right; adds ``calibrated``, null for a missing score."""
    rows = df.select(F.col(score).cast("double").alias("f"), F.col(hit).cast("double").alias("label")).dropna()
    m = IsotonicRegression(featuresCol="f", labelCol="label", isotonic=increasing).fit(rows)
    xs, ys = [float(v) for v in m.boundaries.toArray()], [float(v) for v in m.predictions.toArray()]

    def apply(d: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def at(s: pd.Series) -> pd.Series:
            return pd.Series(np.where(s.isna(), np.nan, np.interp(s.astype(float), xs, ys)))

        return d.withColumn("calibrated", at(F.col(score).cast("double")))

    return apply


def choose_calibrator(df: DataFrame, id_col: str, score: str, hit: str, folds: int = 3, seed: int = 69) -> tuple[str, dict[str, float]]:
    """The calibrator of least cross-validated log-loss among none, platt and isotonic, and all losses."""
    folded = stratified_folds(df.select(id_col, score, hit).dropna(), id_col, hit, folds, seed).persist()
    losses: dict[str, list[float]] = {"none": [], "platt": [], "isotonic": []}
    y = F.col(hit).cast("double")
    try:
        for k in range(folds):
            train, test = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
            for name, out in (
                ("none", test.withColumn("calibrated", F.col(score))), ("platt", fit_platt(train, score, hit)(test)), ("isotonic", fit_isotonic(train, score, hit)(test)),
            ):
                p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("calibrated")))
                losses[name].append(out.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).first()[0] or 0.0)
    finally:
        folded.unpersist()
    mean = {k: float(np.mean(v)) for k, v in losses.items()}
    return min(mean, key=lambda k: (mean[k], k)), mean


def knn_predict(base: DataFrame, id_col: str, vector: str, label: str, queries: DataFrame, k: int = 5, weights: str = "uniform", metric: str = "l2") -> DataFrame:
    """``query_id``, ``y_pred``, ``vote`` (winner's share), ``min_dist``: majority of the k nearest, ties to the smaller label."""
    from gridloom.operators.results import nearest

    near = nearest(base, id_col, vector, queries, k, metric).join(base.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id")
    w = F.lit(1.0) if weights == "uniform" else 1.0 / F.greatest(F.col("distance"), F.lit(1e-12))
    votes = near.groupBy("query_id", "label").agg(F.sum(w).alias("w"), F.min("distance").alias("d"))
    return votes.groupBy("query_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).getField("label").alias("y_pred"), (F.max("w") / F.sum("w")).alias("vote"), F.min("d").alias("min_dist"))
