"""Feature selection: by association, by prediction, by model, step by step, and over several targets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.linear import cross_products
from gridloom.functions.ranks import hash_order

# Share, least and most of the features that are kept by default.
DEFAULTS = {"cont": (0.2, 10, 50), "cat": (0.1, 5, 20), "total": (0.25, 8, 50)}


def n_select(kind: str, n_features: int, asked: int | float | None = None) -> int:
    """How many features of a kind to keep: as asked (a number, or a share of them), else by default."""
    if isinstance(asked, bool):
        raise ValueError("asked must be a number")
    if isinstance(asked, int):
        return min(n_features, asked)
    if isinstance(asked, float):
        return min(n_features, math.ceil(asked * n_features))
    share, least, most = DEFAULTS[kind]
    return min(n_features, max(least, min(most, math.ceil(share * n_features))))


def by_association(scores: DataFrame, metric: str, n_cont: int, n_cat: int, p_value: str | None = None, significant_only: bool = False) -> DataFrame:
    """The strongest features of each kind: ``feature``, ``kind``, ``score``, ``rank``.

    ``scores``: ``feature``, ``kind`` (``cont`` or ``cat``), the metric. Scores count by size; ties go
    by name, missing scores are left out. ``significant_only`` keeps p-values of 0.05 at most.
    """
    rows = scores.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    if significant_only and p_value:
        rows = rows.where(F.col(p_value) <= 0.05)
    best = rows.groupBy("feature", "kind").agg(F.max(F.abs(F.col(metric))).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "feature")))  # a row a feature
    return ranked.where(F.col("rank") <= F.when(F.col("kind") == "cont", n_cont).otherwise(n_cat))


def by_prediction(scores: DataFrame, metric: str, higher: bool, n: int, significant_only: bool = False) -> DataFrame:
    """The features whose one-feature model beats the dummy most: ``feature``, ``gain``, ``rank``.

    ``scores``: ``feature``, ``model`` (``dummy`` or another), the metric. If all gains are equal, all
    features are kept.
    """
    sign = 1 if higher else -1
    dummy = F.max(F.when(F.col("model") == "dummy", F.col(f"`{metric}`")))
    other = (F.max if higher else F.min)(F.when(F.col("model") != "dummy", F.col(f"`{metric}`")))
    gains = scores.groupBy("feature").agg((sign * (other - dummy)).alias("gain")).where("gain IS NOT NULL")
    if significant_only:
        gains = gains.where("gain > 0")
    spread = gains.agg((F.max("gain") > F.min("gain")).alias("varies"))
    ranked = gains.crossJoin(spread).withColumn("rank", F.row_number().over(W.orderBy(F.desc("gain"), "feature")))  # a row a feature
    return ranked.where((F.col("rank") <= n) | ~F.col("varies")).drop("varies")


def frequencies(lists: DataFrame, n: int | None = None) -> DataFrame:
    """How many targets chose each feature, the most often chosen first, ties by name: ``feature``, ``count``."""
    out = lists.groupBy("feature").agg(F.count_distinct("target").alias("count")).orderBy(F.desc("count"), "feature")
    return out.limit(n) if n else out


def borda(scores: DataFrame, higher: bool = True, alpha: float = 0.5, support: float = 0.2) -> DataFrame:
    """Rank aggregation over targets: ``feature``, ``points``, ``support``, ``score`` (the best is 1).

    ``scores``: ``target``, ``feature``, ``score``. In each target a feature gets n - rank + 1 points,
    equal scores the mean rank; sums are weighted by (targets that have it / all targets) to the
    power ``alpha``. Features in fewer than ``support`` of the targets are left out.
    """
    w = W.partitionBy("target")
    order = w.orderBy(F.desc("score") if higher else F.asc("score"))
    ties = W.partitionBy("target", "score")
    rows = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    ranked = rows.withColumns({"r": F.rank().over(order) + (F.count("*").over(ties) - 1) / 2, "n": F.count("*").over(w)})
    targets = rows.agg(F.count_distinct("target").alias("T"))
    agg = ranked.groupBy("feature").agg(F.sum(F.col("n") - F.col("r") + 1).alias("points"), F.count_distinct("target").alias("support")).crossJoin(targets)  # one row
    agg = agg.where(F.col("support") >= F.ceil(F.col("T") * support))
    agg = agg.withColumn("raw", F.col("points") * F.pow(F.col("support") / F.col("T"), F.lit(alpha)))
    top = agg.agg(F.max("raw").alias("top"))
    return agg.crossJoin(top).select("feature", "points", "support", (F.col("raw") / F.col("top")).alias("score"))


def top_k(sizes: Sequence[int]) -> int:
    """How many features to keep over several targets: the median of their numbers, between 5 and 80."""
    return int(min(80, max(5, round(float(np.median(list(sizes))))))) if sizes else 5


def gram(df: DataFrame, id_col: str, features: Sequence[str], target: str, folds: int = 5, seed: int = 69, classes: Sequence | None = None) -> list[np.ndarray]:
    """Cross products of (1, features, target) within each fold: all that linear models of any subset need.

    One pass; what reaches the driver has a row and a column for each feature. Rows with a missing
    value are left out. Columns are shifted by their mean first, for accuracy. With ``classes`` the
    target is a column for each of them, 1 in its rows and 0 in all others.
    """
    rows = df.select(F.col(id_col), *[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(f"`{target}`").cast("double").alias(target)).dropna()
    ys = [F.col(f"`{target}`")] if classes is None else [(F.col(f"`{target}`") == float(c)).cast("double") for c in classes]
    cols = [*[F.col(f"`{c}`") for c in features], *ys]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shifted = [F.lit(1.0)] + [c - F.lit(float(m or 0.0)) for c, m in zip(cols, means)]
    fold = F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("long") % folds
    return cross_products(rows, shifted, [fold == k for k in range(folds)])


def cv_r2(grams: Sequence[np.ndarray], chosen: Sequence[int], ridge: float = 1e-8, targets: int = 1) -> float:
    """Cross-validated share of the target's variance that a linear model of the chosen features explains; of several target columns, of all together."""
    total = sum(grams)
    at, ys = [0, *[c + 1 for c in chosen]], list(range(total.shape[0] - targets, total.shape[0]))
    sse = 0.0
    for g in grams:
        train = total - g
        a = train[np.ix_(at, at)]
        beta = np.linalg.solve(a + ridge * np.diag(np.diag(a) + 1e-12), train[np.ix_(at, ys)])
        sse += np.trace(g[np.ix_(ys, ys)] - 2 * beta.T @ g[np.ix_(at, ys)] + beta.T @ g[np.ix_(at, at)] @ beta)
    sst = sum(total[y, y] - total[0, y] ** 2 / total[0, 0] if total[0, 0] else 0.0 for y in ys)
    return float(1 - sse / sst) if sst > 0 else 0.0


def stepwise(
    df: DataFrame, id_col: str, features: Sequence[str], target: str, n: int, forward: bool = True, redundancy: float | None = None, folds: int = 5,
    seed: int = 69, classes: Sequence | None = None,
) -> list[tuple[str, float]]:
    """Features in the order they are chosen (forward) or kept (backward), with the cross-validated score after each step.

    All candidates of all steps are scored from one set of cross products, so the data is read
    once whatever the number of steps. ``redundancy``: in each forward step, candidates whose score
    is within it of the best are dropped as redundant; only the best joins. ``classes``: the codes of a
    class target, which is then predicted as an indicator a class, whatever the order of the codes.
    """
    names, grams = list(features), gram(df, id_col, features, target, folds, seed, classes)
    score = lambda chosen: cv_r2(grams, chosen, targets=len(classes) if classes is not None else 1)
    n = min(n, len(names))
    if forward:
        chosen: list[int] = []
        steps, left = [], list(range(len(names)))
        while left and len(chosen) < n:
            scored = sorted(((score([*chosen, c]), c) for c in left), key=lambda x: (-x[0], names[x[1]]))
            best, c = scored[0]
            chosen.append(c)
            steps.append((names[c], best))
            drop = {x for s, x in scored if redundancy is not None and best - s <= redundancy} | {c}
            left = [x for x in left if x not in drop]
        return steps
    kept = list(range(len(names)))
    while len(kept) > n:
        _, worst = max(((score([k for k in kept if k != c]), c) for c in kept), key=lambda x: (x[0], names[x[1]]))
        kept.remove(worst)
    return [(names[c], score(kept)) for c in kept]


def by_model(df: DataFrame, features: Sequence[str], target: str, classify: bool, how: str = "linear", penalty: float = 0.01, seed: int = 69) -> list[tuple[str, float]]:
    """Features a fitted model keeps, the strongest first: nonzero weights of a lasso (``linear``), or importances of at least the mean (``tree``)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(f"`{target}`").cast("double").alias("_y")).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows)
    if how == "linear":
        scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(rows).transform(rows)
        if classify:
            m = LogisticRegression(featuresCol="_s", labelCol="_y", elasticNetParam=1.0, regParam=penalty, family="multinomial").fit(scaled)
            weights = np.abs(m.coefficientMatrix.toArray()).max(axis=0)
        else:
            weights = np.abs(LinearRegression(featuresCol="_s", labelCol="_y", elasticNetParam=1.0, regParam=penalty).fit(scaled).coefficients.toArray())
        least = 1e-5
    else:
        forest = RandomForestClassifier if classify else RandomForestRegressor
        weights = forest(featuresCol="_v", labelCol="_y", numTrees=30, seed=seed).fit(rows).featureImportances.toArray()
        least = float(weights.mean())
    kept = [(c, float(w)) for c, w in zip(features, weights) if w >= least and w > 0]
    return sorted(kept, key=lambda x: (-x[1], x[0]))


def aggregate_selections(selections: DataFrame, strategy: str = "borda", higher: bool = True, most: int | None = None, **options) -> DataFrame:
    """One list of features out of those chosen for several targets: ``feature``, ``score``, the best first.

    ``selections``: ``target``, ``feature``, ``score``. ``freq`` orders by the number of targets,
    ``borda`` by rank aggregation; ``most`` are kept, by default the median size of the targets'
    lists, between 5 and 80.
    """
    sizes = [r["count"] for r in selections.groupBy("target").count().collect()]
    if strategy == "freq":
        ranked = frequencies(selections).select("feature", F.col("count").cast("double").alias("score"))
    elif strategy == "borda":
        ranked = borda(selections, higher, **options).select("feature", "score")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return ranked.orderBy(F.desc("score"), "feature").limit(most or top_k(sizes))


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean score of each feature over the targets that have it: ``feature``, ``score``."""
    return scores.groupBy("feature").agg(F.avg("score").alias("score"))
