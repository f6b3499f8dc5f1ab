"""Scores of predictions: one aggregate over the rows, then arithmetic on a few numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.ranks import quantiles, value_counts


def confusion(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Per ``keys`` and label: ``tp``, ``fp``, ``fn``, ``tn`` against all other labels.

    Labels are those of either column. With the two labels 0 and 1 only label 1 is reported. Rows
    with a missing label or prediction are left out.
    """
    keys = list(keys)
    cells = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("c"))
    true, said = F.struct(F.col("_y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("s")), F.struct(F.col("_p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("s"))
    sides = cells.select(*keys, "c", (F.col("_y") == F.col("_p")).alias("hit"), F.explode(F.array(true, said)).alias("e")).select(*keys, "c", "hit", "e.*")
    per = sides.groupBy(*keys, "label").agg(
        F.sum(F.when(F.col("hit"), F.col("c") * F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit"), F.col("c") * F.col("t")).otherwise(0)).alias("fn"),
        F.sum(F.when(~F.col("hit"), F.col("c") * F.col("s")).otherwise(0)).alias("fp"),
    )
    w = W.partitionBy(*keys)  # a row a label
    per = per.withColumns({"n": F.sum(F.col("tp") + F.col("fn")).over(w), "k": F.count("*").over(w), "low": F.min("label").over(w), "high": F.max("label").over(w)})
    binary = (F.col("k") == 2) & (F.col("low").cast("string") == "0") & (F.col("high").cast("string") == "1")
    per = per.where(~binary | (F.col("label") == F.col("high")))
    return per.select(*keys, "label", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def class_scores(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Per ``keys``: accuracy and macro means over the labels of sensitivity, specificity, ppv, npv, f1, and balanced accuracy.

    A label whose denominator is zero is left out of that mean; f1 counts it as 0. Balanced accuracy
    is the mean sensitivity over labels that occur.
    """
    keys = list(keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    macro = confusion(df, keys, y, p).groupBy(*keys).agg(
        F.avg(ratio(tp, tp + fn)).alias("sens"), F.avg(ratio(tn, tn + fp)).alias("spec"), F.avg(ratio(tp, tp + fp)).alias("ppv"), F.avg(ratio(tn, tn + fn)).alias("npv"),
    )
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    cells = rows.groupBy(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("c"))
    acc = cells.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("_y") == F.col("_p"), F.col("c")).otherwise(0)) / F.sum("c")).alias("acc"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("c")).otherwise(0)
    true = cells.groupBy(*keys, F.col("_y").alias("label")).agg(F.sum(hit).alias("h"), F.sum("c").alias("t"))
    said = cells.groupBy(*keys, F.col("_p").alias("label")).agg(F.sum("c").alias("s"))
    each = true.join(said, [*keys, "label"], "full")
    f1 = each.groupBy(*keys).agg(
        F.avg(F.coalesce(2 * F.coalesce("h", F.lit(0)) / (F.coalesce("t", F.lit(0)) + F.coalesce("s", F.lit(0))), F.lit(0.0))).alias("f1"),
        F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("bal_acc"),
    )
    if keys:
        return acc.join(macro, keys).join(f1, keys)
    return acc.crossJoin(macro).crossJoin(f1)  # one row each


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Per ``keys``: ``auroc`` by ranks, at least a half; a half where a class is missing. Non-finite scores are left out."""
    keys = list(keys)
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf"))
    ranked = value_counts(df.where(ok).withColumn("_pos", positive.cast("long")), keys, score, {"pos": F.col("_pos")})
    agg = ranked.groupBy(*keys).agg(F.sum("pos").cast("double").alias("n1"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("n0"), F.sum(F.col("pos") * F.col("avg_rank")).alias("r1"))
    a = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n0") * F.col("n1"))
    return agg.select(*keys, F.when((F.col("n0") > 0) & (F.col("n1") > 0), 0.5 + F.abs(0.5 - a)).otherwise(0.5).alias("auroc"))


def regression_scores(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Per ``keys``: ``mae``, ``msqe``, ``mdae``, ``r2``, ``var_exp``. Rows with a missing number are left out."""
    keys = list(keys)
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), (F.col(y) - F.col(p)).cast("double").alias("_e")).where("_y IS NOT NULL AND _e IS NOT NULL AND NOT isnan(_e)")
    rows = rows.withColumn("_a", F.abs("_e"))
    agg = rows.groupBy(*keys).agg(
        F.avg("_a").alias("mae"), F.avg(F.col("_e") * F.col("_e")).alias("msqe"),
        (1 - F.avg(F.col("_e") * F.col("_e")) / F.var_pop("_y")).alias("r2"), (1 - F.var_pop("_e") / F.var_pop("_y")).alias("var_exp"),
    )
    med = quantiles(rows.select(*keys, "_a"), keys, "_a", {"mdae": 0.5})
    out = agg.join(med, keys) if keys else agg.crossJoin(med)  # one row each
    return out.select(*keys, "mae", "msqe", "mdae", "r2", "var_exp")


def multi_target_scores(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``subset_acc`` (all targets of a row right), ``hamming_loss``, ``multi_rmse`` (root of the summed squares' mean) of (truth, prediction) columns."""
    right = [(F.col(a) == F.col(b)).cast("int") for a, b in pairs]
    total = sum(right[1:], right[0])
    squares = [F.pow(F.col(a).cast("double") - F.col(b).cast("double"), 2) for a, b in pairs]
    return df.dropna(subset=[c for p in pairs for c in p]).agg(
        F.avg((total == len(pairs)).cast("double")).alias("subset_acc"), (1 - F.avg(total) / len(pairs)).alias("hamming_loss"), F.sqrt(F.avg(sum(squares[1:], squares[0]))).alias("multi_rmse")
    )


def calibration_scores(df: DataFrame, y: str, p_true: str, hit: Column) -> DataFrame:
    """``label`` (null: all), ``n``, ``log_loss``, ``brier``, ``acc`` of the probability given to the true class."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1.0), F.col(p_true)))
    rows = df.where(F.col(p_true).isNotNull() & F.col(y).isNotNull()).select(F.col(y).cast("string").alias("label"), p.alias("p"), hit.cast("double").alias("h"))
    return rows.rollup("label").agg(F.count("*").alias("n"), F.avg(-F.log("p")).alias("log_loss"), F.avg(F.pow(1 - F.col("p"), 2)).alias("brier"), F.avg("h").alias("acc"))


def brier(df: DataFrame, keys: Sequence[str], risk: str, wrong: Column) -> DataFrame:
    """Per ``keys``: ``brier`` of a risk, cut to [0, 1], against being wrong; non-finite risks are left out."""
    ok = F.col(risk).isNotNull() & ~F.isnan(risk) & (F.abs(F.col(risk)) < float("inf"))
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(risk)))
    return df.where(ok).groupBy(*keys).agg(F.avg(F.pow(r - wrong.cast("double"), 2)).alias("brier"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a rate, within [0, 1]; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / d), F.least(F.lit(1.0), (mid + half) / d)


def uniform_bin(x: Column, bins: Column | int) -> Column:
    """Half-open bin of x in [0, 1], the last one closed, with edges at multiples of 1/bins as a float grid has them."""
    b = F.lit(bins).cast("double") if isinstance(bins, int) else bins.cast("double")
    step, k = 1.0 / b, F.floor(x * b)
    k = F.when(x < k * step, k - 1).when(x >= (k + 1) * step, k + 1).otherwise(k)
    return F.greatest(F.lit(0), F.least(k, b - 1)).cast("int")


def reliability(df: DataFrame, keys: Sequence[str], p: str, wrong: Column, bins: int = 10) -> DataFrame:
    """Per ``keys`` and uniform bin of the predicted risk: counts, rates and Wilson bounds; empty bins are left out."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p)).select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p))).alias("_p"), wrong.cast("long").alias("_w"))
    g = rows.groupBy(*keys, uniform_bin(F.col("_p"), bins).alias("bin")).agg(F.count("*").alias("count"), F.sum("_w").alias("error_count"), F.avg("_p").alias("p_pred_mean"))
    low, high = wilson(F.col("error_count"), F.col("count"))
    left, right = F.col("bin") * (1.0 / bins), (F.col("bin") + 1) * (1.0 / bins)
    return g.select(
        *keys, "bin", left.alias("bin_left"), right.alias("bin_right"), ((left + right) / 2).alias("bin_center"), "count", "error_count",
        (F.col("error_count") / F.col("count")).alias("error_rate"), "p_pred_mean", low.alias("wilson_low"), high.alias("wilson_high"),
    )


def calibration_error(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys``: ``ece`` of a reliability table."""
    return table.groupBy(*keys).agg((F.sum(F.col("count") * F.abs(F.col("error_rate") - F.col("p_pred_mean"))) / F.sum("count")).alias("ece"))


def drift_rate(df: DataFrame, proba: str, pred: str) -> DataFrame:
    """``drift``: share of rows whose most probable class (first of equals) isn't the prediction."""
    top = F.array_position(F.col(proba), F.array_max(proba)) - 1
    return df.agg(F.avg((top != F.col(pred)).cast("double")).alias("drift"))


def threshold_accuracies(df: DataFrame, keys: Sequence[str], confidence: str, hit: Column, steps: int = 50) -> DataFrame:
    """Per ``keys`` and threshold: accuracy of the rows at or above it. One pass counts rows by step, sums run over the steps."""
    keys = list(keys)
    rows = df.where(F.col(confidence).between(0.0, 1.0)).select(*keys, F.least(F.floor(F.col(confidence) * steps), F.lit(steps)).alias("step"), hit.cast("long").alias("h"))
    g = rows.groupBy(*keys, "step").agg(F.count("*").alias("c"), F.sum("h").alias("h"))
    w = W.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)  # at most steps + 1 rows
    return g.select(*keys, (F.col("step") / steps).alias("threshold"), F.sum("c").over(w).alias("n"), (F.sum("h").over(w) / F.sum("c").over(w)).alias("acc"))
