"""Ensembles of models by their expected error at each sample.

``stack``: one row a sample and model: ``row_id``, ``model``, ``acc`` (out-of-fold accuracy), ``aer``
(expected error here) and ``proba`` (array of class probabilities). A sample's models, bounded in
number, are gathered into one array; a strategy is an expression over it, so all of a strategy runs
in one stage after one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ranks import quantiles

NEGATIVE = float("-inf")


def gather(stack: DataFrame) -> DataFrame:
    """``row_id``, ``models``: the sample's models ordered by expected error, then accuracy (best first), then name."""
    acc = F.when(F.col("acc").isNull() | F.isnan("acc") | (F.abs(F.col("acc")) == float("inf")), NEGATIVE).otherwise(F.col("acc"))
    m = F.struct("aer", (-acc).alias("neg_acc"), "model", "proba")
    return stack.groupBy("row_id").agg(F.array_sort(F.collect_list(m)).alias("models"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _clipped_acc(m: Column) -> Column:
    a = -m["neg_acc"]
    return F.when(a == NEGATIVE, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))


def _weighted(models: Column, weight: Callable[[Column], Column]) -> Column:
    """Struct of the weighted mean probabilities and the weighted mean expected error; equal weights if they sum to nothing."""
    raw = F.transform(models, weight)
    total = _sum(raw)
    w = F.transform(raw, lambda v: F.when(total > 0, v / total).otherwise(1.0 / F.size(models)))
    pairs = F.arrays_zip(w.alias("w"), models.alias("m"))
    zero = F.transform(models[0]["proba"], lambda _: F.lit(0.0))
    proba = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["m"]["proba"], lambda a, b: a + p["w"] * b))
    r = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * p["m"]["aer"])
    return F.struct(proba.alias("proba"), r.alias("r_star"))


def _single(m: Column) -> Column:
    return F.struct(m["proba"].alias("proba"), m["aer"].alias("r_star"))


def _exp(beta: float) -> Callable[[Column], Column]:
    return lambda m: F.exp(-beta * F.greatest(F.lit(1e-9), F.least(F.lit(1.0), m["aer"])))


def _best(models: Column, score: Callable[[Column], Column]) -> Column:
    """The model of the highest score, the first in the sample's order among those within 1e-12 of it."""
    finite = lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    top = F.array_max(F.transform(models, score))
    good = F.filter(models, lambda m: finite(score(m)) & (F.abs(score(m) - top) <= 1e-12))
    return _single(F.coalesce(F.get(good, F.lit(0)), models[0]))


def min_aer(rows: DataFrame, **_) -> Column:
    return _single(F.col("models")[0])


def topn(rows: DataFrame, top_n: int = 3, **_) -> Column:
    return _weighted(F.slice("models", 1, max(1, top_n)), lambda m: F.lit(1.0))


def acc_minus_aer(rows: DataFrame, **_) -> Column:
    return _best(F.col("models"), lambda m: -m["neg_acc"] - m["aer"])


def exp_weighted(rows: DataFrame, beta: float = 5.0, **_) -> Column:
    return _weighted(F.col("models"), _exp(beta))


def dynamic_threshold(rows: DataFrame, tau0: float = 0.3, easy: float = 0.8, hard: float = 1.5, fit: DataFrame | None = None, **_) -> Column:
    """Easy and hard samples are told apart by the quartiles of the mean expected error over ``fit`` (the rows themselves by default)."""
    mean = lambda m: _sum(F.transform(m, lambda x: x["aer"])) / F.size(m)
    means = (fit if fit is not None else rows).select(mean(F.col("models")).alias("e"))
    q = quantiles(means, [], "e", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).first()
    if q is None or q["p25"] is None:
        return min_aer(rows)
    base = tau0 if tau0 > 0 else q["p50"]
    here = mean(F.col("models"))
    limit = F.when(here < q["p25"], base * easy).when(here > q["p75"], base * hard).otherwise(base)
    some = F.filter("models", lambda m: m["aer"] <= limit)
    return _weighted(F.when(F.size(some) > 0, some).otherwise(F.col("models")), lambda m: F.lit(1.0))


def overconfidence_penalty(rows: DataFrame, lam: float = 0.5, **_) -> Column:
    return _best(F.col("models"), lambda m: _clipped_acc(m) - lam * m["aer"])


def calibration_aware(rows: DataFrame, alpha: float = 0.7, **_) -> Column:
    return _best(F.col("models"), lambda m: alpha * _clipped_acc(m) - (1.0 - alpha) * m["aer"])


def trimmed_weighted(rows: DataFrame, trim_q: float = 0.6, beta: float = 5.0, **_) -> Column:
    a = F.transform("models", lambda m: m["aer"])  # sorted already
    at = F.lit(min(max(trim_q, 0.0), 1.0)) * (F.size("models") - 1)
    low = F.floor(at).cast("int")
    cut = F.get(a, low) + (F.get(a, F.least(low + 1, F.size("models") - 1)) - F.get(a, low)) * (at - low)
    return _weighted(F.filter("models", lambda m: m["aer"] <= cut), _exp(beta))


def borda_rank(rows: DataFrame, beta: float = 5.0, **_) -> Column:
    """Each model gives its classes points by their order (the first of equals more), weighted by its expected error."""

    def points(m: Column) -> Column:
        p, n = m["proba"], F.size(m["proba"])
        before = lambda v, i: F.size(F.filter(F.transform(p, lambda w, j: F.struct((w > v).alias("g"), ((w == v) & (j < i)).alias("t"))), lambda s: s["g"] | s["t"]))
        return F.transform(p, lambda v, i: (n - before(v, i)).cast("double"))

    ranked = F.transform("models", lambda m: F.struct(m["aer"].alias("aer"), m["neg_acc"].alias("neg_acc"), m["model"].alias("model"), points(m).alias("proba")))
    out = _weighted(ranked, _exp(beta))
    total = _sum(out["proba"])
    return F.struct(F.transform(out["proba"], lambda v: v / total).alias("proba"), out["r_star"].alias("r_star"))


def switching_hybrid(rows: DataFrame, tau_low: float = 0.15, tau_high: float = 0.35, top_n: int = 3, beta: float = 5.0, **_) -> Column:
    low, high = sorted((tau_low, tau_high))
    least = F.col("models")[0]["aer"]
    few = _weighted(F.slice("models", 1, max(1, top_n)), _exp(beta))
    many = _weighted(F.col("models"), lambda m: _clipped_acc(m) * _exp(beta)(m))
    return F.when(least <= low, min_aer(rows)).when(least <= high, few).otherwise(many)


STRATEGIES: dict[str, Callable[..., Column]] = {
    f"strategy{i}_{f.__name__}": f
    for i, f in enumerate((min_aer, topn, acc_minus_aer, exp_weighted, dynamic_threshold, overconfidence_penalty, calibration_aware, trimmed_weighted, borda_rank, switching_hybrid), 1)
}


def ensemble(stack: DataFrame, strategy: str, **options) -> DataFrame:
    """``row_id``, ``proba``, ``y_pred`` (first of the most probable classes), ``r_star`` (the ensemble's expected error).

    Samples keep whatever models they have. Raises for an unknown strategy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    rows = gather(stack)
    out = rows.select("row_id", STRATEGIES[strategy](rows, **options).alias("e"))
    return out.select("row_id", "e.proba", (F.array_position("e.proba", F.array_max("e.proba")) - 1).cast("int").alias("y_pred"), "e.r_star")


def check_stack(stack: DataFrame) -> DataFrame:
    """Samples that lack a model others have, or have one twice: ``row_id``, ``n_models``, ``n_distinct``; empty if the stack is sound."""
    n = stack.select("model").distinct().agg(F.count("*").alias("expected"))
    per = stack.groupBy("row_id").agg(F.count("*").alias("n_models"), F.count_distinct("model").alias("n_distinct")).crossJoin(n)  # one row
    return per.where("n_models <> expected OR n_distinct <> expected").drop("expected")
