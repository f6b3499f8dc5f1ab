"""Adaptive error: from the confidence of a prediction to its expected error, coverage and risk control.

All operators work on many sources (models) at once: fitting bins is one aggregate over all rows,
what follows runs on at most some twenty bins a source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.durable import Stage
from gridloom.functions.ranks import hash_order, quantiles, running_sums, value_counts
from gridloom.functions.tails import beta_inc, clopper_pearson_upper
from gridloom.operators.score import uniform_bin, wilson


def merge_bins(edges: Sequence[float], counts: Sequence[int], errors: Sequence[int], least: int) -> tuple[list[float], list[int], list[int]]:
    """Neighbouring bins joined so that each holds ``least`` rows; what is left over on the right goes to the last.

    On the running totals: a cut lies where the total has grown by ``least`` since the cut before.
    """
    rows, wrong = (np.r_[0, np.cumsum(np.asarray(v, np.int64))] for v in (counts, errors))
    cuts, end = [0], len(rows) - 1
    while (at := int(np.searchsorted(rows, rows[cuts[-1]] + least))) <= end:
        cuts.append(at)
    cuts = [*cuts[: max(1, len(cuts) - 1)], end]
    return [edges[i] for i in cuts], np.diff(rows[cuts]).tolist(), np.diff(wrong[cuts]).tolist()


def decreasing(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression, non-increasing, by pooling neighbours."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([float(v), float(w), 1])
        while len(pools) > 1 and pools[-2][0] < pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            mean = (a[0] * a[1] + b[0] * b[1]) / total if total else (a[0] + b[0]) / 2
            pools.append([mean, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fit_bins(
    df: DataFrame, keys: Sequence[str], confidence: str, wrong: Column, n_bins: int = 20, min_count: int = 10, smooth: bool = True,
    monotonic: bool = False, prior: float = 2.0, adaptive: bool = False,
) -> DataFrame:
    """The expected error of each confidence bin of each source.

    Confidences are cut to [0, 1]; null and NaN are left out. Bins are uniform, fewer for few rows
    or little spread; ``adaptive`` puts their edges at quantiles. Bins with fewer than ``min_count``
    rows are merged. The error of a bin is drawn to the source's by a prior of ``prior`` rows, then
    averaged with its neighbours by rows (``smooth``), then made to fall with confidence
    (``monotonic``). Returns ``keys``, ``bin``, ``bin_left``, ``bin_right``, ``bin_center``, ``count``,
    ``error_count``, ``raw_error``, ``expected_error``, ``wilson_low``, ``wilson_high``.
    """
    keys = list(keys)
    rows = df.where(F.col(confidence).isNotNull() & ~F.isnan(confidence)).select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence))).alias("c"), wrong.cast("int").alias("w"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("c").alias("sd"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("w").alias("e"))
    b = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.floor(F.col("n") / min_count)))
    if not adaptive:
        b = F.when((F.col("sd") < 0.05) | (F.col("n") < 100), F.least(F.lit(5), b)).when(F.col("n") < 500, F.least(F.lit(10), b)).when(F.col("n") < 1000, F.least(F.lit(15), b)).otherwise(b)
    stats = stats.withColumn("b", F.when(F.col("hi") - F.col("lo") < 1e-6, F.lit(1)).otherwise(b).cast("int"))
    if adaptive:
        q = quantiles(rows.select(*keys, "c"), keys, "c", {f"q{i}": i / n_bins for i in range(1, n_bins)})
        inner = F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(1, n_bins)]))
        inner = F.filter(inner, lambda v: (v > 0) & (v < 1))
        stats = (stats.join(q, keys) if keys else stats.crossJoin(q)).withColumn("inner", F.when(F.col("b") > 1, inner).otherwise(F.array().cast("array<double>")))
    else:
        stats = stats.withColumn("inner", F.transform(F.sequence(F.lit(1), F.col("b")), lambda i: i / F.col("b").cast("double")))
        stats = stats.withColumn("inner", F.slice("inner", F.lit(1), F.col("b") - 1))
    stats = stats.select(*keys, "n", "e", "b", "inner")
    placed = rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))  # one row
    at = F.aggregate("inner", F.lit(0), lambda a, v: a + (v <= F.col("c")).cast("int")) if adaptive else uniform_bin(F.col("c"), F.col("b"))
    counts = placed.groupBy(*keys, at.alias("i")).agg(F.count("*").alias("count"), F.sum("w").alias("errors"))
    counts = counts.join(stats, keys) if keys else counts.crossJoin(F.broadcast(stats))  # one row

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        if adaptive:
            edges = [0.0, *map(float, first["inner"]), 1.0]
        else:
            edges = [i * (1.0 / int(first["b"])) for i in range(int(first["b"]))] + [1.0]
        c, e = np.zeros(len(edges) - 1, int), np.zeros(len(edges) - 1, int)
        c[pdf["i"]], e[pdf["i"]] = pdf["count"], pdf["errors"]
        edges, c, e = merge_bins(edges, c, e, max(1, min_count))
        c, e = np.array(c, float), np.array(e, float)
        overall = first["e"] / first["n"]
        with np.errstate(all="ignore"):
            raw = np.where(c > 0, e / c, np.nan)
        mean = min(max(overall, 1e-6), 1 - 1e-6)
        expected = np.where(c > 0, (e + prior * mean) / (c + prior) if prior > 0 else raw, overall)
        if smooth and len(c) >= 3:
            before = expected.copy()
            for i in range(len(c)):
                s = slice(max(0, i - 1), i + 2)
                expected[i] = np.average(before[s], weights=c[s]) if c[s].sum() > 0 else before[s].mean()
        if monotonic and len(c) >= 2:
            expected = decreasing(expected, c)
        edges = np.array(edges)
        out = pd.DataFrame({
            "bin": np.arange(len(c), dtype=np.int32), "bin_left": edges[:-1], "bin_right": edges[1:], "bin_center": (edges[:-1] + edges[1:]) / 2,
            "count": c.astype(np.int64), "error_count": e.astype(np.int64), "raw_error": raw, "expected_error": np.clip(expected, 0, 1),
        })
        for k in reversed(keys):
            out.insert(0, k, first[k])
        return out

    kinds = {f.name: f for f in counts.schema}
    fields = [kinds[k] for k in keys] + [T.StructField("bin", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("bin_left", "bin_right", "bin_center")]
    fields += [T.StructField(c, T.LongType()) for c in ("count", "error_count")] + [T.StructField(c, T.DoubleType()) for c in ("raw_error", "expected_error")]
    table = (counts.groupBy(*keys) if keys else counts.groupBy(F.lit(0))).applyInPandas(bins, T.StructType(fields))
    low, high = wilson(F.col("error_count"), F.col("count"))
    return table.withColumns({"wilson_low": low, "wilson_high": high})


def expected_error(df: DataFrame, keys: Sequence[str], confidence: str, bins: DataFrame, name: str = "aer") -> DataFrame:
    """Each row's expected error from its source's bins; a missing or non-finite confidence gets the source's overall error.

    The bins of a source travel as one array, so the join adds no rows. A source without bins gets null.
    """
    keys = list(keys)
    packed = bins.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin_left", "expected_error"))).alias("_bins"), (F.sum("error_count") / F.sum("count")).alias("_overall")
    )  # at most some twenty bins each
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    hit = F.aggregate("_bins", F.col("_bins")[0]["expected_error"], lambda a, b: F.when(b["bin_left"] <= c, b["expected_error"]).otherwise(a))
    finite = F.col(confidence).isNotNull() & ~F.isnan(confidence) & (F.abs(F.col(confidence)) < float("inf"))
    joined = df.join(packed, keys, "left") if keys else df.crossJoin(F.broadcast(packed))  # one row
    return joined.withColumn(name, F.when(finite, hit).otherwise(F.col("_overall"))).drop("_bins", "_overall")


def error_bins(df: DataFrame, keys: Sequence[str], confidence: str, expected: str, wrong: Column, bins: int = 10) -> DataFrame:
    """Per uniform confidence bin, empty ones included: rows, errors, error rate and mean expected error."""
    keys = list(keys)
    rows = df.where(F.col(confidence).between(0.0, 1.0))
    g = rows.groupBy(*keys, uniform_bin(F.col(confidence), bins).alias("bin")).agg(F.count("*").alias("count"), F.sum(wrong.cast("long")).alias("error_count"), F.avg(expected).alias("mean_expected"))
    every = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(g, [*keys, "bin"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count", "error_count")})
    return out.withColumn("error_rate", F.when(F.col("count") > 0, F.col("error_count") / F.col("count")))


def coverage_curve(df: DataFrame, keys: Sequence[str], risk: str, id_col: str, right: Column) -> DataFrame:
    """Every row in order of risk: ``coverage``, ``selective_accuracy``, ``threshold``, ``n_accepted``. Equal risks go by identifier."""
    keys = list(keys)
    rows = df.where(F.col(risk).isNotNull() & ~F.isnan(risk) & (F.abs(F.col(risk)) < float("inf")))
    rows = rows.select(*keys, F.col(id_col).alias("_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(risk))).alias("threshold"), right.cast("long").alias("_r"))
    c = running_sums(rows, keys, "threshold", "_id", {"good": F.col("_r")})
    return c.select(*keys, F.col("_id").alias(id_col), (F.col("i") / F.col("n")).alias("coverage"), (F.col("good") / F.col("i")).alias("selective_accuracy"), "threshold", F.col("i").alias("n_accepted"))


def curve_area(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``auc_coverage_accuracy``: area under accuracy over coverage by trapezoids, from coverage 0 at the first row's accuracy.

    A row's left neighbour is joined by its place, so no window spans a source.
    """
    keys = list(keys)
    left = curve.select(*keys, (F.col("n_accepted") + 1).alias("n_accepted"), F.col("coverage").alias("_c"), F.col("selective_accuracy").alias("_a"))
    j = curve.join(left, [*keys, "n_accepted"], "left")
    step = (F.col("coverage") - F.coalesce("_c", F.lit(0.0))) * (F.col("selective_accuracy") + F.coalesce("_a", "selective_accuracy")) / 2
    return j.groupBy(*keys).agg(F.sum(step).alias("auc_coverage_accuracy"))


def at_coverage(curve: DataFrame, keys: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """The curve's row nearest to each target coverage, the smaller one of two."""
    per = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_coverage")
    c = curve.select("*", per)
    best = F.min(F.struct(F.abs(F.col("coverage") - F.col("target_coverage")).alias("d"), "coverage", "selective_accuracy", "threshold", "n_accepted")).alias("m")
    return c.groupBy(*keys, "target_coverage").agg(best).select(*keys, "target_coverage", "m.coverage", "m.selective_accuracy", "m.threshold", "m.n_accepted")


def at_accuracy(curve: DataFrame, keys: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """The row of largest coverage that reaches each target accuracy (``ok``), else the most accurate one (``below_target``)."""
    per = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_accuracy")
    row = ("coverage", "selective_accuracy", "threshold", "n_accepted")
    c = curve.select("*", per)
    good = F.max(F.when(F.col("selective_accuracy") >= F.col("target_accuracy"), F.struct(*row))).alias("g")
    best = F.max(F.struct("selective_accuracy", "coverage", "threshold", "n_accepted")).alias("b")
    out = c.groupBy(*keys, "target_accuracy").agg(good, best)
    return out.select(*keys, "target_accuracy", *[F.coalesce(F.col(f"g.{x}"), F.col(f"b.{x}")).alias(x) for x in row], F.when(F.col("g").isNotNull(), F.lit("ok")).otherwise("below_target").alias("status"))


def risk_threshold(df: DataFrame, keys: Sequence[str], risk: str, wrong: Column, target: float, alpha: float = 0.05, least: int = 1) -> DataFrame:
    """The largest risk threshold whose error is at most ``target`` with confidence 1 - ``alpha``, per source.

    Each distinct risk is a candidate; the Clopper-Pearson bound is corrected for their number.
    Sources without one have nulls and ``status`` ``none``.
    """
    keys = list(keys)
    rows = df.where(F.col(risk).isNotNull() & ~F.isnan(risk) & (F.abs(F.col(risk)) < float("inf"))).withColumn("_w", wrong.cast("long"))
    steps = Stage(df.sparkSession, "risk").write(value_counts(rows, keys, risk, {"e": F.col("_w")}))
    m = steps.groupBy(*keys).agg(F.count("*").alias("bonferroni_m"), F.max("cum").alias("n_total"))
    j = steps.join(m, keys) if keys else steps.crossJoin(F.broadcast(m))  # one row

    @F.pandas_udf(T.BooleanType())
    def holds(k: pd.Series, n: pd.Series, a: pd.Series) -> pd.Series:
        k, n, a = (v.to_numpy(float) for v in (k, n, a))
        # The bound is at most the target where the beta distribution has 1 - a of its mass below the target.
        ok = (k < n) & (target < 1)
        out = np.full(len(k), target >= 1)
        out[ok] = beta_inc(k[ok] + 1, n[ok] - k[ok], np.full(ok.sum(), target)) >= 1 - a[ok]
        return pd.Series(out)

    @F.pandas_udf(T.DoubleType())
    def bound(k: pd.Series, n: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(clopper_pearson_upper(*(v.to_numpy(float) for v in (k, n, a))))

    share = F.lit(float(alpha)) / F.col("bonferroni_m")
    top = j.where((F.col("cum") >= least) & holds("cum_e", "cum", share)).groupBy(*keys).agg(F.max(F.struct(F.col(risk).alias("t"), F.col("cum").alias("n"), F.col("cum_e").alias("k"), share.alias("a"))).alias("s"))
    top = top.select(*keys, "s", bound("s.k", "s.n", "s.a").alias("upper"))  # a row a source
    out = m.join(top, keys, "left") if keys else m.join(top, F.lit(True), "left")
    s = F.col("s")
    return out.select(
        *keys, s["t"].alias("t_star"), s["n"].alias("oof_n"), s["k"].alias("oof_k"), (s["k"] / s["n"]).alias("oof_error_rate"), F.col("upper").alias("oof_cp_upper"),
        (s["n"] / F.col("n_total")).alias("oof_coverage"), "bonferroni_m", F.when(s.isNull(), F.lit("none")).otherwise("ok").alias("status"),
    )


def crossfit_risk(df: DataFrame, keys: Sequence[str], id_col: str, confidence: str, wrong: Column, folds: int = 5, seed: int = 69, **options) -> DataFrame:
    """``id_col`` and ``aer`` of each row from bins fitted on the other folds only; rows fall into folds by hash.

    All folds are fitted at once: each row trains every fold but its own.
    """
    keys = list(keys)
    fold = (F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("long") % folds).cast("int")
    rows = df.select(*keys, F.col(id_col), F.col(confidence).alias("_c"), wrong.cast("int").alias("_w"), fold.alias("_fold"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("_fold")))
    train = rows.select(*keys, "_c", "_w", others.alias("fold"))
    bins = fit_bins(train, [*keys, "fold"], "_c", F.col("_w"), **options)
    return expected_error(rows.withColumnRenamed("_fold", "fold"), [*keys, "fold"], "_c", bins).select(*keys, id_col, "fold", "aer")


def fit_transform_confidence(df: DataFrame, keys: Sequence[str], metric: str, how: str, name: str = "confidence") -> DataFrame:
    """A raw metric as a confidence: ``minmax`` between its 1st and 99th percentile, or ``exp_gamma``: exp(-x / median).

    Null stays null. A constant metric gives 0.5 under ``minmax``.
    """
    keys = list(keys)
    q = quantiles(df.select(*keys, F.col(metric).cast("double").alias("_m")), keys, "_m", {"_lo": 0.01, "_mid": 0.5, "_hi": 0.99})
    j = df.join(q, keys, "left") if keys else df.crossJoin(F.broadcast(q))  # one row
    x = F.col(metric)
    if how == "minmax":
        span = F.col("_hi") - F.col("_lo")
        out = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("_lo")) / span))).otherwise(F.when(x.isNotNull(), 0.5))
    else:
        out = F.exp(-x / F.when(F.col("_mid") > 0, F.col("_mid")).otherwise(1.0))
    return j.withColumn(name, out).drop("_lo", "_mid", "_hi")


def normalize_proba(p: Column) -> Column:
    """Class probabilities without negatives, NaN and infinities, summing to 1; equal shares where nothing is left."""
    clean = F.transform(p, lambda v: F.when(v.isNull() | F.isnan(v) | (v == float("inf")) | (v < 0), 0.0).otherwise(v))
    total = F.aggregate(clean, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(clean, lambda v: v / total)).otherwise(F.transform(clean, lambda v: F.lit(1.0) / F.size(p)))


def softmax(s: Column) -> Column:
    top = F.array_max(s)
    e = F.transform(s, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def confidence_metrics(df: DataFrame, proba: str, pred: str | None = None) -> DataFrame:
    """Adds ``p_max``, ``p_2nd``, ``p_margin`` (two classes: twice the distance from a half), and with ``pred`` ``p_pred``, ``p_pred_margin``."""
    p = normalize_proba(F.col(proba))
    s = F.sort_array(p, False)
    top, second = s[0], F.get(s, F.lit(1))
    margin = F.when(F.size(p) == 2, 2 * F.abs(p[0] - 0.5)).otherwise(top - F.coalesce(second, F.lit(0.0)))
    out = {"p_max": top, "p_2nd": second, "p_margin": margin}
    if pred:
        own = F.get(p, F.col(pred))
        rest = F.array_max(F.filter(F.transform(p, lambda v, i: F.when(i != F.col(pred), v)), lambda v: v.isNotNull()))
        out |= {"p_pred": own, "p_pred_margin": own - F.coalesce(rest, F.lit(0.0))}
    return df.withColumns(out)


def fit_temperature(df: DataFrame, logits: str, y: str, steps: int = 25) -> float:
    """The temperature of least log-loss on a logarithmic grid from 0.01 to 100, all tried in one pass."""
    grid = [float(t) for t in np.logspace(-2, 2, steps)]

    def loss(t: float) -> Column:
        p = F.get(softmax(F.transform(F.col(logits), lambda v: v / t)), F.col(y))
        return F.avg(-F.log(F.greatest(F.lit(1e-15), p)))

    losses = [loss(t) for t in grid]
    row = df.where(F.col(logits).isNotNull() & F.col(y).isNotNull()).agg(*losses).first()
    known = [(v, t) for v, t in zip(row, grid) if v is not None]
    return min(known)[1] if known else 1.0


def select_confidence(df: DataFrame, id_col: str, candidates: Sequence[str], wrong: Column, **options) -> DataFrame:
    """Candidates by the Brier score of their cross-fitted expected error, the best first: ``metric``, ``brier``. All are fitted at once."""
    long = df.select(F.col(id_col), wrong.cast("int").alias("_w"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("c")) for c in candidates])).alias("m"))
    long = long.select(id_col, "_w", "m.metric", "m.c").where("c IS NOT NULL AND NOT isnan(c)")
    risk = crossfit_risk(long, ["metric"], id_col, "c", F.col("_w"), **options)
    j = risk.join(long.select(id_col, "metric", "_w"), [id_col, "metric"])
    return j.groupBy("metric").agg(F.avg(F.pow(F.col("aer") - F.col("_w"), 2)).alias("brier")).orderBy("brier", "metric")


def best_per_model(df: DataFrame, model: str, score: str, id_col: str, higher: bool = True, top_k: int | None = None, skip: Sequence[str] = ("dummy",)) -> DataFrame:
    """Each model's best result, finite scores first, then the ``top_k`` best models. Ties go to the smaller identifier.

    Partial maxima are taken before the shuffle, so a model with a third of the rows costs nothing extra.
    """
    x = F.col(score)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    key = F.struct(F.when(finite, 0).otherwise(1).alias("f"), F.when(finite, -x if higher else x).alias("s"), F.col(id_col).alias("id"))
    best = df.where(~F.col(model).isin(*skip) & F.col(model).isNotNull()).groupBy(model).agg(F.min(key).alias("m"))
    best = best.select(model, F.col("m.id").alias(id_col), (-F.col("m.s") if higher else F.col("m.s")).alias(score))
    return best.orderBy(F.desc_nulls_last(score) if higher else F.asc_nulls_last(score), id_col).limit(top_k) if top_k else best
