"""Associations of features with a target.

Rank statistics come from counted values (``functions.ranks``), moments from one grouped
aggregate, contingency statistics from counted pairs; no statistic needs a feature in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import tails
from gridloom.functions.durable import Stage
from gridloom.functions.ranks import previous, running_sums, value_counts
from gridloom.operators.shape import melt

# What each statistic means to selection.
HIGHER_IS_BETTER = {
    "t": True, "U": True, "W": True, "cohen_d": True, "AUROC": True, "corr": True, "mut_info": True,
    "pearson_r": True, "spearman_r": True, "F": True, "H": True, "cramer_v": True,
}
P_VALUE = {"t": "t_p", "U": "U_p", "W": "W_p", "corr": "corr_p", "pearson_r": "pearson_p", "spearman_r": "spearman_p", "F": "F_p", "H": "H_p"}
DEFAULT = {("cont", "class"): "mut_info", ("cat", "class"): "mut_info", ("cont", "reg"): "F", ("cat", "reg"): "H"}


#: Classes up to which each gets a column of counters.
COUNTED = 64
#: Classes that are each held against all others by nearest neighbours; more are an error.
MOST_CLASSES = 10_000


def _levels(df: DataFrame, target: str) -> list[str] | None:
    """Classes of the target, or None if they are more than ``COUNTED``."""
    found = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string")).distinct().limit(COUNTED + 1).collect()
    return sorted(str(r[0]) for r in found) if len(found) <= COUNTED else None


def _pearson_t(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r))).otherwise(F.signum(r) * F.lit(float("inf")))


def cont_class_moments(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per ``feature`` and ``level``: Welch ``t`` and its ``df``, ``cohen_d``, point-biserial ``corr``, ``n0``, ``n1``.

    Group 1 holds the rows of the level, group 0 all others. Rows without a value or target are left
    out of a feature. A constant feature has null statistics.
    """
    long = melt(df, columns, {"y": F.col(target).cast("string")}).where("x IS NOT NULL AND y IS NOT NULL")
    g = long.groupBy("feature", F.col("y").alias("level")).agg(F.count("*").alias("n1"), F.avg("x").alias("m1"), F.coalesce(F.var_pop("x") * F.count("*"), F.lit(0.0)).alias("q1"))
    w = W.partitionBy("feature")  # a row a class
    g = g.withColumns({"n": F.sum("n1").over(w), "mean": F.sum(F.col("n1") * F.col("m1")).over(w) / F.sum("n1").over(w)})
    g = g.withColumn("q", F.sum(F.col("q1") + F.col("n1") * F.pow(F.col("m1") - F.col("mean"), 2)).over(w))
    g = g.withColumn("n0", F.col("n") - F.col("n1"))
    n0, n1, n = (F.col(c).cast("double") for c in ("n0", "n1", "n"))
    g = g.withColumn("m0", F.when(F.col("n0") > 0, (F.col("mean") * n - F.col("m1") * n1) / n0))
    g = g.withColumn("q0", F.greatest(F.lit(0.0), F.col("q") - F.col("q1") - n0 * n1 / n * F.pow(F.col("m1") - F.col("m0"), 2)))
    v0, v1 = F.when(n0 > 1, F.col("q0") / (n0 - 1)) / n0, F.when(n1 > 1, F.col("q1") / (n1 - 1)) / n1
    t = F.when(v0 + v1 > 0, (F.col("m0") - F.col("m1")) / F.sqrt(v0 + v1))
    dof = F.when(v0 + v1 > 0, F.pow(v0 + v1, 2) / (v0 * v0 / (n0 - 1) + v1 * v1 / (n1 - 1)))
    pooled = F.sqrt((F.col("q0") + F.col("q1")) / (n - 2))
    return g.select(
        "feature", "level", "n0", "n1", t.alias("t"), dof.alias("t_df"), F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).alias("cohen_d"),
        F.when((F.col("q") > 0) & (n0 > 0), (F.col("m1") - F.col("m0")) * F.sqrt(n0 * n1 / n) / F.sqrt(F.col("q"))).alias("corr"),
    )


def _sums_by_counters(long: DataFrame, levels: list[str]) -> DataFrame:
    """Sums over ranks of each class and of all others: with a class's row its ``d1`` is the others' rows below it, ties half, and the other way round ``d0``."""
    counters = {f"l{i}": (F.col("y") == v).cast("long") for i, v in enumerate(levels)}
    ranked = value_counts(long, ["feature"], "x", counters)
    per = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"l{i}").alias("k1"), F.col(f"cum_l{i}").alias("c1")) for i, v in enumerate(levels)]))
    rows = ranked.select("feature", F.col("n").alias("k"), "cum", F.col("avg_rank").alias("r"), per.alias("p")).select("feature", "k", "cum", "r", "p.*")
    k0, c0 = F.col("k") - F.col("k1"), F.col("cum") - F.col("c1")
    d1, d0 = c0 - k0 / 2, F.col("c1") - F.col("k1") / 2
    k, k1 = F.col("k").cast("double"), F.col("k1").cast("double")
    return rows.groupBy("feature", "level").agg(
        F.sum(k1).alias("n1"), F.sum(k0.cast("double")).alias("n0"), F.sum(k1 * F.col("r")).alias("R1"), F.sum(k0 * F.col("r")).alias("R0"),
        F.sum(k * k * k - k).alias("T"), F.sum(k1 * d1).alias("D1"), F.sum(k1 * d1 * d1).alias("DD1"), F.sum(k0 * d0).alias("D0"), F.sum(k0 * d0 * d0).alias("DD0"),
    )


def _sums_by_class(long: DataFrame) -> DataFrame:
    """The sums of ``_sums_by_counters`` for any number of classes, from a row for each class and value that occur together.

    Between two neighbouring values of a class the others' ``d0`` doesn't change, so their rows there need
    only be counted.
    """
    every = value_counts(long, ["feature"], "x").select("feature", "x", F.col("n").alias("k"), "cum", F.col("avg_rank").alias("r"), F.col("total").alias("n"))
    tied = every.groupBy("feature").agg(F.sum(F.pow(F.col("k").cast("double"), 3) - F.col("k")).alias("T"))
    own = value_counts(long, ["feature", "y"], "x").select("feature", F.col("y").alias("level"), "x", F.col("n").alias("k1"), F.col("cum").alias("c1"), F.col("total").alias("n1"))
    j = own.join(every, ["feature", "x"])
    k0, c0 = F.col("k") - F.col("k1"), F.col("cum") - F.col("c1")
    j = j.withColumns({"k0": k0.cast("double"), "c0": c0.cast("double"), "below": (c0 - k0).cast("double")})
    j = previous(j, ["feature", "level"], ["c0", "x"], "c0_before")
    k1, d1, d0 = F.col("k1").cast("double"), F.col("c0") - F.col("k0") / 2, F.col("c1") - F.col("k1") / 2
    # The others' rows between the value before and this one lie above all the class's rows up to there.
    gap, up = F.col("below") - F.coalesce("c0_before", F.lit(0.0)), (F.col("c1") - F.col("k1")).cast("double")
    s = j.groupBy("feature", "level").agg(
        F.first(F.col("n1").cast("double")).alias("n1"), F.first((F.col("n") - F.col("n1")).cast("double")).alias("n0"), F.first(F.col("n").cast("double")).alias("n"), F.sum(k1 * F.col("r")).alias("R1"),
        F.sum(k1 * d1).alias("D1"), F.sum(k1 * d1 * d1).alias("DD1"), F.sum(F.col("k0") * d0 + gap * up).alias("D0"), F.sum(F.col("k0") * d0 * d0 + gap * up * up).alias("DD0"), F.max("c0").alias("last"),
    )
    rest = F.col("n0") - F.col("last")  # above the class's highest value
    s = s.withColumns({"D0": F.col("D0") + rest * F.col("n1"), "DD0": F.col("DD0") + rest * F.col("n1") * F.col("n1"), "R0": F.col("n") * (F.col("n") + 1) / 2 - F.col("R1")})
    return s.join(tied, "feature").drop("n", "last")


def cont_class_ranks(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per ``feature`` and ``level``: Mann-Whitney ``U`` of group 0 with ``U_z``, Brunner-Munzel ``W``, ``AUROC`` (at least a half).

    Few classes are columns of counters, and a row of the counted table is a distinct value of a
    feature; with more classes each class's values are counted by themselves and meet those of all rows.
    """
    levels = _levels(df, target)
    long = melt(df, columns, {"y": F.col(target).cast("string")}).where("x IS NOT NULL AND y IS NOT NULL")
    agg = _sums_by_counters(long, levels) if levels is not None else _sums_by_class(long)
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u0 = F.col("R0") - n0 * (n0 + 1) / 2
    sigma = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("T") / (n * (n - 1))))
    z = F.when(sigma > 0, (F.greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / sigma)
    s0, s1 = (F.col("DD0") - F.col("D0") * F.col("D0") / n0) / (n0 - 1), (F.col("DD1") - F.col("D1") * F.col("D1") / n1) / (n1 - 1)
    spread = n0 * s0 + n1 * s1
    bm = F.when(spread > 0, n0 * n1 * (F.col("R1") / n1 - F.col("R0") / n0) / (n * F.sqrt(spread)))
    auc = (F.col("R1") - n1 * (n1 + 1) / 2) / (n0 * n1)
    both = (n0 > 0) & (n1 > 0)
    return agg.select("feature", "level", F.when(both, u0).alias("U"), F.when(both, z).alias("U_z"), F.when(both, bm).alias("W"), F.when(both, 0.5 + F.abs(0.5 - auc)).alias("AUROC"))


def cont_class(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """All statistics of continuous features against the levels of a class target, with p-values but without mutual information."""
    m, r = cont_class_moments(df, columns, target), cont_class_ranks(df, columns, target)
    j = m.join(r, ["feature", "level"])
    n = (F.col("n0") + F.col("n1")).cast("double")
    return j.select(
        "feature", "level", "t", tails.t_two_sided("t", "t_df").alias("t_p"), "U", tails.normal_two_sided(F.greatest("U_z", F.lit(0.0))).alias("U_p"),
        "W", tails.normal_two_sided("W").alias("W_p"), "cohen_d", "AUROC", "corr", tails.t_two_sided(_pearson_t(F.col("corr"), n), n - 2).alias("corr_p"),
    )


def pearson(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``feature``, ``n``, ``pearson_r``, ``F``: linear association with a numeric target, pairwise complete."""
    long = melt(df, columns, {"y": F.col(target).cast("double")}).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    g = long.groupBy("feature").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson_r"))
    r = F.col("pearson_r")
    return g.withColumn("F", r * r / (1 - r * r) * (F.col("n") - 2))


def spearman(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``feature``, ``spearman_r``: Pearson's r of average ranks, pairwise complete.

    Equal pairs are counted first; ranks are joined to the counted pairs by value.
    """
    long = melt(df, columns, {"y": F.col(target).cast("double")}).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    pairs = long.groupBy("feature", "x", "y").agg(F.count("*").alias("k"))
    rx = value_counts(long, ["feature"], "x").select("feature", "x", F.col("avg_rank").alias("rx"))
    ry = value_counts(long, ["feature"], "y").select("feature", "y", F.col("avg_rank").alias("ry"))
    j = pairs.join(rx, ["feature", "x"]).join(ry, ["feature", "y"])
    k, x, y = F.col("k").cast("double"), F.col("rx"), F.col("ry")
    s = j.groupBy("feature").agg(F.sum(k).alias("n"), F.sum(k * x * y).alias("xy"), F.sum(k * x * x).alias("xx"), F.sum(k * y * y).alias("yy"))
    mid = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4
    norm = F.sqrt((F.col("xx") - mid) * (F.col("yy") - mid))
    return s.select("feature", F.when(norm > 0, (F.col("xy") - mid) / norm).alias("spearman_r"))


def cont_cont(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """All statistics of continuous features against a numeric target, with p-values but without mutual information."""
    j = pearson(df, columns, target).join(spearman(df, columns, target), "feature")
    n = F.col("n").cast("double")
    return j.select(
        "feature", "pearson_r", tails.t_two_sided(_pearson_t(F.col("pearson_r"), n), n - 2).alias("pearson_p"),
        "spearman_r", tails.t_two_sided(_pearson_t(F.col("spearman_r"), n), n - 2).alias("spearman_p"), "F", tails.f_upper("F", F.lit(1.0), n - 2).alias("F_p"),
    )


def kruskal(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``feature``, ``H``, ``H_p``: the numeric target's ranks compared over the levels of each categorical feature.

    Missing cells are the level ``nan``.
    """
    long = melt(df, columns, {"y": F.col(target).cast("double")}, cast="string", value="level").where("y IS NOT NULL AND NOT isnan(y)")
    long = long.withColumn("level", F.coalesce("level", F.lit("nan")))
    ry = value_counts(long, ["feature"], "y").select("feature", "y", F.col("avg_rank").alias("r"), F.col("n").cast("double").alias("t"))
    ties = ry.groupBy("feature").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("T"), F.sum("t").alias("N"))
    per = long.groupBy("feature", "level", "y").agg(F.count("*").alias("k")).join(ry, ["feature", "y"])
    per = per.groupBy("feature", "level").agg(F.sum(F.col("k") * F.col("r")).alias("R"), F.sum("k").alias("n"))
    s = per.groupBy("feature").agg(F.sum(F.col("R") * F.col("R") / F.col("n")).alias("S"), F.count("*").alias("k")).join(ties, "feature")
    n = F.col("N")
    h = (12 / (n * (n + 1)) * F.col("S") - 3 * (n + 1)) / F.when(F.col("T") < n * n * n - n, 1 - F.col("T") / (n * n * n - n))
    s = s.withColumn("H", F.when(F.col("k") > 1, h))
    return s.select("feature", "H", tails.chi2_upper("H", (F.col("k") - 1).cast("double")).alias("H_p"))


def contingency(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Counted pairs ``feature``, ``a`` (level, ``nan`` for missing), ``b`` (class), ``o``."""
    long = melt(df, columns, {"b": F.col(target).cast("string")}, cast="string", value="a").where("b IS NOT NULL")
    return long.groupBy("feature", F.coalesce("a", F.lit("nan")).alias("a"), "b").agg(F.count("*").alias("o"))


def _contingency_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cramer's V and mutual information (nats) of counted pairs a, b, o per ``keys``."""
    rows = pairs.groupBy(*keys, "a").agg(F.sum("o").alias("ra"))
    cols = pairs.groupBy(*keys, "b").agg(F.sum("o").alias("cb"))
    dims = rows.groupBy(*keys).agg(F.count("*").alias("r"), F.sum("ra").alias("n")).join(cols.groupBy(*keys).agg(F.count("*").alias("c")), keys)
    j = pairs.join(rows, [*keys, "a"]).join(cols, [*keys, "b"]).join(dims, keys)
    o, ra, cb, n = (F.col(c).cast("double") for c in ("o", "ra", "cb", "n"))
    s = j.groupBy(*keys).agg(F.sum(o * o / (ra * cb)).alias("s"), F.sum(o / n * F.log(o * n / (ra * cb))).alias("mut_info"), F.first("n").alias("n"), F.least(F.first("r"), F.first("c")).alias("d"))
    v = F.when(F.col("d") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / (F.col("d") - 1)))
    return s.select(*keys, v.alias("cramer_v"), F.greatest(F.lit(0.0), F.col("mut_info")).alias("mut_info"))


def cat_class(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``feature``, ``level``, ``cramer_v``, ``mut_info``, ``H``, ``H_p``: each class against all others, and all classes (null level).

    ``H`` compares the class indicator over the feature's levels by ranks; it is 0 where the indicator is constant.
    The two-way counts of a class against all others follow from the counted pairs and their totals;
    levels without a row of the class are added as one, so no pair that doesn't occur is made.
    """
    pairs = contingency(df, columns, target)
    rows = pairs.groupBy("feature", "a").agg(F.sum("o").alias("ra"))
    cols = pairs.groupBy("feature", "b").agg(F.sum("o").alias("cb"))
    dims = rows.groupBy("feature").agg(F.count("*").alias("k"), F.sum("ra").alias("n"))
    j = pairs.join(rows, ["feature", "a"]).join(cols, ["feature", "b"]).join(dims, "feature")
    o, ra, c1, n = (F.col(c).cast("double") for c in ("o", "ra", "cb", "n"))
    c0, other = n - c1, ra - o
    r0, r1 = (c0 + 1) / 2, c0 + (c1 + 1) / 2
    share = lambda x, c: F.when(x > 0, x / n * F.log(x * n / (ra * c))).otherwise(0.0)
    rank_sum = other * r0 + o * r1
    s = j.groupBy("feature", F.col("b").alias("level")).agg(
        F.first(n).alias("n"), F.first(c1).alias("c1"), F.first("k").alias("k"), F.sum(ra).alias("seen"), F.sum(rank_sum * rank_sum / ra).alias("ranks"),
        F.sum(o * o / (ra * c1) + F.when(c0 > 0, other * other / (ra * c0)).otherwise(0.0)).alias("chi"), F.sum(share(o, c1) + share(other, c0)).alias("info"),
    )
    n, c1, c0, rest = F.col("n"), F.col("c1"), F.col("n") - F.col("c1"), F.col("n") - F.col("seen")
    both = c0 > 0
    chi = F.when(both, F.col("chi") + rest / c0)
    info = F.when(both, F.col("info") + F.when(rest > 0, rest / n * F.log(n / c0)).otherwise(0.0)).otherwise(0.0)
    ties = (F.pow(c0, 3) - c0) + (F.pow(c1, 3) - c1)
    spread = F.col("ranks") + rest * F.pow((c0 + 1) / 2, 2)
    stat = F.when(both, (12 / (n * (n + 1)) * spread - 3 * (n + 1)) / (1 - ties / (n * n * n - n))).otherwise(0.0)
    per_level = s.select(
        "feature", "level", F.when(F.col("k") > 1, F.sqrt(F.greatest(F.lit(0.0), chi - 1))).alias("cramer_v"), F.greatest(F.lit(0.0), info).alias("mut_info"),
        stat.alias("H"), tails.chi2_upper(stat, (F.col("k") - 1).cast("double")).alias("H_p"),
    )
    return per_level.unionByName(_contingency_stats(pairs, ["feature"]), allowMissingColumns=True)


def relative_entropy(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``kl`` in bits of the value frequencies of ``a`` from those of ``b``; infinite where b lacks a value."""
    pa, pb = (d.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    j = pa.join(pb, column, "left").crossJoin(pa.agg(F.sum("na").alias("ta"))).crossJoin(pb.agg(F.sum("nb").alias("tb")))  # one row each
    p, q = F.col("na") / F.col("ta"), F.col("nb") / F.col("tb")
    return j.agg(F.sum(F.when(q.isNull(), F.lit(float("inf"))).otherwise(p * F.log2(p / q))).alias("kl"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    while (x < 8).any():
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    i = (np.asarray(v, float) + 0.0).view(np.int64)
    return np.where(i >= 0, i, np.int64(-(2**63)) - i)


def _doubles(i: np.ndarray) -> np.ndarray:
    return np.where(i >= 0, i, np.int64(-(2**63)) - i).view(np.float64)


def _ends(x: np.ndarray, radius: np.ndarray, scale: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest double whose scaled difference from x is within the radius, by the difference itself, not by rounded ends."""
    far = np.nextafter(2 * radius * scale + np.abs(x) * 1e-9, np.inf)
    out = []
    for sign in (-1.0, 1.0):
        near, off = sign * x, sign * x + far  # mirrored, so that the end lies above
        low, high = _ordered(near), _ordered(np.minimum(off, np.finfo(float).max))
        for _ in range(64):
            # Rounds up without overflow.
            mid = (low >> 1) + (high >> 1) + ((low | high) & 1)
            inside = (_doubles(mid) - near) / scale <= radius
            low, high = np.where(inside, mid, low), np.where(inside, high, np.maximum(mid - 1, low))
        out.append(sign * _doubles(low))
    return out[0], out[1]


def _class_ends(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Ends of the nearest-neighbour intervals of a block of one class's sorted distinct values, its edges taken from the blocks beside it."""
    pdf = pdf.sort_values("x")
    kk = int(min(k, pdf["size"].iloc[0] - 1))
    times = np.minimum(pdf["w"].to_numpy(int), kk + 1)
    s = np.repeat(pdf["x"].to_numpy(float), times)
    gaps = np.full((len(s), 2 * kk), np.inf)
    for j in range(1, min(kk, len(s) - 1) + 1):
        gaps[j:, 2 * j - 2] = s[j:] - s[:-j]
        gaps[:-j, 2 * j - 1] = s[j:] - s[:-j]
    radius = np.nextafter(np.sort(gaps, 1)[np.cumsum(times) - times, kk - 1], 0)
    own = pdf["own"].to_numpy(bool)
    pdf, radius = pdf[own], radius[own]
    low, high = _ends(pdf["x"].to_numpy(float), radius)
    return pd.DataFrame({"feature": pdf["feature"], "w": pdf["w"], "size": pdf["size"], "kk": kk, "low": low, "high": high})


def _digamma_of(n: Column | str) -> Column:
    @F.pandas_udf("double")
    def at(n: pd.Series) -> pd.Series:
        return pd.Series(_digamma(n.to_numpy(float)))

    return at(n)


def _count_between(points: DataFrame, keys: list[str], queries: DataFrame) -> DataFrame:
    """``queries`` (``keys``, ``low``, ``high``) with ``m``, the rows of ``points`` (``keys``, ``v``, ``w`` rows) between the ends, inclusive.

    The ends are put among the values, so that one running count serves them all.
    """
    every = points.select(*keys, "v", F.col("w").cast("long").alias("w"))
    for end in ("low", "high"):
        every = every.unionByName(queries.select(*keys, F.col(end).alias("v"), F.lit(0).cast("long").alias("w")))
    ranked = value_counts(every, keys, "v", {"pts": F.col("w")})
    low = ranked.select(*keys, F.col("v").alias("low"), (F.col("cum_pts") - F.col("pts")).alias("_below"))
    high = ranked.select(*keys, F.col("v").alias("high"), F.col("cum_pts").alias("_upto"))
    return queries.join(low, [*keys, "low"]).join(high, [*keys, "high"]).withColumn("m", F.col("_upto") - F.col("_below")).drop("_upto", "_below")


def _information_class(long: DataFrame, k: int, block: int = 8192) -> DataFrame:
    stage = Stage(long.sparkSession, "information")
    freq = stage.write(long.groupBy("feature", "y", "x").agg(F.count("*").alias("w")))
    sizes = freq.groupBy("feature", "y").agg(F.sum("w").alias("size")).where("size > 1")
    freq = freq.join(sizes, ["feature", "y"])
    placed = value_counts(freq, ["feature", "y"], "x", {"w": F.col("w")}).join(sizes, ["feature", "y"])
    at = F.col("cum") - 1  # place among the distinct values of the class
    b, rest = F.floor(at / block), at % block
    copies = F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.when(rest < k, F.struct((b - 1).alias("b"), F.lit(False).alias("own"))), F.when(rest >= block - k, F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))
    blocks = placed.select("feature", "y", "x", "w", "size", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("feature", "y", "x", "w", "size", "c.*")
    ends = blocks.groupBy("feature", "y", "b").applyInPandas(lambda pdf: _class_ends(pdf, k), "feature string, w long, size long, kk int, low double, high double")
    ends = stage.write(ends)
    m = _count_between(freq.select("feature", F.col("x").alias("v"), "w"), ["feature"], ends)
    w = F.col("w").cast("double")
    s = m.groupBy("feature").agg(F.sum("w").alias("n"), F.sum(w * (_digamma_of("kk") - _digamma_of("size") - _digamma_of(F.greatest("m", F.lit(1))))).alias("s"))
    return s.select("feature", F.greatest(F.lit(0.0), _digamma_of("n") + F.col("s") / F.col("n")).alias("mut_info"))


def _nearest_in_cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """``near``: scaled distances of each asked point's k nearest others in the cell; of fewer if there are fewer."""
    pdf = pdf.sort_values(["x", "y"])
    base, asked = pdf[pdf["base"]], pdf[pdf["ask"]]
    times = np.minimum(base["w"].to_numpy(int), k + 1)
    bx, by = (np.repeat(base[c].to_numpy(float), times) for c in ("x", "y"))
    x, y, own, sx, sy = asked["x"].to_numpy(float), asked["y"].to_numpy(float), asked["base"].to_numpy(bool), pdf["sx"].iloc[0], pdf["sy"].iloc[0]
    near, most = [], min(k + 1, len(bx))
    for i in range(0, len(x), 512):
        d = np.maximum(np.abs(x[i : i + 512, None] - bx) / sx, np.abs(y[i : i + 512, None] - by) / sy)
        d = np.sort(np.partition(d, most - 1, axis=1)[:, :most], axis=1) if most else d
        # A point of the cell finds itself first.
        near += [r[1 : k + 1].tolist() if o else r[:k].tolist() for r, o in zip(d, own[i : i + 512])]
    near = pd.Series(near, asked.index, dtype=object)
    return pd.DataFrame({"feature": asked["feature"], "x": x, "y": y, "w": asked["w"], "sx": sx, "sy": sy, "strip": asked["strip"], "cell": asked["cell"], "near": near})


def _axis_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for axis in ("x", "y"):
            low, high = _ends(pdf[axis].to_numpy(float), np.nextafter(pdf["d"].to_numpy(float), 0), pdf["s" + axis].to_numpy(float))
            yield pd.DataFrame({"feature": pdf["feature"], "axis": axis, "w": pdf["w"], "low": low, "high": high})


def _information_numbers(long: DataFrame, k: int, cell: int = 1024) -> DataFrame:
    stage = Stage(long.sparkSession, "information")
    pairs = stage.write(long.groupBy("feature", "x", "y").agg(F.count("*").alias("w")))
    spread = lambda c: F.when((s := F.coalesce(F.stddev_pop(c), F.lit(0.0))) > 0, s).otherwise(1.0)
    scales = long.groupBy("feature").agg(F.count("*").alias("n"), spread("x").alias("sx"), spread("y").alias("sy"))
    most = pairs.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    cuts = max(2, math.ceil(math.sqrt(most / cell)))
    edges = pairs.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), 10 * cuts + 100).alias("edges"))
    params = scales.join(edges, "feature")
    strip_of = lambda v: F.aggregate("edges", F.lit(0), lambda a, e: a + (e < v).cast("int"))
    strips = pairs.join(params.select("feature", "sx", "sy", "edges"), "feature").withColumn("strip", strip_of(F.col("x"))).drop("edges")
    placed = running_sums(strips, ["feature", "strip"], "y", "x", {})
    # Cells of a strip differ by one at most and hold less than twice ``cell`` distinct points.
    own = F.floor((F.col("i") - 1) * F.greatest(F.lit(1), F.floor(F.col("n") / cell)) / F.col("n"))
    placed = stage.write(placed.withColumn("cell", own.cast("long")).select("feature", "strip", "cell", "x", "y", "w", "sx", "sy"))
    keys, schema = ["feature", "strip", "cell"], "feature string, x double, y double, w long, sx double, sy double, strip int, cell long, near array<double>"
    search = lambda d: d.groupBy(*keys).applyInPandas(lambda pdf: _nearest_in_cell(pdf, k), schema)
    yes, no = F.lit(True), F.lit(False)
    first = stage.write(search(placed.withColumns({"base": yes, "ask": yes})))
    # Cells whose box is no farther than the k-th distance so far may hold nearer points.
    far = F.when(F.size("near") >= k, F.element_at("near", k)).otherwise(float("inf"))
    boxes = placed.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    q = first.join(edges, "feature").withColumn("d", far).where("d > 0")
    reach = F.col("d") * F.col("sx") * (1 + 1e-9) + F.abs("x") * 1e-9
    q = q.withColumn("own", F.struct("strip", "cell")).withColumn("strip", F.explode(F.sequence(strip_of(F.col("x") - reach), strip_of(F.col("x") + reach)))).drop("edges", "cell")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) / F.col(f"s{c}")
    q = q.join(boxes, ["feature", "strip"]).where((gap("x") < F.col("d")) & (gap("y") < F.col("d")) & ((F.col("own.strip") != F.col("strip")) | (F.col("own.cell") != F.col("cell"))))
    asked = q.select(*keys, "x", "y", "w", "sx", "sy").withColumns({"base": no, "ask": yes})
    second = search(placed.withColumns({"base": yes, "ask": no}).unionByName(asked))
    point = ["feature", "x", "y"]
    found = first.unionByName(second).groupBy(*point).agg(F.first("w").alias("w"), F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    found = found.where(F.size("near") >= k).select(*point, "w", "sx", "sy", F.element_at("near", k).alias("d"))
    ends = stage.write(found.mapInPandas(_axis_ends, "feature string, axis string, w long, low double, high double"))
    values = pairs.select("feature", F.lit("x").alias("axis"), F.col("x").alias("v"), "w").unionByName(pairs.select("feature", F.lit("y").alias("axis"), F.col("y").alias("v"), "w"))
    m = _count_between(values, ["feature", "axis"], ends)
    s = m.groupBy("feature").agg(F.sum(F.col("w") * _digamma_of("m")).alias("s"))
    total = _digamma_of("n") + F.lit(float(_digamma(np.array([k]))[0])) - F.col("s") / F.col("n")
    return scales.join(s, "feature", "left").select("feature", F.greatest(F.lit(0.0), F.coalesce(total, F.lit(0.0))).alias("mut_info"))


def mutual_info(df: DataFrame, id_col: str, columns: Sequence[str], target: str, classify: bool, k: int = 3) -> DataFrame:
    """``feature``, ``mut_info`` (nats) of continuous features by k nearest neighbours, from all rows with a value and a target.

    Equal values (for a numeric target equal pairs) are counted first. Neighbours of a class's value
    are found in blocks of its sorted values, edges included; those of a pair in cells of bounded
    size, then in every other cell that may hold a nearer one. The rows within a radius are counted
    by running counts. Classes of a single row have no neighbour and are left out. No jitter is
    added, so the result is the same each time; ``id_col`` has no influence.
    """
    y = F.col(f"`{target}`").cast("string" if classify else "double")
    long = melt(df, columns, {"y": y}).where("x IS NOT NULL AND y IS NOT NULL")
    return _information_class(long, k) if classify else _information_numbers(long.where("NOT isnan(y)"), k)


def cont_class_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """``feature``, ``level``, ``mut_info`` of continuous features: each class against all others, and all classes (null level)."""
    long = melt(df, columns, {"y": F.col(f"`{target}`").cast("string")}).where("x IS NOT NULL AND y IS NOT NULL")
    classes = long.select("y").distinct().limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:  # every row counts once for each class
        raise ValueError(f"target {target!r} has more than {MOST_CLASSES} classes")
    level = F.explode(F.array(*[F.lit(r.y) for r in classes]).cast("array<string>")).alias("level")
    one = long.select("*", level).select(F.concat(F.lit("1"), "level", F.lit("\0"), "feature").alias("feature"), (F.col("y") == F.col("level")).cast("string").alias("y"), "x")
    every = one.unionByName(long.select(F.concat(F.lit("0\0"), "feature").alias("feature"), "y", "x"))
    at = F.instr("feature", "\0")
    level = F.when(F.col("feature").startswith("1"), F.substring("feature", F.lit(2), at - 2))
    return _information_class(every, k).select(F.substring("feature", at + 1, F.length("feature")).alias("feature"), level.alias("level"), "mut_info")


def cat_cont(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """``feature``, ``mut_info``, ``H``, ``H_p`` of categorical features against a numeric target; missing cells are the level ``nan``."""
    long = melt(df, columns, {"x": F.col(f"`{target}`").cast("double")}, cast="string", value="y").where("x IS NOT NULL AND NOT isnan(x)")
    info = _information_class(long.select("feature", F.coalesce("y", F.lit("nan")).alias("y"), "x"), k)
    return kruskal(df, columns, target).join(info, "feature", "left").select("feature", F.coalesce("mut_info", F.lit(0.0)).alias("mut_info"), "H", "H_p")


def associations(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], target: str, classify: bool) -> DataFrame:
    """All statistics of both kinds of features in one table: ``feature``, ``kind``, for a class target ``level``, and a column a statistic.

    A statistic that a kind doesn't have is null.
    """
    out = []
    if continuous and classify:
        info = cont_class_information(df, continuous, target)
        t = cont_class(df, continuous, target).withColumnsRenamed({"feature": "_f", "level": "_l"})
        t = info.join(t, (F.col("feature") == F.col("_f")) & F.col("level").eqNullSafe(F.col("_l")), "full")
        out.append(t.withColumns({"feature": F.coalesce("feature", "_f"), "level": F.coalesce("level", "_l")}).drop("_f", "_l"))
    elif continuous:
        out.append(cont_cont(df, continuous, target).join(mutual_info(df, "", continuous, target, False), "feature", "left"))
    if continuous:
        out[0] = out[0].withColumn("kind", F.lit("cont"))
    if categorical:
        out.append((cat_class if classify else cat_cont)(df, categorical, target).withColumn("kind", F.lit("cat")))
    table = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    first = ["feature", "kind", *(["level"] if classify else [])]
    return table.select(*first, *[c for c in table.columns if c not in first])


def tidy(table: DataFrame, by: str = "mut_info") -> DataFrame:
    """For reports: values of 1e-10 or less become 0, the strongest first."""
    numbers = [c for c, t in table.dtypes if t == "double"]
    table = table.withColumns({c: F.when(F.abs(F.col(c)) <= 1e-10, 0.0).otherwise(F.col(c)) for c in numbers})
    return table.orderBy(F.desc_nulls_last(by), "feature")
