"""Descriptions of features: one row a feature, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import tails
from gridloom.functions.ranks import quantiles, value_counts
from gridloom.operators.shape import melt


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature``, ``n``, ``nan_freq``, ``min``, ``mean``, ``max``, ``sd`` (n-1), ``skew``, ``kurt`` (population, excess)."""
    x = F.col("x")
    return melt(df, columns).groupBy("feature").agg(
        F.count("x").alias("n"), (F.count_if(x.isNull()) / F.count("*")).alias("nan_freq"), F.min(x).alias("min"), F.avg(x).alias("mean"),
        F.max(x).alias("max"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )


def percentile_table(df: DataFrame, columns: Sequence[str], compat: bool = False) -> DataFrame:
    """``feature``, ``p05``, ``median``, ``p95``, ``iqr`` by linear interpolation.

    ``compat`` reads the levels as percents (the 0.05th percentile and so on), as some reports do.
    """
    scale = 100 if compat else 1
    at = {"p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95}
    q = quantiles(melt(df, columns), ["feature"], "x", {k: v / scale for k, v in at.items()})
    return q.select("feature", "p05", "median", "p95", (F.col("q75") - F.col("q25")).alias("iqr"))


def skew_z(g1: Column, n: Column) -> Column:
    """D'Agostino's z of the skewness; null for 8 or fewer values."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    return F.when(n > 8, z)


def kurt_z(g2: Column, n: Column) -> Column:
    """Anscombe and Glynn's z of the kurtosis; null for 20 or fewer values."""
    e = 3.0 * (n - 1) / (n + 1)
    v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / F.sqrt(v)
    s = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z = (1 - 2 / (9 * a) - F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1.0 / 3))) / F.sqrt(2 / (9 * a))
    return F.when(n > 20, z)


def differential_entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature``, ``entropy`` from order-statistic spacings m = floor(sqrt(n) + 1/2) apart.

    Over 1,000 values Vasicek's estimate, over 10 with Ebrahimi's correction, else van Es's. A
    spacing of zero gives minus infinity. The order statistics meet by position, so no window spans
    a feature.
    """
    ranked = value_counts(melt(df, columns), ["feature"], "x").withColumnsRenamed({"n": "k", "total": "n"})
    ends = ranked.groupBy("feature").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    ranked = ranked.join(ends, "feature").withColumn("m", F.floor(F.sqrt("n") + 0.5))
    at = ranked.select("feature", "x", "n", "m", "first", "last", F.explode(F.sequence(F.col("cum") - F.col("k") + 1, F.col("cum"))).alias("i"))
    i, n, m = F.col("i"), F.col("n"), F.col("m")
    # Each value is the upper end of the gap around the place m below it, its own, and the lower end of the one m above: one aggregate brings them together.
    roles = F.array(F.struct((i - m).alias("i"), F.lit(1).alias("r")), F.struct(i.alias("i"), F.lit(0).alias("r")), F.struct((i + m).alias("i"), F.lit(-1).alias("r")))
    roles = at.select("feature", "x", "n", "m", "first", "last", F.explode(roles).alias("p")).select("feature", "x", "n", "m", "first", "last", "p.*").where("i BETWEEN 1 AND n")
    of = lambda r: F.max(F.when(F.col("r") == r, F.col("x")))
    spaced = roles.groupBy("feature", "i").agg(*[F.first(c).alias(c) for c in ("n", "m", "first", "last")], of(0).alias("x"), of(1).alias("upper"), of(-1).alias("lower"))
    gap = F.coalesce("upper", "last") - F.coalesce("lower", "first")
    edge = F.when(i <= m, 1 + (i - 1) / m).when(i >= n - m + 1, 1 + (n - i) / m).otherwise(F.lit(2.0))
    term = F.when(n > 1000, F.log(n / (2.0 * m) * gap)).otherwise(F.log(n / (edge * m) * gap))
    spaced = spaced.withColumn("t", F.when(gap > 0, term).otherwise(float("-inf")))
    es = F.log((n + 1.0) / m * (F.col("upper") - F.col("x")))
    tail_sum = F.aggregate(F.sequence(F.col("m"), F.col("n")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    agg = spaced.groupBy("feature", "n", "m").agg(F.avg("t").alias("v"), (F.sum(es) / (F.col("n") - F.col("m"))).alias("e"))
    entropy = F.when(F.col("n") > 10, F.col("v")).otherwise(F.col("e") + tail_sum + F.log("m") - F.log(F.col("n") + 1.0))
    return agg.select("feature", entropy.alias("entropy"))


def describe_continuous(df: DataFrame, columns: Sequence[str], compat: bool = False) -> DataFrame:
    """One row a feature: extremes, moments with the p-values of skewness and kurtosis, quantiles, entropy, missing share.

    Nulls and NaN are missing. A feature without values has nulls. No columns is an error.
    """
    n, m = F.col("n").cast("double"), moments(df, columns)
    m = m.withColumns({"skew_p": tails.normal_two_sided(skew_z(F.col("skew"), n)), "kurt_p": tails.normal_two_sided(kurt_z(F.col("kurt"), n))})
    out = m.join(percentile_table(df, columns, compat), "feature", "left").join(differential_entropy(df, columns), "feature", "left")
    return out.select("feature", "min", "mean", "max", "sd", "p05", "median", "p95", "iqr", "skew", "skew_p", "kurt", "kurt_p", "entropy", "nan_freq")


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature``, ``level`` (null is the level ``nan``), ``count``, ``nulls``."""
    long = melt(df, columns, cast="string", value="level")
    return long.groupBy("feature", F.coalesce("level", F.lit("nan")).alias("level")).agg(F.count("*").alias("count"), F.count_if(F.col("level").isNull()).alias("nulls"))


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a feature: levels, missing cells, frequencies, rarest and commonest level, heterogeneity, entropy.

    Missing cells are a level of their own, ``nan``. Ties go to the first name in order. ``heterog``
    is the chi-square of the counts against equal counts; ``heterog_freq`` the same of the
    frequencies. ``n_entropy`` is null for a single level.
    """
    counts = level_counts(df, columns)
    total = counts.groupBy("feature").agg(F.sum("count").alias("total"), F.count("*").alias("k"), F.sum("nulls").alias("nans"))
    c = counts.join(total, "feature")
    f, even = F.col("count") / F.col("total"), 1.0 / F.col("k")
    agg = c.groupBy("feature").agg(
        F.first("k").alias("n_levels"), F.first("nans").alias("nans"), (F.first("nans") / F.first("total")).alias("nan_freq"),
        F.min(f).alias("min_freq"), F.max(f).alias("max_freq"), F.min(F.struct(F.col("count"), F.col("level"))).getField("level").alias("min_name"),
        F.min(F.struct(-F.col("count"), F.col("level"))).getField("level").alias("max_name"),
        # Exact; what it holds is the distinct counts, at most the root of twice the rows.
        (F.percentile("count", F.lit(0.5)) / F.first("total")).alias("med_freq"), F.sum((f - even) * (f - even) / even).alias("heterog_freq"), (F.first("total") * F.sum((f - even) * (f - even) / even)).alias("heterog"),
        (-F.sum(f * F.log(f)) / F.when(F.first("k") > 1, F.log(F.first("k").cast("double")))).alias("n_entropy"),
    )
    out = agg.withColumn("heterog_p", tails.chi2_upper(F.col("heterog"), (F.col("n_levels") - 1).cast("double")))
    return out.select("feature", "n_levels", "nans", "nan_freq", "med_freq", "min_freq", "max_freq", "min_name", "max_name", "heterog", "heterog_freq", "heterog_p", "n_entropy")


def describe_all(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], target: str, classify: bool) -> dict[str, DataFrame | None]:
    """Tables of the continuous and categorical features and of the target."""
    return {
        "continuous": describe_continuous(df, continuous) if continuous else None,
        "categorical": describe_categorical(df, categorical) if categorical else None,
        "target": (describe_categorical if classify else describe_continuous)(df, [target]),
    }


def inflation(df: DataFrame, columns: Sequence[str], least: int = 20) -> DataFrame:
    """Share of each column's levels (missing left out) that have fewer than ``least`` rows, and how many levels there are."""
    counts = melt(df, columns, cast="string", value="level").where("level IS NOT NULL").groupBy("feature", "level").count()
    return counts.groupBy("feature").agg(F.avg((F.col("count") < least).cast("double")).alias("inflation"), F.count("*").alias("n_levels"))


def big_categories(df: DataFrame, columns: Sequence[str], least: int = 20) -> DataFrame:
    """Levels to deflate and to keep: ``feature``, ``level``, ``count``, ``deflate``, ``n_levels``, ``big``; one row a level."""
    counts = melt(df, columns, cast="string", value="level").where("level IS NOT NULL").groupBy("feature", "level").count()
    n = counts.groupBy("feature").agg(F.count("*").alias("n_levels"))
    return counts.join(n, "feature").select("feature", "level", "count", (F.col("count") < least).cast("int").alias("deflate"), "n_levels", (F.col("n_levels") >= least).cast("int").alias("big"))


