"""Splits by reproducible hash order: every split is a column, never a list of row numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ranks import hashed_positions, value_counts
from gridloom.functions.skew import lookup

SEED = 69
#: Groups times classes that the driver holds.
CELLS = 1 << 20


def split_label(df: DataFrame, targets: Sequence[str], least: int = 20, name: str = "label") -> tuple[DataFrame, list[str]]:
    """One label out of several class targets, joined by ``__``; while a label is too rare, the target with most levels is left out.

    Returns the rows with ``name`` and the targets used.
    """
    used = list(targets)
    n = {t: k for t, k in zip(used, df.agg(*[F.count_distinct(t) for t in used]).first())}
    while True:
        joined = F.concat_ws("__", *[F.coalesce(F.col(t).cast("string"), F.lit("nan")) for t in used])
        smallest = df.groupBy(joined.alias("l")).count().agg(F.min("count")).first()[0]
        if len(used) == 1 or smallest is None or smallest >= least:
            return df.withColumn(name, joined), used
        used.remove(max(used, key=lambda t: (n[t], t)))


def stratified_folds(df: DataFrame, id_col: str, y: str | None, k: int, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Folds 0..k-1 of sizes that differ by at most one within each class (overall if ``y`` is None)."""
    placed = hashed_positions(df, [y] if y else [], seed, id_col, "_pos")
    return placed.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_pos_of")


def contiguous_folds(df: DataFrame, id_col: str, k: int, name: str = "fold") -> DataFrame:
    """Blocks of neighbouring identifiers; the first n mod k folds have one row more."""
    ranked = value_counts(df.select(F.col(id_col).alias("_i")), [], "_i").select(F.col("_i"), (F.col("cum") - F.col("n")).alias("_at"))
    n = df.agg(F.count("*").alias("_n"))
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    cut = extra * (size + 1)
    fold = F.when(F.col("_at") < cut, F.floor(F.col("_at") / (size + 1))).otherwise(extra + F.floor((F.col("_at") - cut) / F.when(size > 0, size).otherwise(1)))
    folds = ranked.crossJoin(F.broadcast(n)).select("_i", fold.cast("int").alias(name))  # one row
    return df.join(folds, F.col(id_col) == F.col("_i")).drop("_i")


def group_folds(df: DataFrame, group: str, k: int, y: str | None = None, seed: int = SEED, name: str = "fold", singly: int = 4096) -> DataFrame:
    """Folds that keep groups whole, of near-equal size (and near-equal class shares if ``y`` is given).

    The ``singly`` largest groups (fewer with very many classes, so that groups times classes stay
    within ``CELLS``) are dealt one by one on the driver to the fold where they do least harm; all smaller ones are dealt round by round in
    hash order within their size band, which evens out the rest. A missing group is one group.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("\0missing"))
    sizes = df.groupBy(g.alias("_g")).agg(F.count("*").alias("n"))
    n_classes = df.agg(F.count_distinct(F.coalesce(F.col(y).cast("string"), F.lit("None")))).first()[0] if y else 1
    big = sizes.orderBy(F.desc("n"), "_g").limit(min(singly, CELLS // max(1, n_classes)))
    dealt: dict[str, int] = {}
    if y:
        per = df.groupBy(g.alias("_g"), F.col(y).cast("string").alias("c")).agg(F.count("*").alias("n"))
        rows = per.join(F.broadcast(big.select("_g")), "_g", "left_semi").collect()
        at = {c: i for i, c in enumerate(sorted({str(r.c) for r in rows}))}
        table: dict[str, np.ndarray] = {}
        for r in rows:
            table.setdefault(r._g, np.zeros(len(at)))[at[str(r.c)]] = r.n
        total = np.maximum(1.0, sum(table.values())) if table else np.ones(0)
        load = np.zeros((k, len(at)))
        for key in sorted(table, key=lambda x: (-table[x].max(), -table[x].sum(), x)):
            # The spread of the classes' shares over the folds grows least where the group's classes are rarest so far.
            harm = load @ (table[key] / total**2)
            f = min(range(k), key=lambda i: (round(harm[i], 12), load[i].sum(), i))
            load[f] += table[key]
            dealt[key] = f
    else:
        fold_load = [0] * k
        for r in big.collect():
            f = min(range(k), key=lambda i: (fold_load[i], i))
            fold_load[f] += r.n
            dealt[r._g] = f
    spark = df.sparkSession
    first = spark.createDataFrame(list(dealt.items()) or [], "_g string, _f int")
    rest = sizes.join(F.broadcast(first), "_g", "left_anti").withColumn("_band", F.floor(F.log2("n")))
    rest = hashed_positions(rest, ["_band"], seed, "_g", "_pos").select("_g", ((F.col("_pos") - 1) % k).cast("int").alias("_f"))
    folds = first.unionByName(rest)
    return lookup(df.withColumn("_g", g), folds, "_g").withColumn(name, F.col("_f")).drop("_g", "_f")


def degenerate(df: DataFrame, fold: str, y: str, train_min: int = 8, test_min: int = 2) -> DataFrame:
    """Folds that can't be used, with the reason: a single class in train or test, or too few rows of a class.

    Any number of classes. A fold's least class in train is either one of its own less its rows there,
    or the least class of all.
    """
    counts = df.groupBy(F.col(fold).alias("fold"), F.col(y).alias("c")).agg(F.count("*").alias("n"))
    total = counts.groupBy("c").agg(F.sum("n").alias("t"))
    every = total.agg(F.count("*").alias("classes"), F.min("t").alias("least"))  # one row
    g = counts.join(total, "c").groupBy("fold").agg(
        F.count_if(F.col("t") == F.col("n")).alias("gone"), F.count("*").alias("test_classes"), F.min(F.col("t") - F.col("n")).alias("own_least"), F.min("n").alias("test_least"),
    ).crossJoin(F.broadcast(every))
    g = g.withColumns({"train_classes": F.col("classes") - F.col("gone"), "train_least": F.least("own_least", "least")})
    reason = F.when(F.col("train_classes") <= 1, "one class in train").when(F.col("test_classes") <= 1, "one class in test").when(F.col("train_least") < train_min, "too few in train").when(F.col("test_least") < test_min, "too few in test")
    return g.withColumn("reason", reason).where("reason IS NOT NULL").select("fold", "reason")


def usable_folds(df: DataFrame, id_col: str, y: str | None, k: int, group: str | None = None, seed: int = SEED, name: str = "fold") -> tuple[DataFrame, list[str]]:
    """Folds by group where there is one; should one of them be degenerate, folds by class instead, and if these are too, folds of rows alone. Returns what was given up, too."""
    notes: list[str] = []
    if group:
        folded = group_folds(df, group, k, y, seed, name)
        bad = degenerate(folded, name, y).limit(1).collect() if y else []
        if not bad:
            return folded, notes
        notes.append(f"folds of whole groups can't be used: {bad[0].reason}")
    folded = stratified_folds(df, id_col, y, k, seed, name)
    bad = degenerate(folded, name, y).limit(1).collect() if y else []
    if bad:
        notes.append(f"folds by class can't be used: {bad[0].reason}")
        folded = stratified_folds(df, id_col, None, k, seed, name)
    return folded, notes


def holdout(df: DataFrame, id_col: str, y: str | None, train: float = 0.6, seed: int = SEED, name: str = "is_train") -> DataFrame:
    """``name`` 1 for the train share of each class, rounded per class; reproducible."""
    placed = hashed_positions(df, [y] if y else [], seed, id_col, "_pos")
    return placed.withColumn(name, (F.col("_pos") <= F.round(F.col("_pos_of") * train)).cast("int")).drop("_pos", "_pos_of")


def grouped_holdout(df: DataFrame, group: str, y: str | None, train: float = 0.6, seed: int = SEED, name: str = "is_train") -> DataFrame:
    """A holdout that keeps groups whole: folds of groups, the one whose complement comes nearest to ``train`` is the test."""
    k = max(2, int(1 / (1 - train)))
    folded = group_folds(df, group, k, y, seed, "_fold")
    sizes = {r["_fold"]: r["count"] for r in folded.groupBy("_fold").count().collect()}
    n = sum(sizes.values()) or 1
    test = min(range(k), key=lambda f: (abs(1 - sizes.get(f, 0) / n - train), f))
    return folded.withColumn(name, (F.col("_fold") != test).cast("int")).drop("_fold")


def subsample(df: DataFrame, id_col: str, y: str, n: int = 1500, least: int = 20, classify: bool = True, seed: int = SEED) -> DataFrame:
    """About ``n`` rows in hash order: ``least`` of each class first, the rest by the classes' shares; numbers by fifths of the target."""
    if not classify:
        ranked = value_counts(df.select(F.col(y).cast("double").alias("_y")), [], "_y").select("_y", "cum", "n")
        total = df.where(F.col(y).isNotNull()).count()
        fifth = ranked.select("_y", F.least(F.lit(4), F.floor((F.col("cum") - 1) * 5 / max(1, total))).cast("int").alias("_s"))
        df = df.withColumn("_y", F.col(y).cast("double")).join(fifth, "_y").drop("_y")
    else:
        df, total = df.withColumn("_s", F.col(y)), df.where(F.col(y).isNotNull()).count()
    placed = hashed_positions(df.where(F.col("_s").isNotNull()), ["_s"], seed, id_col, "_pos")
    quota = F.greatest(F.lit(least), F.round(F.col("_pos_of") * min(1.0, n / max(1, total))))
    return placed.where(F.col("_pos") <= quota).drop("_pos", "_pos_of", "_s")


def source_splits(sources: Sequence[int], how: str) -> list[tuple[list[int], list[int]]]:
    """Pairs of train and test sources: ``single`` (0 against all others), ``list`` (0 against each), ``lodo`` (each against all others)."""
    s = sorted(sources)
    if how == "single":
        return [([s[0]], s[1:])]
    if how == "list":
        return [([s[0]], [t]) for t in s[1:]]
    if how == "lodo":
        return [([t], [o for o in s if o != t]) for t in s]
    raise ValueError(f"unknown way to split: {how}")


def balanced_bootstrap(df: DataFrame, id_col: str, y: str, n: int, repeats: int, seed: int = SEED) -> DataFrame:
    """``repeats`` test sets of ``n`` draws with replacement, all classes equally likely: ``repeat``, ``draw``, the row.

    A draw picks a class and a place in it by hash and is joined to the row at that place, so
    nothing but the draws travels.
    """
    placed = hashed_positions(df.where(F.col(y).isNotNull()), [y], seed, id_col, "_pos")
    sizes = placed.groupBy(F.col(y).alias("_c")).agg(F.max("_pos_of").alias("_size"))
    sizes = hashed_positions(sizes, [], seed, "_c", "_class")  # classes by number, any number of them
    draws = df.sparkSession.range(repeats * n).select((F.col("id") % repeats).cast("int").alias("repeat"), F.floor(F.col("id") / repeats).cast("int").alias("draw"))
    draws = draws.withColumn("_pick", F.pmod(F.xxhash64(F.lit(seed), "repeat", "draw", F.lit(0)), F.lit(max(1, sizes.count()))) + 1)
    draws = draws.join(sizes, F.col("_pick") == F.col("_class")).drop("_pick", "_class", "_class_of")
    draws = draws.withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "repeat", "draw", F.lit(1)), F.col("_size")) + 1)
    return draws.join(placed, (F.col("_c") == F.col(y)) & (F.col("_at") == F.col("_pos"))).drop("_c", "_size", "_at", "_pos", "_pos_of")


def bootstrap_means(df: DataFrame, keys: Sequence[str], x: str, repeats: int = 200, seed: int = SEED, id_col: str | None = None) -> DataFrame:
    """``mean``, ``low``, ``high`` (95%) of the mean by the Poisson bootstrap: all repeats in one pass, sums by repeat."""
    h = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), id_col or x), F.lit(1 << 30)) / float(1 << 30))
    # Inverse of the Poisson(1) distribution function, up to 6 copies.
    import math

    steps, total = [], 0.0
    for k in range(7):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    aggs = []
    for i in range(repeats):
        u = h(i)
        w = F.lit(7)
        for k in range(6, -1, -1):
            w = F.when(u < steps[k], k).otherwise(w)
        aggs.append((F.sum(w * F.col(x)) / F.sum(w)).alias(f"m{i}"))
    rows = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.avg(x).alias("mean"), *aggs)
    means = F.sort_array(F.array(*[F.col(f"m{i}") for i in range(repeats)]))
    return rows.select(*keys, "mean", means[int(repeats * 0.025)].alias("low"), means[int(repeats * 0.975) - 1].alias("high"))
