"""Cleaning and encoding of a table before modelling.

Parameters (levels, medians, ranges) come from grouped aggregates and are bounded by the number of
columns and kept levels; rows are only ever projected. Fitted parameters are plain Python values,
so the same transform runs on another table or on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.linear import cross_products
from gridloom.functions.nulls import floatify, unify_nans
from gridloom.functions.ranks import hashed_positions, quantiles
from gridloom.operators.shape import melt

# The fewest rows of a level and of a target class.
LEVEL_MIN = 20
TARGET_MIN = 20
#: Levels that a one-hot encoding or a class target may have; more is an error, not a cut.
MOST_LEVELS = 10_000


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_missing_target(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows whose every target is there; NaN is missing."""
    ok = F.lit(True)
    kinds = dict(df.dtypes)
    for t in targets:
        ok = ok & q(t).isNotNull() & (~F.isnan(q(t)) if kinds[t] in ("double", "float") else F.lit(True))
    return df.where(ok)


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    """Rows of each class, missing ones left out. Raises for a target with more classes than a target can have."""
    rows = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("c")).count().limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"target {target!r} has more than {MOST_LEVELS} classes")
    return {r.c: r["count"] for r in rows}


def encode_target(df: DataFrame, target: str, least: int = TARGET_MIN) -> tuple[DataFrame, dict[int, str]]:
    """Classes as 0..k-1 in the order of their names; classes of ``least`` rows or fewer and missing targets are dropped.

    Returns the rows with the encoded target and the label of each code. Raises if fewer than two classes are left.
    """
    kept = sorted(c for c, n in class_counts(drop_missing_target(df, [target]), target).items() if n > least)
    if len(kept) < 2:
        raise ValueError(f"target {target!r} is constant once rare classes are dropped")
    codes = F.create_map(*[x for i, c in enumerate(kept) for x in (F.lit(c), F.lit(i))])
    out = df.withColumn(target, F.element_at(codes, q(target).cast("string"))).where(q(target).isNotNull())
    return out, dict(enumerate(kept))


def encode_targets(df: DataFrame, targets: Sequence[str], least: int = TARGET_MIN, rare_fraction: float = 1 / 3) -> tuple[DataFrame, dict[str, dict[int, str]]]:
    """Several class targets: rows with a missing target or too many rare labels are dropped, each target is encoded.

    A row may have at most max(1, ceil(T * ``rare_fraction``)) labels of ``least`` rows or fewer.
    """
    import math

    rows = drop_missing_target(df, targets)
    rare = {t: [c for c, n in class_counts(rows, t).items() if n <= least] for t in targets}
    flags = [q(t).cast("string").isin(rare[t]).cast("int") if rare[t] else F.lit(0) for t in targets]
    most = max(1, math.ceil(len(targets) * rare_fraction))
    rows = rows.where(sum(flags[1:], flags[0]) <= most)
    labels = {}
    for t in targets:
        kept = sorted(class_counts(rows, t))
        labels[t] = dict(enumerate(kept))
    cols = {t: F.element_at(F.create_map(*[x for i, c in labels[t].items() for x in (F.lit(c), F.lit(i))]), q(t).cast("string")) for t in targets}
    return rows.withColumns(cols), labels


def decode(df: DataFrame, column: str, labels: dict[int, str]) -> DataFrame:
    """Codes as labels; a code without one is shown as it is."""
    if not labels:
        return df.withColumn(column, q(column).cast("string"))
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(column, F.coalesce(F.element_at(m, q(column).cast("int")), q(column).cast("string")))


def group_codes(df: DataFrame, group: str, name: str = "group_code", seed: int = 69) -> DataFrame:
    """Groups as 0.. in a reproducible random order; missing is -1. Works for any number of groups."""
    distinct = df.where(q(group).isNotNull()).select(q(group).cast("string").alias("_g")).distinct()
    coded = hashed_positions(distinct, [], seed, "_g", "_pos").select("_g", (F.col("_pos") - 1).alias(name))
    joined = df.join(coded, q(group).cast("string") == F.col("_g"), "left").drop("_g")
    return joined.withColumn(name, F.coalesce(name, F.lit(-1)).cast("long"))


@dataclass
class Scale:
    """y -> (y - center) / width."""

    center: float
    width: float

    def apply(self, c: Column) -> Column:
        return (c - self.center) / self.width


def robust_targets(df: DataFrame, targets: Sequence[str]) -> tuple[DataFrame, dict[str, Scale]]:
    """Numeric targets less their median, over the range of their 2.5th to 97.5th percentile (1 if that is zero); rows with a missing one are dropped."""
    rows = drop_missing_target(df, targets)
    qs = quantiles(melt(rows, targets), ["feature"], "x", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()
    scales = {r.feature: Scale(r.mid, (r.hi - r.lo) or 1.0) for r in qs}
    return rows.withColumns({t: scales[t].apply(q(t).cast("double")) for t in targets if t in scales}), scales


def unusable(df: DataFrame, targets: Sequence[str]) -> list[str]:
    """Columns, targets aside, with one distinct value at most, missing counted as a value."""
    names = [c for c in df.columns if c not in targets]
    if not names:
        return []
    # The least and the greatest cell tell whether there is a second value; no distinct values are gathered.
    cell = {c: F.coalesce(q(c).cast("string"), F.lit("nan")) for c in names}
    ends = df.agg(*[F.min(cell[c]).eqNullSafe(F.max(cell[c])).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if ends[f"c{i}"]]


@dataclass
class Imputer:
    """Fill values and the columns that get an indicator."""

    fill: dict[str, float]
    indicators: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns]
        missing = {c: q(c).isNull() | F.isnan(q(c).cast("double")) for c in self.fill}
        cols = [F.when(missing[c], F.lit(self.fill[c])).otherwise(q(c).cast("double")).alias(c) if c in self.fill else q(c) for c in kept]
        return df.select(*cols, *[missing[c].cast("double").alias(f"{c}_NAN") for c in self.indicators])


def fit_imputer(df: DataFrame, columns: Sequence[str], how: str = "median") -> Imputer:
    """Medians or means of ``columns`` as fill values (0 for a column without values), and an indicator for each column that lacks some."""
    long = melt(df, columns)
    nulls = {r.feature for r in long.groupBy("feature").agg(F.count_if(F.col("x").isNull()).alias("n")).collect() if r.n}
    if how == "mean":
        fill = {r.feature: r.v for r in long.groupBy("feature").agg(F.avg("x").alias("v")).collect()}
    elif how == "median":
        fill = {r.feature: r.v for r in quantiles(long, ["feature"], "x", {"v": 0.5}).collect()}
    else:
        raise ValueError("how must be mean or median")
    return Imputer({c: fill.get(c) if fill.get(c) is not None else 0.0 for c in columns}, [c for c in columns if c in nulls])


def iterative_impute(df: DataFrame, columns: Sequence[str], rounds: int = 3) -> DataFrame:
    """Missing numbers predicted from the other columns by least squares, round after round, from a median start.

    A round needs one pass: the cross products of all columns over the rows where each column is
    present. The systems solved on the driver have one row a column.
    """
    import numpy as np

    cols = list(columns)
    start = fit_imputer(df, cols)
    miss = {c: (q(c).isNull() | F.isnan(q(c).cast("double"))) for c in cols}
    base = df.withColumns({f"_m{i}": miss[c] for i, c in enumerate(cols)}).withColumns({c: F.when(miss[c], F.lit(start.fill[c])).otherwise(q(c).cast("double")) for c in cols})
    current: dict[str, Column] = {c: q(c) for c in cols}
    out = base
    for _ in range(rounds):
        todo = [i for i, c in enumerate(cols) if c in start.indicators]
        if not todo:
            break
        p = len(cols)
        grams = cross_products(out, [F.lit(1.0), *[current[c] for c in cols]], [~F.col(f"_m{i}") for i in todo])
        new = {}
        for i, g in zip(todo, grams):
            at = [0, *[j + 1 for j in range(p) if j != i]]
            m, v = g[np.ix_(at, at)], g[at, i + 1]
            coef = np.linalg.lstsq(m + 1e-9 * np.eye(p) * max(1.0, np.trace(m) / p), v, rcond=None)[0]
            xs = F.array(*[current[c] for j, c in enumerate(cols) if j != i])
            guess = F.aggregate(F.zip_with(xs, F.array(*[F.lit(float(k)) for k in coef[1:]]), lambda x, k: x * k), F.lit(float(coef[0])), lambda a, t: a + t)
            new[cols[i]] = F.when(F.col(f"_m{i}"), guess).otherwise(q(cols[i]))
        out = out.withColumns(new)
    return out.drop(*[f"_m{i}" for i in range(len(cols))])


@dataclass
class Normalizer:
    """Per column: center, clip range, and the minimum and maximum of what is left."""

    ranges: dict[str, tuple[float, float, float, float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mid, lo, hi, least, most) in self.ranges.items():
            x = q(c).cast("double") - mid
            x = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
            out[c] = F.when(q(c).isNotNull(), F.lit(0.0)) if most <= least else (x - least) / (most - least)
        return df.withColumns(out)


def fit_normalizer(df: DataFrame, columns: Sequence[str], robust: bool = True) -> Normalizer:
    """Median to 0, outliers beyond twice the 5-95 range clipped (``robust``), then to [0, 1]; constant columns become 0."""
    long = melt(df, columns)
    qs = quantiles(long, ["feature"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.95})
    ends = long.groupBy("feature").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    ranges = {}
    for r in qs.join(ends, "feature").collect():
        span = r.hi - r.lo
        lo, hi = (r.lo - r.mid - 2 * span, r.hi - r.mid + 2 * span) if robust else (float("-inf"), float("inf"))
        # Clipping is monotonic, so the ends of the clipped values are the clipped ends.
        ranges[r.feature] = (r.mid, lo, hi, min(max(r.least - r.mid, lo), hi), min(max(r.most - r.mid, lo), hi))
    return Normalizer(ranges)


@dataclass
class Deflater:
    """Levels kept of each column, and the name that stands for all others."""

    keep: dict[str, list[str]]
    other: dict[str, str]
    deflated: dict[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, keep in self.keep.items():
            v = q(c).cast("string")
            cols[c] = F.when(v.isNull() | v.isin(keep), v).otherwise(self.other[c]) if keep else F.when(v.isNotNull(), F.lit(self.other[c]))
        return df.withColumns(cols)


def fit_deflater(df: DataFrame, columns: Sequence[str], least: int = LEVEL_MIN) -> Deflater:
    """Levels with fewer than ``least`` rows are merged into ``DEFLATED`` (another name where a level has that one); missing stays missing.

    A kept level has ``least`` rows or more, so a column can't keep more than rows / ``least``; only
    kept levels reach the driver, and more than ``MOST_LEVELS`` of them are an error.
    """
    counts = melt(df, columns, cast="string", value="level").where("level IS NOT NULL").groupBy("feature", "level").count()
    kept: dict[str, list[str]] = {c: [] for c in columns}
    rows = counts.where(F.col("count") >= least).select("feature", "level").limit(MOST_LEVELS * len(columns) + 1).collect()
    for r in rows:
        kept[r.feature].append(r.level)
    if any(len(v) > MOST_LEVELS for v in kept.values()):
        raise ValueError(f"a column keeps more than {MOST_LEVELS} levels")
    small = {r.feature: r.n for r in counts.where(F.col("count") < least).groupBy("feature").agg(F.count("*").alias("n")).collect()}
    taken = {r.feature for r in counts.where(F.col("level") == "DEFLATED").select("feature").collect()}
    names = {c: "DEFLATED_OTHER" if c in taken else "DEFLATED" for c in columns}
    changed = {c: sorted(v) for c, v in kept.items() if c in small}
    return Deflater(changed, {c: names[c] for c in changed}, small)


@dataclass
class OneHot:
    """Levels of each column in order; null stands for missing."""

    levels: dict[str, list[str | None]]
    binary: list[str]

    def names(self) -> list[str]:
        return [n for n, _ in self._columns()]

    def _columns(self) -> list[tuple[str, Column]]:
        out = []
        for c, levels in self.levels.items():
            shown = levels[1:] if c in self.binary and levels[0] is not None else levels
            for v in shown:
                hit = q(c).isNull() if v is None else q(c).cast("string").eqNullSafe(F.lit(v))
                out.append((f"{c}_{'nan' if v is None else v}", hit.cast("double")))
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` (all other columns by default) and the encoded columns, by one projection."""
        rest = [c for c in (keep if keep is not None else df.columns) if c not in self.levels]
        return df.select(*[q(c) for c in rest], *[col.alias(n) for n, col in self._columns()])


def fit_one_hot(df: DataFrame, columns: Sequence[str]) -> OneHot:
    """A column for each level; of two-level columns only the second, and one for missing where some are. Constant columns raise."""
    found = melt(df, columns, cast="string", value="level").distinct().limit(MOST_LEVELS * max(1, len(columns)) + 1).collect()
    levels: dict[str, list[str | None]] = {c: [] for c in columns}
    for r in found:
        levels[r.feature].append(r.level)
    for c, v in levels.items():
        v.sort(key=lambda x: (x is None, x or ""))
        if len(v) < 2:
            raise ValueError(f"column {c!r} is constant and can't be encoded")
        if len(v) > MOST_LEVELS:
            raise ValueError(f"column {c!r} has more than {MOST_LEVELS} levels; deflate it first")
    return OneHot(levels, [c for c, v in levels.items() if sum(x is not None for x in v) == 2])


@dataclass
class Prepared:
    """One wide table with the roles of its columns, and the fitted transforms."""

    df: DataFrame
    features: list[str]
    continuous: list[str]
    categorical: list[str]
    targets: list[str]
    group: str | None
    labels: dict[str, dict[int, str]]
    imputer: Imputer | None = None
    normalizer: Normalizer | None = None
    deflater: Deflater | None = None
    one_hot: OneHot | None = None
    indicators: list[str] = field(default_factory=list)

    def for_target(self, target: str) -> Prepared:
        from dataclasses import replace

        if target not in self.targets:
            raise ValueError(f"{target!r} is not a target")
        others = [t for t in self.targets if t != target]
        return replace(self, df=self.df.drop(*others), targets=[target])

    def subset(self, condition: Column) -> Prepared:
        from dataclasses import replace

        return replace(self, df=self.df.where(condition))

    def validate(self, classify: bool, least: int = TARGET_MIN) -> list[str]:
        """Warnings for several targets; raises if a single target has a class of fewer than ``least`` rows."""
        if not classify:
            return []
        notes = []
        for t in self.targets:
            small = {c: n for c, n in class_counts(self.df, t).items() if n < least}
            if small and len(self.targets) == 1:
                raise ValueError(f"classes of {t!r} with fewer than {least} rows: {small}")
            if small:
                notes.append(f"target {t!r} has small classes: {small}")
        return notes


def prepare(
    df: DataFrame, targets: Sequence[str], continuous: Sequence[str], categorical: Sequence[str], classify: bool, group: str | None = None,
    nan: str = "median", normalize: bool = True, robust: bool = True,
) -> Prepared:
    """Missing spellings unified, targets encoded or scaled, numbers imputed with indicators, rare levels merged, levels encoded.

    ``nan``: ``mean`` or ``median`` fill missing numbers, ``impute`` predicts them from the other columns, ``drop``
    drops their rows; anything else raises. ``{c}_norm`` holds the normalised copy of a continuous feature where ``normalize`` is set.
    """
    if nan not in ("mean", "median", "impute", "drop"):
        raise ValueError(f"unknown way to treat missing numbers: {nan}")
    rows = floatify(unify_nans(df), [c for c in continuous])
    labels: dict[str, dict[int, str]] = {}
    if classify and len(targets) == 1:
        rows, labels[targets[0]] = encode_target(rows, targets[0])
    elif classify:
        rows, labels = encode_targets(rows, targets)
    else:
        rows, _ = robust_targets(rows, targets)
    gone = set(unusable(rows.select(*[q(c) for c in (*continuous, *categorical, *targets)]), targets)) if (continuous or categorical) else set()
    cont, cat = [c for c in continuous if c not in gone], [c for c in categorical if c not in gone]
    out = Prepared(rows, [], cont, cat, list(targets), group, labels)
    if cont and nan == "drop":
        there = [q(c).isNotNull() & ~F.isnan(q(c).cast("double")) for c in cont]
        rows = rows.where(reduce(lambda a, b: a & b, there)).withColumns({c: q(c).cast("double") for c in cont})
    elif cont and nan == "impute":
        gaps = fit_imputer(rows, cont).indicators
        rows = rows.withColumns({f"{c}_NAN": (q(c).isNull() | F.isnan(q(c).cast("double"))).cast("double") for c in gaps})
        rows, out.indicators = iterative_impute(rows, cont), gaps
    elif cont:
        out.imputer = fit_imputer(rows, cont, nan)
        rows = out.imputer.apply(rows)
    if normalize and cont:
        out.normalizer = fit_normalizer(rows.select(*[q(c) for c in cont]), cont, robust)
        copies = rows.withColumns({f"{c}_norm": q(c) for c in cont})
        rows = Normalizer({f"{c}_norm": v for c, v in out.normalizer.ranges.items()}).apply(copies)
    if cat:
        out.deflater = fit_deflater(rows, cat)
        rows = out.deflater.apply(rows) if out.deflater.keep else rows
        usable = [c for c in cat if c not in unusable(rows.select(*[q(c) for c in cat]), [])]
        out.one_hot = fit_one_hot(rows, usable)
        raw = {f"{c}_raw": q(c) for c in usable}
        rows = out.one_hot.apply(rows.withColumns(raw))
    encoded = out.one_hot.names() if out.one_hot else []
    out.indicators = out.imputer.indicators if out.imputer else out.indicators
    out.features = [*cont, *[f"{c}_NAN" for c in out.indicators], *encoded]
    out.df = rows
    return out


def columns_of_level(prepared: Prepared, source: str) -> list[str]:
    """Encoded columns that come from the column ``source``: by lineage, never by pattern."""
    own = [source] if source in prepared.continuous else []
    own += [f"{source}_NAN"] if f"{source}_NAN" in prepared.features else []
    if prepared.one_hot and source in prepared.one_hot.levels:
        own += [n for n, _ in OneHot({source: prepared.one_hot.levels[source]}, prepared.one_hot.binary)._columns()]
    return own


