"""Tables of results: wide forms, best rows, ranges and set operations over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.names import natural_key

HIGHER = {"acc": True, "auroc": True, "auc": True, "sens": True, "spec": True, "f1": True, "bal-acc": True, "r2": True, "mae": False, "msqe": False, "mdae": False}


def wide_table(long: DataFrame, keys: Sequence[str], metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """A column for each metric, the mean of its values; rows without any are left out. Metrics are named, so no pass looks for them."""
    aggs = [F.avg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics]
    some = F.coalesce(*[F.col(f"`{m}`") for m in metrics])
    return long.where(F.col(value).isNotNull()).groupBy(*keys).agg(*aggs).where(some.isNotNull())


def sorted_by_metric(df: DataFrame, metric: str | None = None) -> DataFrame:
    """Best rows first by ``metric``, or by ``mae`` or ``acc``, whichever the table has."""
    metric = metric or next((m for m in ("mae", "acc", "auc") if m in df.columns), None)
    if metric is None:
        raise ValueError("no metric to sort by")
    rest = [c for c in df.columns if c != metric]
    return df.orderBy(F.desc_nulls_last(metric) if HIGHER.get(metric, True) else F.asc_nulls_last(metric), *rest)


def metric_by_target(long: DataFrame, keys: Sequence[str], metric: str, targets: Sequence[str]) -> DataFrame:
    """One metric's mean for each target, in natural order of the targets, and ``mean`` over those a row has."""
    names = sorted(targets, key=natural_key)
    rows = long.where((F.col("metric") == metric) & F.col("value").isNotNull())
    wide = rows.groupBy(*keys).agg(*[F.avg(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in names])
    filled = F.array_compact(F.array(*[F.col(f"`{t}`") for t in names]))
    return wide.withColumn("mean", F.aggregate(filled, F.lit(0.0), lambda a, v: a + v) / F.size(filled))


def top_per_group(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int = 1, higher: bool = True) -> DataFrame:
    """The n best rows of each group, ties by ``tie``. Spark keeps n rows a task before the shuffle (its group limit)."""
    order = F.desc_nulls_last(score) if higher else F.asc_nulls_last(score)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie))).where(F.col("rank") <= n)


def grouped_summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Count, mean, extremes and the usual percentiles of x in each group."""
    from gridloom.functions.ranks import quantiles

    rows = df.where(F.col(x).isNotNull())
    if dict(df.dtypes)[x] in ("double", "float"):
        rows = rows.where(~F.isnan(x))
    basic = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    qs = quantiles(rows.select(*keys, x), keys, x, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return basic.join(qs, list(keys))


def summary_ranges(tables: Sequence[DataFrame], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Over several result tables: each metric's mean and its range as text, ``0.700–0.900``. A key that one table holds twice is an error."""
    tagged = [t.select(*keys, *metrics, F.lit(i).alias("_t")) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, tagged)
    twice = rows.groupBy(*keys, "_t").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a table holds a row twice")
    aggs = []
    short = lambda c: F.round(F.round(c.cast("double"), 9), 3)  # noqa: E731  half up, untouched by the order of sums
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.format_string("%.3f–%.3f", short(F.min(m)), short(F.max(m))).alias(f"{m}_range")]
    return rows.groupBy(*keys).agg(*aggs)


def stack_tables(tables: Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """Tables under each other by column name, with the table's number in ``tag``. Raises if their columns differ."""
    names = [sorted(t.columns) for t in tables]
    for i, n in enumerate(names[1:], 1):
        if n != names[0]:
            raise ValueError(f"table {i} differs in columns: {sorted(set(n) ^ set(names[0]))}")
    tagged = [t.withColumn(tag, F.lit(i)) if tag else t for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, tagged)


def column_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that only one of the tables has."""
    return sorted(set(a.columns) ^ set(b.columns))


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both tables, nulls equal."""
    return a.intersect(b.select(*a.columns))


def missing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks, nulls equal."""
    return a.subtract(b.select(*a.columns))


def latest_versions(df: DataFrame, name: str, version: str) -> DataFrame:
    """Of each name the row of its highest version."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(name).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def left_join_predictions(base: DataFrame, others: dict[str, DataFrame], id_col: str, columns: Sequence[str]) -> DataFrame:
    """The base with each model's columns as ``{column}__{model}``; rows a model lacks have nulls.

    The models are stacked and turned wide by one aggregate, then joined once, instead of a join a model.
    """
    named = [t.select(F.col(id_col), F.lit(m).alias("_m"), *columns) for m, t in others.items()]
    wide = reduce(DataFrame.unionByName, named).groupBy(id_col).agg(*[F.max(F.when(F.col("_m") == m, F.col(c))).alias(f"{c}__{m}") for m in others for c in columns])
    return base.join(wide, id_col, "left")


def align_to(reference: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """``other`` for exactly the reference's identifiers; raises if one is missing, naming a few."""
    lost = reference.select(id_col).join(other.select(id_col), id_col, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"identifiers without a row: {[r[0] for r in lost]}")
    return reference.select(id_col).join(other, id_col)


def bin_lookup(df: DataFrame, x: str, edges: Sequence[float], name: str = "bin") -> DataFrame:
    """Half-open bins by an edge list, the last one closed; values outside get the first or last bin, missing ones null.

    The edges are a literal, so the lookup is a projection and no join.
    """
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    at = F.aggregate(inner, F.lit(0), lambda a, e: a + (e <= F.col(x)).cast("int"))
    return df.withColumn(name, F.when(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")), at))


def bin_join(df: DataFrame, x: str, bins: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with the interval [low, high) that holds x, for disjoint intervals given as a table; rows in none have nulls.

    The intervals' lower ends are merged into the rows' order by buckets: an equi-join on the bucket
    of a fixed grid replaces comparing every row with every interval.
    """
    ends = bins.agg(F.min(low), F.max(high), F.count("*")).first()
    if not ends[2]:
        return df.join(bins.limit(0), F.lit(False), "left")
    width = max((float(ends[1]) - float(ends[0])) / max(1, ends[2]), 1e-300)
    cell = lambda c: F.floor((c.cast("double") - float(ends[0])) / width)
    spread = bins.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    left = df.withColumn("_cell", cell(F.col(x)))
    cond = (left["_cell"] == spread["_cell"]) & (F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))
    return left.join(spread, cond, "left").drop("_cell")


def nearest(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int = 5, metric: str = "l2", most_queries: int = 65_536) -> DataFrame:
    """The k nearest rows of each query: ``query_id``, ``id``, ``distance``, ``rank``; ties by identifier.

    ``queries``: ``query_id`` and ``vector``, any number; they are taken in parts of about
    ``most_queries``, told by a hash of ``query_id``. A part is broadcast once; each task streams its
    rows against it in blocks and keeps k rows a query, which are merged by rank. Metrics: ``l2``, ``cosine``, ``correlation``. Rows without a vector are left out.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.where(F.col("vector").isNotNull())
    n = asked.count()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    if n > most_queries:
        parts = -(-n // most_queries) * 2
        own = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
        return reduce(DataFrame.unionByName, [nearest(df, id_col, vector, part, k, metric, 1 << 62) for part in own])
    found = asked.collect()

    def unit(m: np.ndarray) -> np.ndarray:
        if metric == "correlation":
            m = m - m.mean(axis=1, keepdims=True)
        if metric != "l2":
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n > 0, n, 1.0)
        return m

    ids = np.array([r.query_id for r in found], np.int64)
    shared = df.sparkSession.sparkContext.broadcast((ids, unit(np.array([r.vector for r in found], np.float64))))

    def search(batches):
        qid, qs = shared.value
        best_d = np.full((len(qid), k), np.inf)
        best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            rows = unit(b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1))
            for s in range(0, len(rows), 4096):
                part, own = rows[s : s + 4096], at[s : s + 4096]
                if metric == "l2":
                    d = np.sqrt(np.maximum(0, (qs**2).sum(1)[:, None] + (part**2).sum(1) - 2 * qs @ part.T))
                else:
                    d = 1 - qs @ part.T
                i = np.broadcast_to(own, d.shape)
                if d.shape[1] > 4 * k:  # all up to the k-th distance, ties with it included, then only these are sorted
                    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
                    width = int((d <= limit[:, None]).sum(1).max())
                    near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    d, i = np.take_along_axis(d, near, 1), np.take_along_axis(i, near, 1)
                d, i = np.hstack([best_d, d]), np.hstack([best_i, i])
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        ok = np.isfinite(best_d)
        q = np.broadcast_to(qid[:, None], best_d.shape)[ok]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_i[ok]), pa.array(best_d[ok])], ["query_id", "id", "distance"])

    base = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    near = base.mapInArrow(search, "query_id long, id long, distance double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


