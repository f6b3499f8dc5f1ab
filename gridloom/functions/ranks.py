"""Ranks, running counts, positions and quantiles of very large groups without a task that holds one.

Values are first counted per group, which also settles ties. Small inputs are then ordered by one
window a group. Larger ones are range-partitioned by group and value into as many buckets as their
size asks for; windows run inside a bucket only, and the totals of the buckets before it, a small
table, are added. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.durable import Stage, plan_bytes

#: Bytes read up to which a window may hold a group, and bytes of a bucket beyond.
SMALL = 1 << 24
BUCKET = 1 << 27
MOST_BUCKETS = 1 << 16
_UNKNOWN = 1 << 60


def _all(c: Sequence[str]) -> list[Column]:
    return [F.col(f"`{x}`") for x in c]


def is_small(df: DataFrame) -> bool:
    return plan_bytes(df) <= SMALL


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_b``, a bucket's number; within ``keys``, rows of a lower bucket come first in ``order``.

    Equal rows may lie in one bucket only. Buckets are ranges of (``keys``, ``order``), so a group of any size is cut
    into its share of them. The table is written once, because ranges found anew could differ.
    """
    size, least = plan_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = least if size >= _UNKNOWN else min(MOST_BUCKETS, max(least, size // BUCKET))
    return Stage(df.sparkSession, "ranges").write(df.repartitionByRange(n, *_all([*keys, *order])).withColumn("_b", F.spark_partition_id()))


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by ``keys``, null keys being equal; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{i}"))
    return left.join(other, on, how).drop(*[f"_k_{i}" for i in range(len(keys))])


def _offsets(parts: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``keys``, ``_b``, and for each sum ``_o_`` (buckets before) and ``_t_`` (whole group) of a table with a row a bucket and group."""
    w = W.partitionBy(*_all(keys))
    upto = w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*_all(keys), "_b", *[F.coalesce(F.sum(f"_p_{c}").over(upto), F.lit(0)).alias(f"_o_{c}") for c in sums], *[F.sum(f"_p_{c}").over(w).alias(f"_t_{c}") for c in sums])


def accumulate(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Every row with ``_r_{c}``, the sum of c over its group up to the row, and ``_t_{c}``, that over the group.

    Rows should differ in (``keys``, ``order``); else their order among each other is open.
    """
    keys, sums = list(keys), list(sums)
    if is_small(df):
        w = W.partitionBy(*_all(keys)).orderBy(*_all(order))
        upto, every = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.select("*", *[F.sum(c).over(upto).alias(f"_r_{c}") for c in sums], *[F.sum(c).over(every).alias(f"_t_{c}") for c in sums])
    placed = bucketed(df, keys, order)
    before = _offsets(placed.groupBy(*_all(keys), "_b").agg(*[F.sum(c).alias(f"_p_{c}") for c in sums]), keys, sums)
    inside = W.partitionBy(*_all(keys), "_b").orderBy(*_all(order)).rowsBetween(W.unboundedPreceding, 0)
    ranked = _join(placed.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums]), before, [*keys, "_b"])
    return ranked.withColumns({f"_r_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_b", *[f"{p}{c}" for c in sums for p in ("_i_", "_o_")])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Every row with ``name``, the first order column of the row before it in its group; null for the first row."""
    keys, x = list(keys), order[0]
    if is_small(df):
        return df.withColumn(name, F.lag(x).over(W.partitionBy(*_all(keys)).orderBy(*_all(order))))
    placed = bucketed(df, keys, order)
    ends = placed.groupBy(*_all(keys), "_b").agg(F.max(x).alias("_hi"))
    ends = ends.select(*_all(keys), "_b", F.lag("_hi").over(W.partitionBy(*_all(keys)).orderBy("_b")).alias("_before"))
    inside = placed.withColumn("_in", F.lag(x).over(W.partitionBy(*_all(keys), "_b").orderBy(*_all(order))))
    return _join(inside, ends, [*keys, "_b"]).withColumn(name, F.coalesce("_in", "_before")).drop("_b", "_in", "_before")


def value_counts(df: DataFrame, keys: Sequence[str], x: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of each group with running counts and average ranks.

    ``counts``: further counters, name -> 0/1 or number column, each also summed up to the value.
    Rows with a null ``x`` are left out; NaN is the largest value; null keys are a group. Returns
    ``keys``, ``x``, ``n``, ``cum`` (rows at or below the value), ``avg_rank`` (from 1), ``total`` (of
    the group), and ``c``, ``cum_c`` for each counter.
    """
    counts, keys = counts or {}, list(keys)
    freq = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in counts.items()])
    ranked = accumulate(freq, keys, [x], ["n", *counts])
    cum = F.col("_r_n")
    return ranked.select(
        *keys, x, "n", cum.alias("cum"), (cum - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"), F.col("_t_n").alias("total"),
        *[F.col(c) for c in counts], *[F.col(f"_r_{c}").alias(f"cum_{c}") for c in counts],
    )


def quantiles(df: DataFrame, keys: Sequence[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column for each wanted one, per group; null and NaN keys as in ``value_counts``."""
    keys = list(keys)
    if is_small(df):
        levels = F.array(*[F.lit(float(q)) for q in wanted.values()])
        found = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.percentile(F.col(x).cast("double"), levels).alias("_q"))
        return found.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(wanted)])
    ranked = value_counts(df, keys, x)
    aggs = []
    for name, q in wanted.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        low, part = F.floor(at), at - F.floor(at)
        lower = F.min(F.when(F.col("cum") >= low + 1, F.col(x)))
        upper = F.min(F.when(F.col("cum") >= F.least(low + 2, F.col("total")), F.col(x)))
        aggs.append((lower + (upper - lower) * F.max(part)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible random order of rows: hexadecimal digest of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hashed_positions(df: DataFrame, keys: Sequence[str], seed: int, id_col: str, name: str = "pos") -> DataFrame:
    """Position ``name`` (from 1) of each row of its group in hash order, and the group's size ``{name}_of``.

    Digests are spread evenly, so their first digits are the buckets, as many as the size of the
    input asks for. Null keys are a group.
    """
    keys, size = list(keys), plan_bytes(df)
    h = df.withColumn("_h", hash_order(seed, id_col))
    if size <= SMALL:
        w = W.partitionBy(*_all(keys)).orderBy("_h", id_col)
        return h.withColumns({name: F.row_number().over(w), f"{name}_of": F.count("*").over(W.partitionBy(*_all(keys)))}).drop("_h")
    digits = 2 if size >= _UNKNOWN else min(7, max(1, (size // BUCKET).bit_length() // 4 + 1))
    h = h.withColumn("_b", F.substring("_h", 1, digits))
    before = _offsets(h.groupBy(*_all(keys), "_b").agg(F.count("*").alias("_p_n")), keys, ["n"])
    ranked = _join(h.withColumn("_i", F.row_number().over(W.partitionBy(*_all(keys), "_b").orderBy("_h", id_col))), before, [*keys, "_b"])
    return ranked.withColumns({name: F.col("_i") + F.col("_o_n"), f"{name}_of": F.col("_t_n")}).drop("_h", "_b", "_i", "_o_n", "_t_n")


def running_sums(df: DataFrame, keys: Sequence[str], x: str, tie: str, sums: dict[str, Column]) -> DataFrame:
    """Every row with its place ``i`` (from 1) in its group by ``x`` then ``tie``, running ``sums`` and the group's size ``n``.

    Rows with a null ``x`` are left out; ``tie`` should be unique. A value that very many rows share
    is cut along the tie.
    """
    rows = df.where(F.col(x).isNotNull()).select("*", F.lit(1).cast("long").alias("_one"), *[c.alias(f"_v_{k}") for k, c in sums.items()])
    out = accumulate(rows, keys, [x, tie], ["_one", *[f"_v_{k}" for k in sums]])
    new = {"i": F.col("_r__one"), **{k: F.col(f"_r__v_{k}") for k in sums}}
    return out.select(*[c for c in df.columns if c not in new and c != "n"], *[c.alias(k) for k, c in new.items()], F.col("_t__one").alias("n"))
