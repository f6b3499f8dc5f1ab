"""Joins of a large table with a table of unique keys, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.durable import Stage, plan_bytes

#: Rows of a key from which it is joined by broadcast, and bytes read up to which no key is looked for.
HEAVY_ROWS = 1 << 20
SMALL = 1 << 26
#: Heavy keys broadcast at most; beyond, their rows are dealt over this many salts of their keys.
MOST_KEYS = 1 << 18
SALTS = 64


def lookup(big: DataFrame, table: DataFrame, key: str, how: str = "inner", heavy_rows: int = HEAVY_ROWS, small: int = SMALL, most_keys: int = MOST_KEYS) -> DataFrame:
    """``big`` with the columns of ``table``, whose ``key`` is unique; ``how`` is ``inner`` or ``left``.

    Keys with more than ``heavy_rows`` rows of ``big``, of which there can be no more than its rows
    over ``heavy_rows``, are counted and joined by broadcasting their rows of ``table``; should they be
    more than ``most_keys``, they are salted instead. Null keys match nothing and are never shuffled
    to one task. Both tables should be cheap to read twice. Small inputs are joined as they are.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    columns = [f for f in table.schema if f.name != key]
    present = big.where(F.col(key).isNotNull())
    nothing = big.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
    order = [*big.columns, *[f.name for f in columns]]
    if plan_bytes(big) <= small:
        joined = present.join(table, key, how)
    else:
        hot = present.groupBy(key).count().where(F.col("count") > heavy_rows).select(key)
        hot = Stage(big.sparkSession, "heavy").write(hot.join(table, key, "left" if how == "left" else "inner"))
        n = hot.count()
        if not n:
            joined = present.join(table, key, how)
        else:
            keys = hot.select(key)
            keys = F.broadcast(keys) if n <= most_keys else keys
            if n <= most_keys:
                first = present.join(F.broadcast(hot), key)
            else:
                salted = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                first = present.withColumn("_salt", F.floor(F.rand(0) * SALTS).cast("int")).join(salted, [key, "_salt"]).drop("_salt")
            rest = present.join(keys, key, "left_anti").join(table, key, how)
            joined = first.select(*order).unionByName(rest.select(*order))
    return joined.select(*order).unionByName(nothing.select(*order)) if how == "left" else joined.select(*order)
