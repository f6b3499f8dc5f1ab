"""Missing values at ingest: spellings of missing, and string columns that hold numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells that count as missing when read as text.
NAN_STRINGS = (
    "", "-1.#IND", "-1.#QNAN", "-nan", "-NaN", "#N/A N/A", "#N/A", "#NA", "<NA>", "1.#IND", "1.#QNAN",
    "n/a", "N/A", "NA", "nan", "NaN", "Nan", "None", "null", "NULL", "-", "_",
)


def unify(name: str, kind: T.DataType) -> Column:
    """A column with every spelling of missing as null; NaN too."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.StringType):
        return F.when(~c.isin(*NAN_STRINGS), c)
    return c


def unify_nans(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing spellings and NaN become null in ``columns`` (all by default), in one projection."""
    chosen = set(columns or df.columns)
    return df.select(*[(unify(f.name, f.dataType) if f.name in chosen else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def numeric_strings(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """String columns whose every non-null value is a number, by one aggregate over all of them."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return []
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"b{i}") for i, c in enumerate(names)]
    some = [F.count(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(names)]
    row = df.agg(*bad, *some).first()
    return [c for i, c in enumerate(names) if not row[f"b{i}"] and row[f"s{i}"]]


def floatify(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Casts string columns to double that hold numbers only; a column is cast as a whole or not at all."""
    names = set(numeric_strings(df, columns))
    return df.select(*[(F.col(f"`{c}`").try_cast("double") if c in names else F.col(f"`{c}`")).alias(c) for c in df.columns])


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature``, ``n``, ``n_null``, ``nan_freq`` of each column, from one scan."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = df.select(*[unify(c, kinds[c]).isNull().cast("long").alias(c) for c in columns])
    sums = row.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).alias(f"s{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("n_null")) for i, c in enumerate(columns)]))
    return sums.select("n", pairs.alias("p")).select("p.feature", "n", "p.n_null", (F.col("p.n_null") / F.col("n")).alias("nan_freq"))
