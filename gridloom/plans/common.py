"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; a negative zero is a zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, columns: Sequence[str], digits: int = 6) -> str:
    fixed = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({fixed}) FROM ({sql})"


def long_sql(source: str, columns: Sequence[str], keep: str = "", cast: str = "DOUBLE", value: str = "x") -> str:
    keep = f"{keep}, " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS feature, CAST({c} AS {cast}) AS {value} FROM {source}" for c in columns)
