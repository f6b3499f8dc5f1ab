"""Long form: one scan turned into (feature, value) rows, shared by all per-feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: Sequence[str], keep: dict[str, Column] | None = None, cast: str = "double", value: str = "x") -> DataFrame:
    """``keep``, ``feature``, ``value``: one row for each row and column, nulls included; NaN becomes null.

    ``keep``: further columns by their new name. Columns are read by one projection, so the scan
    prunes to them; a column may be called anything.
    """
    keep = keep or {}
    cells = []
    for c in columns:
        v = F.col(f"`{c}`").cast(cast)
        v = F.when(~F.isnan(v), v) if cast == "double" else v
        cells.append(F.struct(F.lit(c).alias("feature"), v.alias(value)))
    return df.select(*[c.alias(k) for k, c in keep.items()], F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.feature", f"_c.{value}")
