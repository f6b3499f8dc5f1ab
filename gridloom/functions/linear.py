"""Cross products of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, columns: Sequence[Column], masks: Sequence[Column]) -> list[np.ndarray]:
    """For each mask the matrix of the sums of x*y over its rows, for all pairs of ``columns``; nulls count as 0.

    A task multiplies its rows batch by batch and sends one row for each mask and column; these are
    added by (mask, column). The plan has one expression a column, and what reaches the driver is
    the matrices, whose size is that of the columns.
    """
    m, n_masks = len(columns), len(masks)
    rows = df.select(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)], *[F.coalesce(c, F.lit(False)).alias(f"m{i}") for i, c in enumerate(masks)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_masks, m, m))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy() for i in range(m)])
            for k in range(n_masks):
                own = x[b.column(m + k).to_numpy(zero_copy_only=False)]
                sums[k] += own.T @ own
        mask, row = np.divmod(np.arange(n_masks * m), m)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n_masks * m + 1) * m, pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(row), flat], ["mask", "row", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mask": pdf["mask"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

    schema = "mask long, row long, sums array<double>"
    out = np.zeros((len(masks), m, m))
    for r in rows.mapInArrow(multiply, schema).groupBy("mask", "row").applyInPandas(add, schema).collect():
        out[r["mask"], r["row"]] = r["sums"]
    return list(out)
