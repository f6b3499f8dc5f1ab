"""Writers: the output tree of a run, tables in several formats, and Markdown."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The folders of a run.
FOLDERS = ("inspection", "prepared", "features/descriptions", "features/associations", "features/predictions", "selection/filter", "selection/embed", "selection/wrapper", "tuning", "results")


def run_key(options: dict) -> str:
    """Name of a run's folder: digest of its options in order of their names."""
    return hashlib.md5(json.dumps({k: options[k] for k in sorted(options)}, default=str).encode()).hexdigest()


def run_folder(root: str, options: dict) -> str:
    """The run's folder with its subfolders and ``options.json``, made where it is missing."""
    at = Path(root) / run_key(options)
    for f in FOLDERS:
        (at / f).mkdir(parents=True, exist_ok=True)
    (at / "options.json").write_text(json.dumps(options, default=str, sort_keys=True, indent=2))
    return str(at)


def fold_name(name: str, suffix: str, test_index: int | None = None) -> str:
    """``name.ext``, or ``test03/name_03.ext`` for a test set."""
    return f"{name}.{suffix}" if test_index is None else f"test{test_index:02d}/{name}_{test_index:02d}.{suffix}"


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """A table as Parquet, JSON lines, or CSV with a header, over whatever was there."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    if kind == "csv":
        w.option("header", "true").csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"don't know how to write {kind!r}")


def write_small_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV folder part; for tables of a few thousand rows."""
    write_table(df.coalesce(1), path, "csv")


def not_available(df: DataFrame, reason: str) -> DataFrame:
    """The table's columns without rows but one that says why: ``status``, ``reason`` added."""
    spark = df.sparkSession
    one = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes], F.lit("not available").alias("status"), F.lit(reason).alias("reason"))
    return one


def to_markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown, up to ``most`` rows."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]) + "\n"
