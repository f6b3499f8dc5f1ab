"""Saved runs: prepared tables, result tables and options, written and read through Spark's file systems only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import prepare as P
from gridloom.options import Options
from gridloom.sources import writers


def _file(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """A small text file, over whatever was there."""
    path, fs = _file(spark, at)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, at: str) -> str:
    found = spark.read.text(at, wholetext=True).first()
    return found[0] if found else ""


def exists(spark: SparkSession, at: str) -> bool:
    path, fs = _file(spark, at)
    return fs.exists(path)


def folders(spark: SparkSession, at: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it isn't there."""
    path, fs = _file(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def save_prepared(p: P.Prepared, at: str) -> None:
    """The table as Parquet, and the roles of its columns with the fitted transforms as JSON."""
    spark = p.df.sparkSession
    writers.write_table(p.df, f"{at}/table", "parquet")
    parts = {k: getattr(p, k) for k in ("features", "continuous", "categorical", "targets", "group", "labels", "indicators")}
    parts |= {k: asdict(v) if (v := getattr(p, k)) is not None else None for k in ("imputer", "normalizer", "deflater", "one_hot")}
    write_text(spark, f"{at}/roles.json", json.dumps(parts, indent=2))


def load_prepared(spark: SparkSession, at: str) -> P.Prepared:
    """What ``save_prepared`` wrote; raises if it isn't there."""
    parts = json.loads(read_text(spark, f"{at}/roles.json"))
    parts["labels"] = {t: {int(k): v for k, v in labels.items()} for t, labels in parts["labels"].items()}
    if parts["normalizer"]:
        parts["normalizer"]["ranges"] = {c: tuple(v) for c, v in parts["normalizer"]["ranges"].items()}
    made = {"imputer": P.Imputer, "normalizer": P.Normalizer, "deflater": P.Deflater, "one_hot": P.OneHot}
    for k, build in made.items():
        parts[k] = build(**parts[k]) if parts[k] is not None else None
    return P.Prepared(spark.read.parquet(f"{at}/table"), **parts)


@dataclass
class SavedRun:
    """A run read back: its options, result tables by name, chosen features and tuned parameters."""

    options: Options
    tables: dict[str, DataFrame]
    selected: dict[str, list[str]]
    tuned: dict[str, dict]
    prepared: P.Prepared | None


#: Where a table also goes as CSV, by the beginning of its name.
PLACES = {"associations_": "features/associations", "predictions_": "features/predictions", "describe_": "features/descriptions", "selection_": "selection/filter", "final": "results", "inspection": "inspection"}


def save_run(folder: str, options: Options, tables: dict[str, DataFrame], selected: dict, tuned: dict, report: str, prepared: P.Prepared | None, per_row: tuple[str, ...] = ()) -> None:
    """All of a run in ``folder``: every table as Parquet, those of few rows as CSV too, texts as JSON and Markdown. Without predictions wanted, the ``per_row`` tables stay out."""
    spark = next(iter(tables.values())).sparkSession
    write_text(spark, f"{folder}/options.json", json.dumps(options.to_dict(), default=str, sort_keys=True, indent=2))
    for name, t in tables.items():
        if options.no_preds and name in per_row:
            continue
        writers.write_table(t, f"{folder}/results/{name}", "parquet")
        place = next((v for k, v in PLACES.items() if name.startswith(k)), None)
        if place:
            flat = t.select(*[c for c, kind in t.dtypes if not kind.startswith(("array", "map", "struct"))])
            writers.write_small_csv(flat, f"{folder}/{place}/{name}.csv")
            if name == "final":
                write_text(spark, f"{folder}/results/{name}.md", writers.to_markdown(flat))
    write_text(spark, f"{folder}/results/report.md", report)
    write_text(spark, f"{folder}/tuning/tuned.json", json.dumps(tuned, default=str, indent=2))
    write_text(spark, f"{folder}/selection/selected.json", json.dumps(selected, indent=2))
    write_text(spark, f"{folder}/selection/selected.md", "\n".join(f"* {k}: {', '.join(v) or 'none'}" for k, v in selected.items()) + "\n")
    if prepared is not None:
        save_prepared(prepared, f"{folder}/prepared")


def load_run(spark: SparkSession, folder: str) -> SavedRun | None:
    """A finished run of ``save_run``, or None if the folder holds none."""
    if not exists(spark, f"{folder}/selection/selected.md"):
        return None
    text = lambda name: json.loads(read_text(spark, f"{folder}/{name}"))
    tables = {n: spark.read.parquet(f"{folder}/results/{n}") for n in folders(spark, f"{folder}/results") if not n.endswith(".csv")}
    prepared = load_prepared(spark, f"{folder}/prepared") if exists(spark, f"{folder}/prepared/roles.json") else None
    return SavedRun(Options.from_dict(text("options.json")), tables, text("selection/selected.json"), text("tuning/tuned.json"), prepared)


def csv_copy(spark: SparkSession, df: DataFrame, at: str, kind: str) -> DataFrame:
    """A table written in one of the formats and read back by its suffix; values as text."""
    from gridloom.sources import readers

    writers.write_table(df, f"{at}.{kind if kind != 'json' else 'jsonl'}", kind)
    back = readers.read_table(spark, f"{at}.{kind if kind != 'json' else 'jsonl'}")
    return back.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
