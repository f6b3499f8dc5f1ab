"""Readers: Parquet, CSV (with an option preamble), JSON, JSON lines, NumPy arrays and simple workbooks."""

from __future__ import annotations

import re
import shlex
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.results import stack_tables

#: Bytes at the head of a CSV in which its option preamble must end.
PREAMBLE_BYTES = 1 << 16


def _suffix(path: str) -> str:
    return re.sub(r"/+$", "", str(path)).rpartition(".")[2].lower()


def read_table(spark: SparkSession, path: str, separator: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """A table by its suffix: parquet, csv, json, jsonl, npy or xlsx; raises for others."""
    kind = _suffix(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = read_csv(spark, path, "\t" if kind == "tsv" else separator)[0]
    elif kind == "jsonl":
        df = spark.read.option("mode", "FAILFAST").json(path)
    elif kind == "json":
        df = read_json(spark, path)
    elif kind == "npy":
        df = read_npy(spark, path)
    elif kind in ("xlsx", "xlsm"):
        df = read_workbook(spark, path)[0]
    else:
        raise ValueError(f"don't know how to read {path!r}")
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or one record a line; told apart by the first character."""
    first = spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.option("mode", "FAILFAST").option("multiLine", str(array).lower()).json(path)


def _is_blank(line: str, separator: str) -> bool:
    return not line.replace(separator, "").strip()


def preamble(lines: Sequence[str], separator: str = ",") -> tuple[list[str], int]:
    """Options in the lines before the header, as arguments, and the header's line number.

    Option lines begin with ``--``, cell by cell or as one command; lines of separators only are skipped.
    """
    args: list[str] = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if _is_blank(bare, separator):
            continue
        if not bare.lstrip('"').startswith("--"):
            return args, i
        cells = [c.strip().strip('"') for c in bare.split(separator)]
        filled = [c for c in cells if c]
        if len(filled) == 1:
            args += shlex.split(filled[0])
        elif " " in filled[0]:  # a command whose value list held the separator
            args += shlex.split(separator.join(cells).rstrip(separator))
        else:
            args += filled
    return args, len(lines)


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, list[str]]:
    """A CSV with a header, and the options its preamble holds (none if there is no preamble).

    A plain CSV is read by Spark's reader as it is. With a preamble, which must end within its
    first lines, the lines up to the header are dropped from the file's text by their place, and the
    rest parsed; blank lines are skipped.
    """
    head = [r.value for r in spark.read.text(path).limit(200).collect()]
    args, at = preamble(head, separator)
    if at >= len(head) and len(head) == 200:
        raise ValueError("no header in the first 200 lines")
    reader = spark.read.option("sep", separator).option("inferSchema", "true")
    if at == 0:
        return reader.option("header", "true").csv(path), args
    if at >= len(head):
        return spark.createDataFrame([], "empty string"), args
    text = spark.read.text(path)
    if len(text.inputFiles()) > 1:
        raise ValueError("options before the header need a single file")
    # The lines up to the header are the first ones of the file's first block, known by their place, not by what they hold.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    head_line = (F.col("_metadata.file_block_start") == 0) & (place <= at)
    text = text.where(~head_line).select("value").where(F.trim(F.translate("value", separator, "")) != "")
    names = [c.strip().strip('"') for c in head[at].split(separator)]
    own = spark._jsparkSession.read().option("sep", separator).option("inferSchema", "true")
    body = DataFrame(own.csv(getattr(text._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark)
    return body.toDF(*names), args


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """A two-dimensional array as columns ``c0`` and on; other shapes raise. The file is mapped, not loaded."""
    import numpy as np
    import pandas as pd

    a = np.load(str(path).removeprefix("file://"), mmap_mode="r", allow_pickle=False)
    if a.ndim != 2:
        raise ValueError(f"need two dimensions, {path!r} has {a.ndim}")
    return spark.createDataFrame(pd.DataFrame(np.asarray(a), columns=[f"c{i}" for i in range(a.shape[1])]))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_cells(path: str) -> list[list[str | float | None]]:
    """Cells of a workbook's only sheet, read from its XML. More sheets are an error."""
    with zipfile.ZipFile(str(path).removeprefix("file://")) as z:
        names = z.namelist()
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if len(sheets) != 1:
            raise ValueError(f"need one sheet, {path!r} has {len(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{_MAIN}row"):
            cells: list[str | float | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind in ("str", "e"):
                    value = v.text
                elif kind == "b":
                    value = float(v.text)
                else:
                    value = float(v.text)
                cells.append(value)
            rows.append(cells)
    return rows


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A one-sheet workbook and the options in the rows above its header; columns without a name are dropped.

    A workbook holds a million rows at most, so it is read by the driver.
    """
    rows = [r for r in workbook_cells(path) if any(c not in (None, "") for c in r)]
    args: list[str] = []
    while rows and str(rows[0][0] or "").startswith("--"):
        filled = [str(int(c)) if isinstance(c, float) and c.is_integer() else str(c) for c in rows.pop(0) if c not in (None, "")]
        args += shlex.split(filled[0]) if len(filled) == 1 else filled
    if not rows:
        return spark.createDataFrame([], "empty string"), args
    named = [(i, str(n)) for i, n in enumerate(rows[0]) if n not in (None, "")]
    data = {}
    for i, n in named:
        column = [r[i] if i < len(r) else None for r in rows[1:]]
        numbers = all(c is None or isinstance(c, float) for c in column)
        whole = numbers and all(c is None or c.is_integer() for c in column)
        data[n] = [None if c is None else int(c) if whole else c if numbers else str(c) for c in column]
    kinds = {n: "long" if all(v is None or isinstance(v, int) for v in c) else "double" if all(v is None or isinstance(v, float) for v in c) else "string" for n, c in data.items()}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return spark.createDataFrame(list(zip(*data.values())), schema), args


def read_spreadsheet(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, list[str]]:
    """A CSV or workbook with the options it carries."""
    return read_workbook(spark, path) if _suffix(path) in ("xlsx", "xlsm") else read_csv(spark, path, separator)


def read_train_tests(spark: SparkSession, train: str, tests: Sequence[str], separator: str = ",") -> DataFrame:
    """Train and test files under each other, with ``_src``: 0 for train, i for the i-th test file. Raises if their columns differ."""
    return stack_tables([read_table(spark, p, separator) for p in (train, *tests)], "_src")


def read_texts(spark: SparkSession, paths: Sequence[str], text: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Text datasets under each other; columns some lack are null there, rows without a text are left out."""
    out = None
    for p in paths:
        t = read_table(spark, p)
        for a, b in (renames or {}).items():
            t = t.withColumnRenamed(a, b) if a in t.columns else t
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.where(F.col(text).isNotNull())
