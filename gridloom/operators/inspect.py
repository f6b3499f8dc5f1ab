"""Inference of each column's semantic type.

All columns are turned into (column, text) rows once and counted; what the rules need of a column is
a handful of aggregates over its counted values, and the rules then run on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.nulls import NAN_STRINGS
from gridloom.functions.ranks import previous
from gridloom.operators.shape import melt

# What a column's name holds, in lower case, that speaks for a category; the second list needs one of the marks behind it.
CATEGORY_WORDS = ("type", "kind", "city", "race", "ancestry", "town", "country", "occupation", "relig", "state", "zip", "code", "name", "gender", "sex", "status")
CATEGORY_VERBS = ("is", "has", "not")
VERB_MARKS = ("_", " ", "-", ".")
# Bounds of common scales, and the forms of times.
SCALE_ENDS = (4, 5, 6, 7, 9, 10, 99, 100)
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy", "HH:mm:ss", "HH:mm", "dd MMM yyyy", "MMM dd, yyyy")

#: Characters beyond which a cell is counted by its digest.
LONG = 256

CERTAIN = ("Binary", "BinaryViaNan", "BinaryPlusNan", "CertainCat", "CertainCont", "CertainOrd", "CertainId", "CertainTime", "Const")
OVERRIDES_USER = (*CERTAIN, "MaybeId", "MaybeTime")
DROPPED = ("CertainTime", "MaybeTime", "Const", "CertainId", "MaybeId")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What the rules need of each column, one row a column.

    ``n``, ``n_null``, ``n_distinct`` (missing left out), ``max_count``, ``n_int``, ``n_float``,
    ``n_time`` (rows of that form), ``n_dot`` (rows with a point), ``n_small`` (levels under 20
    rows), ``int_min``, ``int_max``, ``n_gaps``, ``n_unit_gaps``, ``gap_min``, ``gap_max`` (of sorted
    distinct whole numbers).
    """
    long = melt(df, columns, cast="string", value="v")
    v, c = F.col("v"), F.col("c")
    missing = v.isNull() | v.isin(*NAN_STRINGS)
    as_float = v.try_cast("double").isNotNull()
    forms = {
        "is_int": v.rlike(r"^-?\d+$"), "is_float": as_float, "has_dot": v.contains("."),
        "is_time": ~as_float & v.rlike(r"\d") & F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for p in DATE_PATTERNS]).isNotNull(),
    }
    # A long cell's form is settled at once, and its digest stands for it; all others are counted first.
    cells = long.select("feature", F.when(~missing, v).alias("v"))
    big = F.length(v) > LONG
    key = F.when(big, F.concat(F.lit("\0"), F.sha2(v, 256))).otherwise(v)
    counts = cells.groupBy("feature", key.alias("v"), *[F.when(big, f).alias(f"_{k}") for k, f in forms.items()]).agg(F.count("*").alias("c"))
    counts = counts.select("feature", "v", "c", *[F.coalesce(F.col(f"_{k}"), f).alias(k) for k, f in forms.items()])
    counts = counts.withColumn("i", F.when(F.col("is_int"), v.try_cast("long")))
    counts = previous(counts, ["feature"], ["i", "v"], "before").withColumn("d", F.col("i") - F.col("before"))
    here = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    d = F.when(F.col("d") != 0, F.col("d"))  # 7 and 07 are one number
    out = counts.groupBy("feature").agg(
        F.sum("c").alias("n"), here(v.isNull()).alias("n_null"), F.count("v").alias("n_distinct"), F.max(F.when(v.isNotNull(), c)).alias("max_count"),
        here(F.col("is_int")).alias("n_int"), here(F.col("is_float")).alias("n_float"), here(F.col("is_time")).alias("n_time"), here(F.col("has_dot")).alias("n_dot"),
        F.count_if(v.isNotNull() & (c < 20)).alias("n_small"), F.min("i").alias("int_min"), F.max("i").alias("int_max"),
        F.count(d).alias("n_gaps"), F.count_if(d == 1).alias("n_unit_gaps"), F.min(d).alias("gap_min"), F.max(d).alias("gap_max"),
    )
    some = F.col("n_gaps") > 0
    return out.withColumns({k: F.when(some, F.col(k)) for k in ("n_unit_gaps", "n_gaps")})


@dataclass
class Inference:
    """Every kind a column may be, with the reason."""

    kinds: list[tuple[str, str]] = field(default_factory=list)

    def certain(self) -> list[tuple[str, str]]:
        return [k for k in self.kinds if k[0] in CERTAIN]

    def maybe(self) -> list[tuple[str, str]]:
        return [k for k in self.kinds if k[0] not in CERTAIN]


def birthday(m: int, n: int) -> float:
    """Chance that n draws from m values are all different."""
    if n > m:
        return 0.0
    return math.exp(sum(math.log1p(-i / m) for i in range(1, n - 1))) if n < 200_000 else 0.0


def infer_ordinal(r) -> tuple[str, str] | None:
    present = r.n - r.n_null
    if not r.n_int or r.n_int < present:
        return None
    if r.n_distinct == 1:
        return ("CertainOrd", "one whole number")
    if r.int_min not in (0, 1):
        return ("CertainOrd", "whole numbers that don't start at 0 or 1")
    if r.n_distinct == present and birthday(r.int_max - r.int_min + 1, present) >= 0.5:
        return ("MaybeOrd", "all different, as draws from so wide a range would be")
    if r.gap_min == r.gap_max:
        return ("CertainOrd", "0 and 1 only") if r.int_max == 1 else ("MaybeOrd", "evenly spaced")
    if r.n_gaps and r.n_unit_gaps / r.n_gaps >= 0.8:
        return ("MaybeOrd", "mostly consecutive")
    if r.n_distinct / (r.int_max - r.int_min + 1) >= 0.8:
        return ("MaybeOrd", "most of the range occurs")
    if r.int_max in SCALE_ENDS:
        return ("MaybeOrd", "ends like a common scale")
    return None


def infer_column(r, kind: T.DataType) -> Inference:
    """The rules in order, on a row of ``profile``; the physical type decides where it is certain."""
    present = r.n - r.n_null
    levels = r.n_distinct + (1 if r.n_null else 0)
    if levels <= 1:
        return Inference([("Const", "a single value")])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Inference([("CertainTime", "stored as a time")])
    out = Inference()
    all_int, all_float = r.n_int == present, r.n_float == present
    if not all_float and r.n_time:
        share = r.n_time / present
        if share == 1:
            return Inference([("CertainTime", "every value reads as a time")])
        if share > 0.5:
            return Inference([("CertainTime", "most values read as times")])
        if share > 0.3:
            out.kinds.append(("MaybeTime", "many values read as times"))
    certainly_float = all_float and not all_int
    if not certainly_float and present >= r.n / 2:
        if r.max_count == 1:
            return Inference([("CertainId", "no value occurs twice")])
        if r.n_distinct >= present / 2 and not all_int:
            out.kinds.append(("MaybeId", "most values occur once"))
    if levels == 2:
        return Inference([("BinaryViaNan", "one value and missing") if r.n_null else ("Binary", "two values")])
    if levels == 3 and r.n_null:
        return Inference([("BinaryPlusNan", "two values and missing")])
    ordinal = infer_ordinal(r)
    if ordinal:
        out.kinds.append(ordinal)
    if all_int:
        if r.n_dot:
            out.kinds.append(("MaybeCont", "whole numbers written with a point"))
    elif certainly_float:
        return Inference([("CertainCont", "numbers with fractions")])
    elif r.n_float and 1 - r.n_float / present > 0.2:
        out.kinds.append(("MaybeCont", "some values are numbers"))
    if any(k[0] in ("MaybeId", "MaybeTime") for k in out.kinds):
        return out
    if not all_int and not all_float:
        out.kinds.append(("CertainCat", "not numbers"))
    elif all_int and not (ordinal and ordinal[0] == "CertainOrd"):
        out.kinds.append(("MaybeCat", "few whole numbers may be names"))
    return out


def category_name(name: str) -> bool:
    low = name.lower()
    return any(w in low for w in CATEGORY_WORDS) or any(v + m in low for v in CATEGORY_VERBS for m in VERB_MARKS)


def settle(name: str, found: Inference, r, categoricals: Sequence[str], ordinals: Sequence[str]) -> tuple[str, str, str | None]:
    """One kind for a column: ``(kind, reason, user's kind)``."""
    user = "ordinal" if name in ordinals else "categorical" if name in categoricals else None
    sure, maybe = found.certain(), found.maybe()
    strong = [k for k in found.kinds if k[0] in OVERRIDES_USER and k[0] not in ("CertainCat", "CertainOrd", "CertainCont")]
    if strong:
        return (*strong[0], user)
    if user == "ordinal":
        return ("UserOrd", "asked for", user)
    if user == "categorical":
        return ("UserCat", "asked for", user) if not any(k[0] == "CertainCont" for k in sure) else ("CertainCont", "numbers with fractions, against the wish", user)
    if sure:
        return (*sure[0], user)
    if len(maybe) == 1:
        return (*maybe[0], user)
    if any(k[0] == "MaybeCont" for k in maybe) and r.n_dot:
        return ("CoercedCont", "unclear, written with points", user)
    if category_name(name) and not r.n_small:
        return ("CoercedCat", "unclear, named like a category without rare levels", user)
    return ("CoercedOrd", "unclear whole numbers", user)


@dataclass
class Schema:
    """Inferred kinds of a table's columns."""

    kinds: dict[str, tuple[str, str, str | None]]

    def of(self, *names: str) -> list[str]:
        return [c for c, k in self.kinds.items() if any(k[0].endswith(n) for n in names)]

    @property
    def continuous(self) -> list[str]:
        return self.of("Cont") + self.of("Ord")

    @property
    def categorical(self) -> list[str]:
        return self.of("Cat", "Binary", "BinaryViaNan", "BinaryPlusNan")

    @property
    def dropped(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k[0] in DROPPED]

    def table(self, spark) -> DataFrame:
        rows = [(c, k[2], k[0], k[1]) for c, k in self.kinds.items()]
        return spark.createDataFrame(rows, "feature_name string, user string, inferred string, reason string")

    def to_markdown(self) -> str:
        return "\n".join(["| column | kind | reason |", "|---|---|---|", *[f"| {c} | {k[0]} | {k[1]} |" for c, k in self.kinds.items()]])


def inspect(df: DataFrame, target: str | None = None, categoricals: Sequence[str] = (), ordinals: Sequence[str] = (), drops: Sequence[str] = (), group: str | None = None) -> Schema:
    """Kinds of all columns but target, group and ``drops``. A name given as both categorical and ordinal is ordinal. An empty table makes all columns constant."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = [c for c in df.columns if c not in {target, group, *drops}]
    flat = [c for c in names if not isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    rows = {r.feature: r for r in profile(df, flat).collect()} if flat else {}
    out = {}
    for c in flat:
        r = rows.get(c)
        out[c] = settle(c, infer_column(r, kinds[c]), r, categoricals, ordinals) if r else ("Const", "no rows", None)
    return Schema(out)


def inspect_target(df: DataFrame, target: str, classify: bool) -> DataFrame:
    """Of a class target ``p_max``, ``p_min``, ``p_nan``, ``n_classes``; of a number ``mean``, ``var``, ``p_nan``, ``varies``."""
    if classify:
        counts = df.groupBy(F.col(target).cast("string").alias("c")).agg(F.count("*").alias("k"))
        return counts.agg(
            (F.max(F.when(F.col("c").isNotNull(), F.col("k"))) / F.sum("k")).alias("p_max"), (F.min(F.when(F.col("c").isNotNull(), F.col("k"))) / F.sum("k")).alias("p_min"),
            (F.coalesce(F.sum(F.when(F.col("c").isNull(), F.col("k"))), F.lit(0)) / F.sum("k")).alias("p_nan"), F.count("c").alias("n_classes"),
        )
    x = F.col(target).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.agg(F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.avg(x.isNull().cast("double")).alias("p_nan"), (F.var_pop(x) > 0).cast("int").alias("varies"))
