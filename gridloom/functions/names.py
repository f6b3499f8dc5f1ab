"""Column names: cleaning, duplicates, renames, natural order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Renames:
    """Old and new names by position."""

    pairs: list[tuple[str, str]] = field(default_factory=list)

    def apply(self, names: list[str]) -> list[str]:
        """User-given column names as they are called now; unknown ones stay."""
        new = dict(reversed(self.pairs))
        return [new.get(n, n) for n in names]

    def to_markdown(self) -> str:
        rows = [f"| `{a}` | `{b}` |" for a, b in self.pairs if a != b]
        return "\n".join(["| was | is |", "|---|---|", *rows]) if rows else "No column was renamed.\n"


def clean_name(name: str) -> str:
    """Blanks and characters with a meaning to patterns or models become underscores."""
    name = re.sub(r"[\\.^$*+?{}\[\]()| ,:\"]", "_", name)
    name = re.sub(r"_+", "_", name)
    return name[:-1] if name.endswith("_") else name


def unique_names(names: list[str]) -> list[str]:
    """Every instance of a repeated name gets ``__k``, k from 0."""
    times: dict[str, int] = {}
    for n in names:
        times[n] = times.get(n, 0) + 1
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if times[n] > 1:
            out.append(f"{n}__{seen.get(n, 0)}")
            seen[n] = seen.get(n, 0) + 1
        else:
            out.append(n)
    return out


def sanitize(df: DataFrame, target: str) -> tuple[DataFrame, Renames]:
    """Clean, unique column names; the target keeps its name, a feature that cleans to it gets ``feat_`` before.

    Raises if the target is missing or occurs twice. Columns are renamed by position, so repeated
    names are never looked up.
    """
    if df.columns.count(target) != 1:
        raise ValueError(f"target {target!r} must name exactly one column, it names {df.columns.count(target)}")
    cleaned = [c if c == target else clean_name(c) for c in df.columns]
    cleaned = [f"feat_{new}" if new == target and old != target else new for old, new in zip(df.columns, cleaned)]
    new = unique_names(cleaned)
    return df.toDF(*new), Renames(list(zip(df.columns, new)))


def model_safe(names: list[str]) -> list[str]:
    """Names without the characters some model writers refuse; repeats get ``_k``."""
    bare = [re.sub(r"[\[\]{},:\"]", "", n) for n in names]
    seen: dict[str, int] = {}
    out = []
    for n in bare:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def natural_key(name: str) -> list:
    """Sort key under which ``t2`` comes before ``t10``."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", str(name)) if p]
