"""Label normalisation shared by operators: the plain form of a label and missing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain forms that count as a missing label.
MISSING_LABELS = ("", "na", "n/a", "nan", "none", "null", "-")


def plain(col: Column | str) -> Column:
    """Label without blanks and tabs at its ends, inner runs of them as one blank, in lower case.

    Null stays null; a label of white space only becomes the empty string.
    """
    c = F.col(col) if isinstance(col, str) else col
    # Most labels need no pattern: looking for a tab or two blanks is much cheaper.
    even = F.when(F.contains(c, F.lit("\t")) | F.contains(c, F.lit("  ")), F.regexp_replace(c, "[ \\t]+", " ")).otherwise(c)
    return F.lower(F.trim(even))


def plain_or_null(col: Column | str) -> Column:
    """Plain form, or null where the label is missing."""
    p = plain(col)
    return F.when(~p.isin(*MISSING_LABELS), p)


def plain_sql(expr: str) -> str:
    """The plain form in DuckDB SQL."""
    return f"lower(trim(regexp_replace({expr}, '[ \\t]+', ' ', 'g')))"


def missing_sql(expr: str) -> str:
    """True in DuckDB SQL where the label is missing."""
    labels = ", ".join(f"'{x}'" for x in MISSING_LABELS)
    return f"({expr} IS NULL OR {plain_sql(expr)} IN ({labels}))"
