"""Frequency of every distinct term with last-seen counters.

Records are hash-partitioned by their identifier and arrive ordered by it. A term's counter holds
its occurrences, its records and the last record it was seen in: a token raises the record count
only where its record differs from the last one. No per-record set is built. A partition holds
whole records, so counters of different partitions are simply added; they are flushed between two
records whenever they grow past a bound, and each flush is a pre-aggregation before the shuffle
by term. A term in a third of all records thus sends one row per flush, and no task sees more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.durable import Stage

COUNTERS = 1 << 20


class LastSeen:
    """Counters of terms, fed with tokens in record order."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.occurrences = np.zeros(0, np.int64)
        self.records = np.zeros(0, np.int64)
        self.last = np.zeros(0, np.int64)

    def feed(self, terms: pa.Array, record: np.ndarray) -> np.ndarray:
        """Count tokens; ``record`` numbers their records in order, from 1. Returns the record of each first sight of a term in a record."""
        d = terms.dictionary_encode()
        of = np.array([self.index.setdefault(t, len(self.index)) for t in d.dictionary.to_pylist()], np.int64)
        grow = len(self.index) - len(self.last)
        if grow:
            self.occurrences, self.records, self.last = (np.r_[x, np.zeros(grow, np.int64)] for x in (self.occurrences, self.records, self.last))
        term = of[d.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(term, kind="stable")
        t, r = term[order], record[order]
        first = np.r_[True, t[1:] != t[:-1]]
        seen = np.r_[0, r[:-1]]
        seen[first] = self.last[t[first]]
        self.occurrences += np.bincount(t, minlength=len(self.last))
        new = seen != r
        self.records += np.bincount(t[new], minlength=len(self.last))
        end = np.r_[first[1:], True]
        self.last[t[end]] = r[end]
        return r[new]

    def table(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(self.index), pa.string()), pa.array(self.occurrences), pa.array(self.records)], ["term", "occurrences", "records"])


def _counted(df: DataFrame, id_col: str, terms: Column, counters: int) -> DataFrame:
    """Partial counters ``term``, ``occurrences``, ``records``, ``id``, ``n_terms``.

    A row is a term's counter, or (term null) a record with its number of distinct terms.
    """
    tokens = F.filter(terms, lambda t: t != "")
    slim = df.select(F.col(id_col).cast("long").alias("id"), tokens.alias("terms")).where("id IS NOT NULL")
    slim = slim.repartition("id").sortWithinPartitions("id")
    names = ["term", "occurrences", "records", "id", "n_terms"]

    def of_terms(state: LastSeen) -> pa.RecordBatch:
        t = state.table()
        none = pa.nulls(t.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*t.columns, none, none], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, record, last_id = LastSeen(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            new = np.r_[last_id is None or ids[0] != last_id, ids[1:] != ids[:-1]]
            last_id = ids[-1]
            lists, fresh = b.column(1).filter(pa.array(new)), ids[new]
            if not len(fresh):
                continue
            tokens, distinct = lists.flatten(), np.zeros(len(fresh), np.int64)
            if len(tokens):
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                seen = state.feed(tokens, record + 1 + np.repeat(np.arange(len(sizes)), sizes))
                distinct = np.bincount(seen - record - 1, minlength=len(fresh))
            record += len(fresh)
            none = pa.nulls(len(fresh), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(fresh), pa.string()), none, none, pa.array(fresh), pa.array(distinct)], names)
            if len(state.index) > counters:  # repeats of the last record are skipped by their identifier
                yield of_terms(state)
                state = LastSeen()
        if state.index:
            yield of_terms(state)

    return slim.mapInArrow(count, "term string, occurrences long, records long, id long, n_terms long")


def _by_term(parts: DataFrame) -> DataFrame:
    """Counters added by term; the null term's ``records`` is the number of all records."""
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.coalesce("records", F.lit(1))).cast("long").alias("records"))


def term_counts(df: DataFrame, id_col: str, terms: Column, counters: int = COUNTERS) -> DataFrame:
    """Occurrences and records of every term.

    ``id_col``: integer record identifier; a record delivered more than once counts once, a null
    identifier is left out. ``terms``: array of strings; null arrays are records without terms,
    null and empty entries are skipped, a term is a string compared exactly. An empty table gives
    no rows. Returns ``term``, ``occurrences``, ``records``.
    """
    return _by_term(_counted(df, id_col, terms, counters).where("term IS NOT NULL"))


def record_terms(df: DataFrame, id_col: str, terms: Column, counters: int = COUNTERS) -> DataFrame:
    """``id_col`` and ``n_terms``, how many distinct terms each record holds, from the same counters: a term is new to a record where it was last seen in another."""
    out = _counted(df, id_col, terms, counters).where("term IS NULL")
    return out.select(F.col("id").alias(id_col), "n_terms")


def marked_terms(df: DataFrame, id_col: str, terms: Column, rare_below: float, common_above: float) -> DataFrame:
    """``term_counts`` with ``n_records`` (all records, those without terms too) and the booleans
    ``rare`` (in fewer than ``rare_below`` records) and ``common`` (in more than the fraction
    ``common_above`` of them); in very small tables a term can be both. The same pass counts both.
    """
    counts = Stage(df.sparkSession, "terms").write(_by_term(_counted(df, id_col, terms, COUNTERS)))
    total = counts.where("term IS NULL").first()
    n = F.lit(int(total.records) if total else 0).cast("long")
    return counts.where("term IS NOT NULL").withColumns({"n_records": n, "rare": F.col("records") < F.lit(rare_below), "common": F.col("records") > F.lit(common_above) * n})
