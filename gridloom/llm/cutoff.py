"""Score cutoffs that keep a target fraction of every source, by multi-sequence selection.

The records of a source are hashed into as many blocks as its own count asks for; a block's scores
are a sorted array, stored once in the shared folder. The cutoff of a source is the k-th largest of
its scores. Each round takes pivots from the source's longest remaining array, ranks them in every
array by ``searchsorted``, adds the ranks over the blocks, and narrows the arrays to the gap between
two neighbouring pivots, until a pivot is the k-th itself. What is left of the arrays is written
anew, so a later round reads a small part of what the one before it read. Only pivots and
ranks travel; a hot source is spread over its blocks, and no task sees more than a block of it.
Sources are treated in waves of a bounded number, so that what is broadcast is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.durable import Stage

PIVOTS = 64
BLOCK_ROWS = 1 << 18
#: Sources of a wave, and the bytes of a table with a row a source up to which it is broadcast.
WAVE = 1 << 16
BROADCAST = 1 << 26


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column(batch.schema.get_field_index("scores"))
    flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spaced scores of each array, with its length."""
    for b in batches:
        out = []
        for (source,), scores in zip(_rows(b, "source"), _arrays(b)):
            at = np.unique(np.linspace(0, len(scores) - 1, min(PIVOTS, len(scores))).round().astype(int))
            out.append((source, len(scores), np.unique(scores[at]).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.float64())))], ["source", "size", "pivots"])


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's scores lie above, and at or above, each pivot of a source."""
    total: dict[str, tuple[list[float], np.ndarray]] = {}

    def ranked() -> pa.RecordBatch:
        sizes = [len(p) for p, _ in total.values()]
        source = pa.array(list(total), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        pivot = np.concatenate([p for p, _ in total.values()])
        counts = np.hstack([c for _, c in total.values()])
        return pa.RecordBatch.from_arrays([source, pa.array(pivot, pa.float64()), pa.array(counts[0]), pa.array(counts[1])], ["source", "pivot", "above", "least"])

    for b in batches:
        for (source, pivots), scores in zip(_rows(b, "source", "pivots"), _arrays(b)):
            counts = len(scores) - np.stack([np.searchsorted(scores, pivots, "right"), np.searchsorted(scores, pivots, "left")])
            if source in total:
                total[source][1][:] += counts
            else:
                total[source] = (pivots, counts)
        if len(total) > 1 << 14:
            yield ranked()
            total = {}
    if total:
        yield ranked()


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores strictly between low and high of each array; arrays without any are gone."""
    for b in batches:
        out = [(s, x[np.searchsorted(x, low, "right") : np.searchsorted(x, high, "left")]) for (s, low, high), x in zip(_rows(b, "source", "low", "high"), _arrays(b))]
        out = [(s, x) for s, x in out if len(x)]
        if out:
            ends = np.r_[0, np.cumsum([len(x) for _, x in out])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for _, x in out])))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), lists], ["source", "scores"])


def sized_broadcast(table: DataFrame) -> DataFrame:
    """A stored table with a column ``source``, to be broadcast if its counted size is within ``BROADCAST``; else the planner decides."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("source") + F.lit(64 + 8 * PIVOTS)), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST else table


def kth_largest(scores: DataFrame, targets: DataFrame, block_rows: int = BLOCK_ROWS, wave: int = WAVE) -> DataFrame:
    """The k-th largest score of each source: ``source``, ``threshold``.

    ``scores``: ``source`` string, ``score`` double (no null or NaN), ``id`` long, one row a record.
    ``targets``: ``source``, ``n`` (its scores), ``k`` from 1 to n. Sources of only one of the two are
    left out.
    """
    stage = Stage(scores.sparkSession, "cutoff")
    waves = max(1, -(-targets.count() // wave))
    found, arrays, ranges = [], None, None
    inf = float("inf")
    for w in range(waves):
        own = stage.write(targets.where(F.pmod(F.xxhash64("source"), F.lit(waves)) == w).select("source", "n", F.col("k").cast("long").alias("k")))
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows)).alias("block")
        arrays = scores.join(sized_broadcast(own.select("source", "n")), "source").groupBy("source", block)
        arrays = stage.write(arrays.agg(F.sort_array(F.collect_list("score")).alias("scores")).drop("block"))
        ranges = own
        while True:
            proposed = arrays.mapInArrow(_propose, "source string, size long, pivots array<double>")
            pivots = stage.write(proposed.groupBy("source").agg(F.max_by("pivots", F.struct("size", "pivots")).alias("pivots")))
            ranked = arrays.join(sized_broadcast(pivots), "source").mapInArrow(_rank, "source string, pivot double, above long, least long")
            ranked = ranked.groupBy("source", "pivot").agg(F.sum("above").alias("above"), F.sum("least").alias("least"))
            # above < k <= least: the pivot is the k-th. Else it bounds the range from above (least < k) or from below (above >= k).
            hit, over = (F.col("above") < F.col("k")) & (F.col("k") <= F.col("least")), F.col("least") < F.col("k")
            step = ranked.join(ranges.select("source", "k"), "source").groupBy("source").agg(
                F.max(F.when(hit, F.col("pivot"))).alias("threshold"),
                F.coalesce(F.max(F.when(~hit & ~over, F.col("pivot"))), F.lit(-inf)).alias("low"),
                F.coalesce(F.min(F.when(over, F.col("pivot"))), F.lit(inf)).alias("high"),
                (F.first("k") - F.coalesce(F.max(F.when(over, F.col("least"))), F.lit(0))).alias("k"),
            )
            step = stage.write(step)
            stage.drop(pivots, *([ranges] if ranges is own else []))
            found.append(step.where("threshold IS NOT NULL").select("source", "threshold"))
            ranges = step.where("threshold IS NULL")
            if ranges.isEmpty():
                break
            left = arrays.join(sized_broadcast(ranges.select("source", "low", "high")), "source").mapInArrow(_narrow, "source string, scores array<double>")
            left = stage.write(left)
            stage.drop(arrays)
            arrays = left
        stage.drop(arrays)
    return stage.write(reduce(DataFrame.unionByName, found))


def fraction_cutoffs(samples: DataFrame, id_col: str, source: Column, score: str, targets: DataFrame, block_rows: int = BLOCK_ROWS, wave: int = WAVE) -> tuple[DataFrame, DataFrame]:
    """For each source the greatest of its scores that at least the fraction ``fraction`` of its records reach.

    ``samples``: a record counts if its score is a number from 0 to 1 and neither its identifier nor
    its source is null; records delivered more than once count once. ``targets``: ``source``,
    ``fraction``; null and NaN fractions are left out, of several rows of a source the largest
    fraction holds. A fraction of 0 or less gives the source's highest score; one above 1 can't be
    reached and gives none, as does a source without counted records; empty tables give no rows.
    Returns the counted records (``id``, ``source``, ``score``) and the cutoffs (``source``,
    ``fraction``, ``n``, ``threshold``).
    """
    stage = Stage(samples.sparkSession, "scores")
    ok = F.col(score).between(0.0, 1.0)  # false for NaN, which sorts above all numbers
    valid = samples.where(ok).select(F.col(id_col).cast("long").alias("id"), source.alias("source"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    valid = stage.write(valid.where("id IS NOT NULL AND source IS NOT NULL").dropDuplicates(["id"]))
    wanted = targets.where(F.col("fraction").isNotNull() & ~F.isnan("fraction")).groupBy("source").agg(F.max("fraction").alias("fraction"))
    sized = valid.groupBy("source").agg(F.count("*").alias("n")).join(wanted, "source")
    sized = sized.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("n")))).where("k <= n")
    sized = stage.write(sized)
    cuts = kth_largest(valid, sized.select("source", "n", "k"), block_rows, wave)
    return valid, sized.join(cuts, "source").select("source", "fraction", "n", "threshold")
