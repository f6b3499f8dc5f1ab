"""Filling containers of fixed capacity with texts, along a space-filling curve.

A text's size is its number of tokens. The same pass that counts them projects the text's hashed
token vector to three dimensions and takes its place on a Hilbert curve. Texts are range-sorted by
that key, and each range is packed with the best fit among a bounded set of open containers, so a
container holds neighbours on the curve. What a range leaves in containers that aren't nearly full
is packed once more over much wider ranges, large items first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.durable import Stage, spread
from gridloom.llm.tokenizer import encoder_of, shared_table, text_chunks

DIMENSIONS = 3
BITS = 10
HASHED = 1024
OPEN = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_directions(n: int) -> np.ndarray:
    """For each token id, its hashed coordinate's place (with the hash's sign) in the projected space."""
    h = _mix(np.arange(1, n + 1, dtype=np.uint64))
    cell, sign = (h % np.uint64(HASHED)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    axes = _mix(np.arange(1, HASHED * DIMENSIONS + 1, dtype=np.uint64) << np.uint64(20)).reshape(HASHED, DIMENSIONS)
    axes = axes.astype(np.float64) / 2.0**63 - 1.0
    return (axes[cell] * sign[:, None]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with coordinates of ``bits`` bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest to the finest level
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def place(ids: np.ndarray, counts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts given as token ids and their numbers; a text without tokens is at the middle."""
    sums = np.zeros((len(counts), DIMENSIONS))
    some = counts > 0
    if some.any():
        start = (np.cumsum(counts) - counts)[some]
        sums[some] = np.add.reduceat(directions[ids], start, axis=0, dtype=np.float64)
    unit = 0.5 + np.arctan(sums / np.sqrt(np.maximum(counts, 1))[:, None]) / np.pi
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class Shelf:
    """Best fit over a bounded number of open containers."""

    def __init__(self, capacity: int, first: int, most: int = OPEN):
        self.capacity, self.next, self.most = capacity, first, most
        self.open: list[tuple[int, int]] = []  # room, container
        self.left: dict[int, int] = {}

    def put(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, to = self.open.pop(at)
        else:
            room, to = self.capacity, self.next
            self.next += 1
            if len(self.open) >= self.most:
                self.open.pop(0)
        room -= size
        self.left[to] = room
        insort(self.open, (room, to))
        return to


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None = None) -> DataFrame:
    """The container of each text: ``id_col``, ``piece``, ``container``, ``n_tokens``.

    Only a text longer than ``capacity`` is split: into pieces that fill a container each and a
    last one that is packed like any text. Null and empty texts have no tokens and are put where
    there is a container. Repeated rows are texts of their own; an empty table gives no rows.
    """
    spark = df.sparkSession
    stage, table = Stage(spark, "packing"), shared_table(spark, path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(table)
        directions = token_directions(len(encoder.table.keys))
        for batch in batches:
            for b in text_chunks(batch, 1):
                ids, counts = encoder.encode_batch(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(place(ids, counts, directions), pa.int64())], ["id", "size", "key"])

    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    # Written first: finding the ranges reads the keys once more, and must not encode the texts once more.
    sized = stage.write(slim.mapInArrow(measure, T.StructType([slim.schema["id"], T.StructField("size", T.LongType()), T.StructField("key", T.LongType())])))
    # A key held by very many texts is cut by the hash of their identifiers.
    tie = F.xxhash64("id").alias("tie")
    ranged = sized.withColumn("tie", tie).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "id")
    nearly = capacity // 64
    items = T.StructType([slim.schema["id"], *(T.StructField(c, T.LongType()) for c in ("piece", "size", "key", "container")), T.StructField("open", T.BooleanType())])

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(capacity, TaskContext.get().partitionId() << 33)
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            rows, pieces, sizes, to = [], [], [], []
            for row, size in enumerate(b.column(1).to_pylist()):
                piece = 0
                while size > capacity:
                    rows.append(row)
                    pieces.append(piece)
                    sizes.append(capacity)
                    to.append(shelf.next)
                    shelf.left[shelf.next] = 0
                    shelf.next += 1
                    size -= capacity
                    piece += 1
                rows.append(row)
                pieces.append(piece)
                sizes.append(size)
                to.append(shelf.put(size))
            taken = pa.array(rows, pa.int64())
            arrays = [b.column(0).take(taken), pa.array(pieces, pa.int64()), pa.array(sizes, pa.int64()), b.column(2).take(taken), pa.array(to, pa.int64())]
            waiting.append(pa.RecordBatch.from_arrays(arrays, items.names[:-1]))
            # Rows of closed containers may go; those of open ones wait, at most OPEN containers full.
            still = {c for _, c in shelf.open}
            held = []
            for w in waiting:
                stays = np.isin(w.column(4).to_numpy(), list(still))
                yield out(w.filter(pa.array(~stays)), set())
                if stays.any():
                    held.append(w.filter(pa.array(stays)))
            waiting = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if held else []
            shelf.left = {c: r for r, c in shelf.open}
        still = {c for r, c in shelf.open if r > nearly}
        for w in waiting:
            yield out(w, still)

    def out(b: pa.RecordBatch, still: set[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.isin(b.column(4).to_numpy(), list(still)), pa.bool_())], items.names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(capacity, 1 << 62 | TaskContext.get().partitionId() << 33, 1 << 16)
        for b in batches:
            to = [shelf.put(s) for s in b.column(2).to_pylist()]
            yield out(b.set_column(4, "container", pa.array(to, pa.int64())), set())

    first = stage.write(ranged.mapInArrow(shelve, items))
    rest = first.where("open")
    wide = max(1, -(-rest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // (capacity * 4096)))
    second = rest.repartitionByRange(wide, "key", "id").sortWithinPartitions(F.desc("size"), "key", "id", "piece").mapInArrow(again, items)
    packed = first.where("NOT open").unionByName(second)
    return packed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "container", F.col("size").cast("int").alias("n_tokens"))
