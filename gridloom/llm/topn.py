"""Top N items within every group by simultaneous per-group bisection.

Each row gets an order-preserving code of several 64-bit words: the scores in order of importance,
then the identifier; a larger code is a better row. All groups of a block are refined at once:
every group has a cutoff interval, counts its rows above the midpoint, and keeps either the upper
side (too many rows) or accepts it whole and goes on below, until it holds exactly N. A group whose
rows tie on a word goes on with the next word; the identifier decides at last. Only the survivors
are sorted; where repeated rows are found among them, the group's search goes on below them.

Blocks are bisected where they are read, and a task's survivors are carried into its next block as
long as they leave room, so at most N rows of a large group leave a task; only these are shuffled by
group, and bisected again while they stream by in group order. A group of any size therefore costs a
task no more memory than one block plus N rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1 << 18


def _words(column: pa.ChunkedArray, best: str, nulls: bool = True) -> list[np.ndarray]:
    """Unsigned words in the order of the values, the best largest; null and NaN lie below all values.

    No floating value but NaN has the word 0, so null takes it; whole numbers use every word and get
    a word of their own before, 1 where there is a value.
    """
    null = column.is_null(nan_is_null=True).to_numpy()
    sign = np.uint64(1) << np.uint64(63)
    floating = pa.types.is_floating(column.type)
    if floating:
        bits = (column.fill_null(0.0).to_numpy().astype(np.float64) + 0.0).view(np.uint64)
        up = np.where(bits & sign, ~bits, bits | sign)
    else:
        up = column.fill_null(0).to_numpy().astype(np.int64).view(np.uint64) ^ sign
    if best == "asc":
        up = ~up
    up[null] = 0
    return [up] if floating or not nulls else [(~null).astype(np.uint64), up]


def _groups(table: pa.Table, n_keys: int) -> np.ndarray:
    """Dense group numbers of the rows; nulls are a value of their own."""
    gid = np.zeros(table.num_rows, np.int64)
    for k in range(n_keys):
        d = table.column(k).combine_chunks().dictionary_encode("encode")
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        gid = gid * max(1, len(d.dictionary)) + codes
        gid = np.unique(gid, return_inverse=True)[1]
    return gid


def _cut(rows: np.ndarray, gid: np.ndarray, words: Sequence[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Of ``rows`` (ordered by group), the ``want[group]`` best of each group, repeats counted."""
    kept = []
    g = gid[rows]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    need = want[g[starts]]
    level = np.zeros(len(starts), np.int64)
    code = words[0][rows]
    while len(rows):
        size = np.diff(np.r_[starts, len(rows)])
        whole = size <= need
        low, high = np.minimum.reduceat(code, starts), np.maximum.reduceat(code, starts)
        tied = ~whole & (low == high)
        last = tied & (level == len(words) - 1)  # one row, delivered many times
        tied &= ~last
        mid = low + ((high - low) >> np.uint64(1)) + np.uint64(1)
        above = code >= np.repeat(mid, size)
        count = np.add.reduceat(above, starts, dtype=np.int64)
        open_ = ~whole & ~tied & ~last
        over = open_ & (count > need)
        under = open_ & ~over
        accept = np.repeat(whole, size) | (np.repeat(under, size) & above)
        accept[starts[last]] = True
        accept[starts[last & (need > 1)] + 1] = True  # a second one shows that the search has to go on below
        stay = np.where(np.repeat(over, size), above, np.repeat(under, size) & ~above) | np.repeat(tied, size)
        need = need - np.where(under, count, 0)
        stay &= np.repeat(need > 0, size)
        kept.append(rows[accept])
        level = level + tied
        if tied.any():
            deeper = np.repeat(tied, size)
            of = np.repeat(np.minimum(level, len(words) - 1), size)
            for k in range(1, len(words)):
                at = deeper & (of == k)
                code[at] = words[k][rows[at]]
        which = np.repeat(np.arange(len(starts)), size)[stay]
        rows, code = rows[stay], code[stay]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
        need, level = need[which[starts]], level[which[starts]]
    return np.concatenate(kept)


def bisect_groups(gid: np.ndarray, words: Sequence[np.ndarray], n: int) -> np.ndarray:
    """Row numbers of the n best rows of each group, in group order, worst first within a group.

    ``gid``: group numbers from 0; ``words``: unsigned, most important first; the last identifies a
    row within its group. Rows alike in group and all words count once.
    """
    rows = np.argsort(gid, kind="stable")
    if len(rows) == 0 or n < 1:
        return rows[:0]
    need = np.full(int(gid.max()) + 1, n, np.int64)
    out = []
    while len(rows):
        kept = _cut(rows, gid, words, need)
        kept = kept[np.lexsort((*reversed([w[kept] for w in words]), gid[kept]))]
        g = gid[kept]
        first = np.r_[True, g[1:] != g[:-1]]
        new = first.copy()
        for w in words:
            v = w[kept]
            new[1:] |= v[1:] != v[:-1]
        out.append(kept[new])
        repeats = np.bincount(g[~new], minlength=len(need))
        need -= np.bincount(g[new], minlength=len(need))
        # Groups that lost repeats search on, below the worst row they have.
        on = (repeats > 0) & (need > 0)
        if not on.any():
            break
        worst = np.zeros(len(need), np.int64)
        worst[g[first]] = kept[first]
        rest = np.ones(len(gid), bool)
        rest[kept] = False
        rows = rows[on[gid[rows]] & rest[rows]]
        w0 = worst[gid[rows]]
        rows = rows[~np.logical_and.reduce([w[rows] == w[w0] for w in words])]
    kept = np.concatenate(out)
    return kept[np.lexsort((*reversed([w[kept] for w in words]), gid[kept]))] if len(out) > 1 else kept


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]], id_col: str, n: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The n best rows of each group, with their rank.

    ``keys``: group columns; null is a group value of its own. ``order``: numeric columns, most
    important first, each ``desc`` or ``asc``; null and NaN come last either way, -0.0 equals 0.0.
    ``id_col``: integer identifier; the smaller one wins ties. Rows with the same group, scores and
    identifier count once; rows without an identifier are left out. Groups with fewer than n rows
    give all they have; an empty table or n < 1 gives no rows. Other columns are ignored, whatever
    their names. Returns ``keys``, ``id_col``, the order columns and ``rank`` from 1.
    """
    best = [how for _, how in order] + ["asc"]
    names = [f"k{i}" for i in range(len(keys))] + [f"s{i}" for i in range(len(order))] + ["id"]
    cols = [F.col(c) for c in keys] + [F.col(c) for c, _ in order] + [F.col(id_col).cast("long")]
    slim = df.select(*[c.alias(x) for c, x in zip(cols, names)]).where(F.col("id").isNotNull())
    slim = slim.select(*[F.col(x).cast("double") if x[0] == "s" and t not in ("double", "bigint") else F.col(x) for x, t in slim.dtypes])
    n_keys = len(keys)

    def pick(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        gid = _groups(table, n_keys)
        words = [w for i, how in enumerate(best) for w in _words(table.column(n_keys + i), how, i < len(best) - 1)]
        return bisect_groups(gid, words, n), gid, words

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best_of(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            return table.take(np.sort(pick(table)[0])).combine_chunks().to_batches()

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block_rows:
                held = best_of(held)
                rows = sum(x.num_rows for x in held)
                if rows > block_rows // 2:  # very many groups: little is gained by holding them
                    yield from held
                    held, rows = [], 0
        if rows:
            yield from best_of(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            table = pa.Table.from_batches(held)
            at, gid, words = pick(table)
            if not last:  # the last group goes on: its best rows so far are carried over
                on = gid[at] == gid[-1]
                held = table.take(at[on]).to_batches()
                at = at[~on]
            if not len(at):
                return held, None
            at = at[np.lexsort(tuple(~w[at] for w in reversed(words)) + (gid[at],))]
            g = gid[at]
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) + 1
            return held, table.take(at).append_column("rank", pa.array(rank, pa.int32()))

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block_rows:
                held, out = flush(held, False)
                rows = sum(x.num_rows for x in held)
                if out:
                    yield from out.combine_chunks().to_batches()
        if held:
            _, out = flush(held, True)
            if out:
                yield from out.combine_chunks().to_batches()

    best_of_blocks = slim.mapInArrow(blocks, slim.schema)
    by_key = [F.col(x) for x in names[:n_keys]]
    if not by_key and n > 0:  # one group: the survivors of all tasks are cut down by many tasks before one sees them
        best_of_blocks = best_of_blocks.repartition("id").mapInArrow(blocks, slim.schema)
    routed = best_of_blocks.repartition(*by_key) if by_key else best_of_blocks.repartition(1)
    routed = routed.sortWithinPartitions(*by_key) if by_key else routed
    out = routed.mapInArrow(merge, T.StructType([*slim.schema.fields, T.StructField("rank", T.IntegerType())]))
    shown = [*keys, *[c for c, _ in order], id_col]
    return out.select(*[F.col(x).alias(y) for x, y in zip(names, shown)], "rank")
