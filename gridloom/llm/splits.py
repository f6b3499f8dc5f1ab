"""Splits that keep related records together.

Entities are the connected components of the link graph, found by Borůvka contraction: in each
round every component picks its least link (a strict order on links by hash, then by ends), the
picked links join the spanning forest, components joined by them are contracted by pointer
jumping, and links inside a component vanish. Each round at least halves the components that still
have links. The contracted links, the parents and the forest are tables in the shared folder. Every
join here is one with a table of unique keys (``functions.skew.lookup``), so neither the root of a
giant component nor a grouper with a third of all rows ends in one task.

Roots are then dealt to the splits: the entities of the largest size bands one by one to the split
that lacks most, all others systematically along a low-discrepancy sequence within their band, in
the proportions that are still open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.durable import Stage
from gridloom.functions.skew import lookup

GOLDEN = 0.6180339887498949
DEAL_ROWS = 1 << 18
#: Entities of the largest bands that are dealt one by one; this bounds what the driver sees.
SINGLY = 4096


@dataclass
class Forest:
    """``members``: node, root (nodes with a link only); ``edges``: a, b of the spanning forest."""

    members: DataFrame
    edges: DataFrame
    rounds: int


def spanning_forest(links: DataFrame) -> Forest:
    """Connected components of the undirected graph ``links`` (``a``, ``b``: strings).

    Null ends and links of a node with itself are ignored; repeated and reversed links are one. The
    root of a component is one of its nodes. An empty table gives an empty forest.
    """
    stage = Stage(links.sparkSession, "forest")
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # x, y: the components that the link joins now; order: the strict order of links.
    open_ = stage.write(ends.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.xxhash64("a", "b").alias("w")))
    members, forest, rounds = None, [], 0
    order = F.struct("w", "a", "b")
    while not open_.isEmpty():
        rounds += 1
        sides = open_.select(F.col("x").alias("node"), order.alias("link"), F.col("y").alias("other")).unionByName(
            open_.select(F.col("y").alias("node"), order.alias("link"), F.col("x").alias("other"))
        )
        least = F.min(F.struct("link", "other")).alias("p")
        picked = stage.write(sides.groupBy("node").agg(least).select("node", F.col("p.other").alias("parent"), F.col("p.link.a").alias("a"), F.col("p.link.b").alias("b")))
        forest.append(picked.select("a", "b").distinct())
        # Picked links form trees with one pair of nodes pointing at each other; the smaller one becomes the root.
        back = picked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        root = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
        parents = stage.write(lookup(picked, back, "parent").select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("parent")))
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = stage.write(lookup(parents, up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            stage.drop(parents)
            parents = jumped.drop("moved")
            if not moved:
                break
        to_x, to_y = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root")) for c in "xy")
        left = lookup(lookup(open_, to_x, "x"), to_y, "y").where("x_root <> y_root")
        left = left.select("a", "b", F.least("x_root", "y_root").alias("x"), F.greatest("x_root", "y_root").alias("y"), "w")
        # Of parallel links between two components only the least can be picked.
        left = left.groupBy("x", "y").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("m.a", "m.b", "x", "y", "m.w")
        left = stage.write(left)
        if members is None:
            members = parents.select("node", F.col("parent").alias("root"))
        else:
            on = parents.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            old, members = members, stage.write(lookup(members, on, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            stage.drop(old, parents)
        stage.drop(open_)
        open_ = left
    if members is None:
        return Forest(links.sparkSession.createDataFrame([], "node string, root string"), ends.select("a", "b").limit(0), 0)
    edges = forest[0]
    for more in forest[1:]:
        edges = edges.unionByName(more)
    return Forest(members, edges, rounds)


def entities(df: DataFrame, columns: list[str], group: Column, forest: Forest) -> DataFrame:
    """``columns`` and ``entity``: the root of the row's group, or the group itself if nothing links it.

    ``group``: string, null where the row has none; such a row has a null entity. Rows whose first
    column, the identifier, is null are left out. No column may be called ``node``, ``root`` or ``entity``.
    """
    rows = df.select(*columns, group.alias("node")).where(F.col(columns[0]).isNotNull())
    return lookup(rows, forest.members, "node", "left").select(*columns, F.coalesce("root", "node").alias("entity"))


def deal(sizes: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Gives each entity (``entity``, ``rows``) a ``split``, near the ``shares`` of the rows.

    An entity stays whole, so one that holds more than a share makes its split too large by what
    it exceeds the share. No entity, no rows.
    """
    stage = Stage(sizes.sparkSession, "deal")
    total = sum(shares.values())
    shares = {k: v / total for k, v in shares.items()}
    band = F.floor(F.log2(F.col("rows"))).cast("int").alias("band")
    sized = stage.write(sizes.where("rows > 0").select("entity", F.col("rows").cast("long").alias("rows"), band))
    bands = sorted(((r.band, r.n, r.rows) for r in sized.groupBy("band").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()), reverse=True)
    if not bands:
        return sized.select("entity", "rows", F.lit(None).cast("string").alias("split"))
    lack = {k: v * sum(b[2] for b in bands) for k, v in shares.items()}

    singly, n = [], 0
    while bands and n + bands[0][1] <= SINGLY and bands[0][1] <= SINGLY // 64:
        n += bands[0][1]
        singly.append(bands.pop(0)[0])
    out = []
    if singly:
        big = sorted(((r.rows, r.entity) for r in sized.where(F.col("band").isin(singly)).collect()), key=lambda x: (-x[0], x[1]))
        dealt = []
        for rows, entity in big:
            to = max(lack, key=lambda k: lack[k] / shares[k] if shares[k] else -1.0)
            lack[to] -= rows
            dealt.append((entity, rows, to))
        out.append(sized.sparkSession.createDataFrame(dealt, "entity string, rows long, split string"))
    if bands:
        rest = {k: max(v, 0.0) for k, v in lack.items()}
        open_rows = sum(rest.values())
        ends, at = [], 0.0
        for k, v in rest.items():
            at += v / open_rows if open_rows else shares[k]
            ends.append((k, at))
        # Positions along the band without one task seeing a band: counts of hash buckets, then ranks within a bucket.
        buckets = max(1, -(-max(b[1] for b in bands) // DEAL_ROWS))
        hashed = sized.where(~F.col("band").isin(singly)).withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)))
        counts = hashed.groupBy("band", "bucket").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(W.partitionBy("band").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        ranked = hashed.withColumn("i", F.row_number().over(W.partitionBy("band", "bucket").orderBy(F.xxhash64("entity", F.lit(1)), "entity")))
        ranked = ranked.join(before.drop("n"), ["band", "bucket"])
        place = (F.col("i") + F.coalesce("before", F.lit(0)) + F.col("band") * 7) * F.lit(GOLDEN)
        place = place - F.floor(place)
        split = F.lit(ends[-1][0])
        for k, end in reversed(ends[:-1]):
            split = F.when(place < end, F.lit(k)).otherwise(split)
        out.append(ranked.select("entity", "rows", split.alias("split")))
    return stage.write(out[0] if len(out) == 1 else out[0].unionByName(out[1]))


def grouped_splits(df: DataFrame, id_col: str, group: Column, links: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, Forest]:
    """``id_col``, ``entity``, ``split`` of every row; rows of one entity share the split.

    A row without a group is an entity of its own, as is a group without links. Returns the forest
    too. An empty table gives no rows.
    """
    stage = Stage(df.sparkSession, "splits")
    forest = spanning_forest(links)
    rows = entities(df, [id_col], group, forest)
    rows = stage.write(rows.withColumn("entity", F.coalesce(F.concat(F.lit("g:"), "entity"), F.concat(F.lit("r:"), F.col(id_col).cast("string")))))
    dealt = deal(rows.groupBy("entity").agg(F.count("*").alias("rows")), shares)
    return lookup(rows, dealt.drop("rows"), "entity").select(id_col, "entity", "split"), forest
