"""Same or nearly the same records across splits, by minwise hashing with banded buckets.

A record's features are laid out in two bands. A band's shingles are all its runs of five
neighbouring features (cyclic), its signature the least hashes of these shingles under three hash
functions, and its bucket the hash of the signature. Two records that differ in at most one
feature agree in a whole band, hence in all its shingles, hence in its signature: such a pair
always shares a bucket, so the buckets lose nothing. Any two different features of a band lie in
most of its runs of five, so records that differ there rarely share one.

Numbers agree within a relative tolerance. They enter a shingle as logarithmic cells eight
tolerances wide; a record of the smaller side whose number lies within a tolerance of a cell's
edge is also entered with the neighbouring cell.

Equal records of a side are folded into one class first, so copies, however many, are hashed and
compared once. Only buckets seen on both sides are kept. Of a bucket with very many possible pairs,
classes are entered again with the other band's features but one, for each one, so that a bucket of
records alike in one band only never becomes a product of two large sides. Pairs of a bucket are
then compared feature by feature, exactly; the count of differing features decides, and the exact
Jaccard similarity of the two sets of features follows from it. The result is pairs of classes and
the membership of the records, which can be summed up as they are or expanded to pairs of records.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.durable import Stage

SHINGLE = 5
HASHES = 3
#: Possible pairs of a bucket above which it is refined.
HOT_PAIRS = 10_000
#: Members of a class above which it is cut into chunks where pairs of records are asked for.
CHUNK = 1 << 14


def _cell_width(tolerance: float) -> tuple[float, float]:
    reach = -math.log1p(-tolerance) * (1 + 1e-6) + 1e-12
    return 8 * reach, reach


def _cells(c: str, tolerance: float, both: bool) -> str:
    """SQL of a number's cells as an array of strings: one, or with its neighbour if ``both`` and an edge is near."""
    width, reach = _cell_width(tolerance)
    at = f"ln(abs({c})) / {width!r}D"
    name = lambda shift: f"concat(if({c} < 0, '-', '+'), cast(floor({at}) + {shift} AS string))"
    cells = f"array({name(0)})"
    if both:
        part, near = f"({at} - floor({at}))", reach / width + 1e-9
        cells = f"CASE WHEN {part} < {near!r}D THEN array({name(0)}, {name(-1)}) WHEN {part} > {1 - near!r}D THEN array({name(0)}, {name(1)}) ELSE {cells} END"
    odd = f"isnan({c}) OR abs({c}) = double('Infinity')"
    return f"CASE WHEN {c} IS NULL THEN array('missing') WHEN {c} = 0 THEN array('0') WHEN {odd} THEN array(cast({c} AS string)) ELSE {cells} END"


def _runs(tokens: Sequence[str]) -> list[str]:
    """SQL of a band's shingle hashes. The order of the tokens is part of a shingle."""
    n = len(tokens)
    size = min(SHINGLE, n)
    return [f"xxhash64({i}, {', '.join(tokens[(i + j) % n] for j in range(size))})" for i in range(n)]


def _signature(band: int, runs: Sequence[str]) -> str:
    """SQL of a band's bucket: hash of the least shingle hashes."""
    mins = [f"least({', '.join(h)})" if len(h := [f"xxhash64({k}, {r})" for r in runs]) > 1 else h[0] for k in range(HASHES)]
    return f"xxhash64({band}, {', '.join(mins)})"


def interleave(numbers: Sequence[str], words: Sequence[str]) -> tuple[list[str], list[str]]:
    """Two bands of about equal size, the numbers spread evenly over and within them."""
    bands: tuple[list[str], list[str]] = ([], [])
    for half in (0, 1):
        some, rest = list(numbers[half::2]), list(words[half::2])
        step = max(1, -(-len(rest) // max(1, len(some))))
        band = bands[half]
        while some or rest:
            band += some[:1] + rest[:step]
            some, rest = some[1:], rest[step:]
    return bands


@dataclass
class Overlap:
    """Classes of equal records and their links.

    ``pairs``: ``ka1 ka2`` (class of side a), ``kb1 kb2`` (class of side b), ``n_a``, ``n_b`` (their
    records), ``n_differing``, ``jaccard``; a row a pair of classes. ``members``: ``id``, ``side``, ``k1 k2``
    (its class) and the columns asked for; a row a record. ``sizes``: ``side``, ``k1``, ``k2``, ``n``.
    """

    pairs: DataFrame
    members: DataFrame
    sizes: DataFrame

    def expanded(self, chunk: int = CHUNK) -> DataFrame:
        """Pairs of records: ``id_a``, ``id_b``, ``n_differing``, ``jaccard``. Classes of many records are cut into chunks, a key each."""
        out = self.pairs.select("ka1", "ka2", "kb1", "kb2", "n_differing", "jaccard")
        large = self.sizes.where(F.col("n") > chunk)
        cut = not large.isEmpty()
        for s in ("a", "b"):
            k1, k2 = f"k{s}1", f"k{s}2"
            own = self.members.where(F.col("side") == s).select(F.col("id").alias(f"id_{s}"), F.col("k1").alias(k1), F.col("k2").alias(k2))
            if not cut:
                out = out.join(own, [k1, k2])
                continue
            chunks = large.where(F.col("side") == s).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.ceil(F.col("n") / chunk).alias("chunks"))
            own = own.join(chunks, [k1, k2], "left").withColumn("chunk", F.pmod(F.xxhash64(f"id_{s}"), F.coalesce("chunks", F.lit(1)))).drop("chunks")
            out = out.join(chunks, [k1, k2], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
            out = out.join(own, [k1, k2, "chunk"]).drop("chunk")
        return out.select("id_a", "id_b", "n_differing", "jaccard").distinct()  # a record that lies in the table twice is one here


def near_classes(
    df: DataFrame, id_col: str, side: Column, numbers: Sequence[str], words: dict[str, Column], tolerance: float, differing: int = 1,
    hot_pairs: int = HOT_PAIRS, keep: Sequence[str] = (),
) -> Overlap:
    """Classes of equal records of the sides ``a`` and ``b``, and the pairs of them that differ in at most ``differing`` (0 or 1) features.

    ``side``: ``a``, ``b`` or null (in no split; left out). Numbers x, y agree if
    |x - y| <= tolerance * max(|x|, |y|), infinities only if equal, NaN like a missing number;
    ``words``: name -> string column, null where missing. A missing value agrees with a missing one
    only. Rows without an identifier are left out; rows with the same identifier on both sides are
    linked like any others. A class is known by a 128-bit hash of its features. At least two features
    are needed. ``keep``: columns that the members carry along. An empty side gives no pairs.
    """
    if differing not in (0, 1):
        raise ValueError("two bands can only promise pairs that differ in at most one feature")
    stage = Stage(df.sparkSession, "overlap")
    num = {f"n{i}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)) for i, c in enumerate(numbers)}
    txt = {f"w{i}": c for i, c in enumerate(words.values())}
    rows = df.select(F.col(id_col).alias("id"), side.alias("side"), *[c.alias(k) for k, c in {**num, **txt}.items()], *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    bands = interleave(list(num), list(txt))
    features = [*num, *txt]
    # Nulls leave a hash as it is, so each value goes in with a mark of its own.
    marked = ", ".join(f"isnull({c}), {c}" for c in features)
    rows = rows.where("id IS NOT NULL AND side IS NOT NULL").selectExpr("*", f"xxhash64(1, {marked}) AS k1", f"xxhash64({marked}, 2) AS k2")
    rows = stage.write(rows)
    # Grouped by the features themselves, as keys of a hash aggregate; gathering them as values would sort the rows.
    classes = rows.groupBy("side", "k1", "k2", *features).agg(F.count("*").alias("n"))
    classes = stage.write(classes.withColumn("id", F.monotonically_increasing_id()))  # numbers within this run, settled by the write

    def with_tokens(part: DataFrame, both: bool, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
        """``keep`` and a token ``t_{name}`` of each feature; numbers near an edge give a row for each cell if ``both``."""
        cells = [f"{_cells(c, tolerance, both)} AS t_{c}" if c[0] == "n" else f"coalesce(concat('=', {c}), 'missing') AS t_{c}" for c in names]
        part = part.selectExpr(*keep, *cells)
        for c in names:
            if c[0] == "n":
                token = f"explode(t_{c})" if both else f"t_{c}[0]"
                part = part.selectExpr(*keep, *[f"{token} AS t_{x}" if x == c else f"t_{x}" for x in names])
        return part

    def keys(part: DataFrame, both: bool) -> DataFrame:
        out = []
        for i, names in enumerate(bands):
            t = with_tokens(part, both, names, ["id", "side"])
            hashed = t.selectExpr("id", "side", *[f"{r} AS r{j}" for j, r in enumerate(_runs([f"t_{c}" for c in names]))])
            out.append(hashed.selectExpr("id", "side", f"{i} AS band", f"{_signature(i, [f'r{j}' for j in range(len(names))])} AS bucket"))
        return out[0].unionByName(out[1])

    count = {r.side: r["count"] for r in classes.groupBy("side").count().collect()}
    wide = "a" if count.get("a", 0) < count.get("b", 0) else "b"  # the smaller side is entered with neighbouring cells
    entered = keys(classes.where(F.col("side") != wide), False).unionByName(keys(classes.where(F.col("side") == wide), True).distinct())
    entered = stage.write(entered)
    held = entered.groupBy("band", "bucket").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")).where("na > 0 AND nb > 0")
    held = held.select("band", "bucket", (F.col("na").cast("double") * F.col("nb") > hot_pairs).alias("hot"))
    kept = stage.write(entered.join(held, ["band", "bucket"]))
    stage.drop(entered)

    def refined(part: DataFrame, both: bool) -> DataFrame:
        out = []
        for i, names in enumerate(bands):
            other = bands[1 - i]
            t = with_tokens(part.where(F.col("band") == i), both, other, ["id", "side", "bucket"])
            # All but one feature of the other band; a pair of this bucket can differ in that one only.
            left_out = ", ".join(f"struct({features.index(x)} AS f, xxhash64({', '.join([str(j), 'bucket', *[f't_{c}' for c in other if c != x]])}) AS bucket)" for j, x in enumerate(other))
            out.append(t.selectExpr("id", "side", f"{i + 2} AS band", f"explode(array({left_out})) AS p").selectExpr("id", "side", "band", "p.bucket", "p.f"))
        return out[0].unionByName(out[1])

    slim = classes.select("id", *features)
    hot = kept.where("hot").join(slim, "id")
    hot = refined(hot.where(F.col("side") != wide), False).unionByName(refined(hot.where(F.col("side") == wide), True)).distinct()
    candidates = kept.where("NOT hot").select("id", "side", "band", "bucket", F.lit(-1).alias("f")).unionByName(hot)
    full = candidates.join(classes.select("id", "k1", "k2", "n", *features), "id")
    of = lambda s: full.where(F.col("side") == s).select("band", "bucket", *([F.col("f")] if s == "a" else []), *[F.col(c).alias(f"{c}_{s}") for c in ("k1", "k2", "n", *features)])
    differs = {}
    for c in features:
        x, y = f"{c}_a", f"{c}_b"
        agree = f"{x} = {y}"
        if c[0] == "n":
            agree += f" OR abs({x} - {y}) <= {tolerance!r}D * greatest(abs({x}), abs({y})) AND greatest(abs({x}), abs({y})) < double('Infinity')"
        differs[c] = f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN int(({x} IS NULL) != ({y} IS NULL)) WHEN {agree} THEN 0 ELSE 1 END"
    # A pair that agrees in all features shares every refined bucket; it is taken from the first one of band 0 only, any other pair where its feature is left out.
    first = features.index(bands[1][0])
    taken = " OR ".join([f"f = -1 OR (n_differing = 0 AND band = 2 AND f = {first})", *[f"(f = {i} AND d[{i}] = 1)" for i in range(len(features))]])
    pairs = of("a").join(of("b"), ["band", "bucket"])
    ends = ["k1_a AS ka1", "k2_a AS ka2", "k1_b AS kb1", "k2_b AS kb2", "n_a", "n_b"]
    pairs = pairs.selectExpr(*ends, "band", "f", f"array({', '.join(differs.values())}) AS d").selectExpr("*", f"{' + '.join(f'd[{i}]' for i in range(len(features)))} AS n_differing")
    pairs = pairs.where((F.col("n_differing") <= differing) & F.expr(taken)).drop("band", "f", "d").distinct()
    same = len(features) - F.col("n_differing")
    pairs = stage.write(pairs.withColumn("jaccard", same / (2 * len(features) - same)))
    stage.drop(kept)
    members = rows.select("id", "side", "k1", "k2", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
    return Overlap(pairs, members, classes.select("side", "k1", "k2", "n"))


def near_pairs(df: DataFrame, id_col: str, side: Column, numbers: Sequence[str], words: dict[str, Column], tolerance: float, differing: int = 1, hot_pairs: int = HOT_PAIRS, chunk: int = CHUNK) -> DataFrame:
    """``near_classes`` expanded to records: ``id_a``, ``id_b``, ``n_differing``, ``jaccard``; each pair of identifiers once, repeated records too."""
    return near_classes(df, id_col, side, numbers, words, tolerance, differing, hot_pairs).expanded(chunk)
