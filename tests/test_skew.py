"""Joins that no key can unbalance, and the machinery for large groups on its large path."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import durable, ranks
from gridloom.functions.skew import lookup


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("options", [{}, {"small": 0, "heavy_rows": 50}, {"small": 0, "heavy_rows": 1000}, {"small": 0, "heavy_rows": 50, "most_keys": 0}])
def test_lookup(spark, how, options):
    rows = [(i, "hot" if i % 3 else "gone" if i % 2 else None if i % 5 == 0 else str(i % 7)) for i in range(300)]
    big = spark.createDataFrame(rows, "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("0", 2), ("1", None), ("unused", 4)], "k string, v int")
    want = sorted((i, k, {"hot": 1, "0": 2}.get(k)) for i, k in rows if how == "left" or k in ("hot", "0", "1"))
    assert sorted(((r.id, r.k, r.v) for r in lookup(big, table, "k", how, **options).collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


@pytest.fixture(params=["one window a group", "ranges"])
def path(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(ranks, "SMALL", -1)


def test_ranks_on_both_paths(spark, path):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 1.0, 2.5, -3.0, None, r.random()]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, id long")
    for row in ranks.value_counts(df, ["g"], "x", {"even": (F.col("id") % 2 == 0).cast("long")}).collect():
        same = [(x, i) for g, x, i in rows if g == row.g and x is not None]
        assert row.n == sum(x == row.x for x, _ in same) and row.cum == sum(x <= row.x for x, _ in same) and row.total == len(same)
        assert row.cum_even == sum(x <= row.x and i % 2 == 0 for x, i in same)
        assert row.avg_rank == sum(x < row.x for x, _ in same) + (row.n + 1) / 2
    for row in ranks.running_sums(df, ["g"], "x", "id", {"s": F.col("id")}).collect():
        before = [i for g, x, i in rows if g == row.g and x is not None and (x, i) <= (row.x, row.id)]
        assert (row.i, row.s) == (len(before), sum(before))
    got = {row.id: row for row in ranks.previous(df.where("x IS NOT NULL"), ["g"], ["x", "id"], "p").collect()}
    for g, x, i in rows:
        if x is not None:
            before = [(y, j) for h, y, j in rows if h == g and y is not None and (y, j) < (x, i)]
            assert got[i].p == (max(before)[0] if before else None)
    for row in ranks.hashed_positions(df, ["g"], 1, "id").collect():
        assert row.pos_of == sum(g == row.g for g, _, _ in rows)
    places = [(row.g, row.pos) for row in ranks.hashed_positions(df, ["g"], 1, "id").collect()]
    assert len(set(places)) == 400
    q = {row.g: row.m for row in ranks.quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    import numpy as np

    for g in ("a", "b", None):
        assert q[g] == pytest.approx(np.median([x for h, x, _ in rows if h == g and x is not None]))


def test_tables_end_with_their_scope(spark):
    from pathlib import Path

    with durable.scope():
        t = durable.Stage(spark, "scoped").write(spark.range(3))
        at = Path(t.inputFiles()[0].removeprefix("file://"))
        assert at.exists() and t.count() == 3
    assert not at.exists()


def test_ranks_of_many_classes(spark, monkeypatch):
    """More classes than get a column each give the same statistics."""
    from gridloom.operators import associate

    r = random.Random(5)
    rows = [(r.choice([None, 0.0, 1.0, r.random()]), r.random(), r.choice("abcde")) for _ in range(500)]
    df = spark.createDataFrame(rows, "u double, v double, y string")
    few = {(x.feature, x.level): x for x in associate.cont_class_ranks(df, ["u", "v"], "y").collect()}
    monkeypatch.setattr(associate, "COUNTED", 2)
    many = {(x.feature, x.level): x for x in associate.cont_class_ranks(df, ["u", "v"], "y").collect()}
    assert few.keys() == many.keys() and len(few) == 10
    for k, x in few.items():
        assert tuple(x)[2:] == pytest.approx(tuple(many[k])[2:]), k


def test_no_class_is_cut(spark):
    from gridloom.operators import associate, split

    df = spark.range(24_000).selectExpr("id", "cast(id % 2 as string) a", "cast(id div 2 as string) y", "cast(id % 3 as int) fold", "double(id) v")
    assert associate.cat_class(df, ["a"], "y").where("level IS NOT NULL").count() == 12_000
    assert associate.cont_class_ranks(df, ["v"], "y").count() == 12_000
    assert {r.reason for r in split.degenerate(df, "fold", "y", 1, 2).collect()} == {"too few in train", "too few in test"} or split.degenerate(df, "fold", "y", 1, 2).count() == 3
    assert split.balanced_bootstrap(df, "id", "y", 50, 2).count() == 100
    assert split.group_folds(df, "a", 2, "y").count() == 24_000
