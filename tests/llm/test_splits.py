import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.splits import deal, entities, grouped_splits, spanning_forest

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def components(links):
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    out: dict = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def made(kind, seed):
    r = np.random.default_rng(seed)
    if kind == "path":
        return [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    if kind == "star":
        return [("hub", f"n{i}") for i in range(80)] + [("hub", "hub"), (None, "hub"), ("lone", None)]
    return [(f"n{r.integers(0, 90)}", f"n{r.integers(0, 90)}") for _ in range(70)] * 2


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_forest(spark, kind):
    links = made(kind, 1)
    f = spanning_forest(spark.createDataFrame(links, "a string, b string"))
    groups: dict = {}
    for r in f.members.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert {frozenset(v) for v in groups.values()} == components(links) and all(k in v for k, v in groups.items())
    edges = [tuple(e) for e in f.edges.collect()]
    assert len(edges) == sum(len(v) - 1 for v in groups.values()) and components(edges) == components(links)


def test_no_links(spark):
    f = spanning_forest(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string"))
    assert f.members.count() == 0 and f.edges.count() == 0 and f.rounds == 0


def test_entities(spark):
    f = spanning_forest(spark.createDataFrame([("a", "b")], "a string, b string"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (None, "a")], "id int, g string")
    out = {r.id: r.entity for r in entities(df, ["id"], F.col("g"), f).collect()}
    assert set(out) == {1, 2, 3, 4} and out[1] == out[2] != out[3] and out[4] is None


@pytest.mark.parametrize("seed", range(2))
def test_splits_hold_entities_and_shares(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, None if r.random() < 0.05 else "hot" if r.random() < 0.3 else f"n{r.integers(0, 400)}") for i in range(4000)]
    links = [(f"n{r.integers(0, 400)}", f"n{r.integers(0, 400)}") for _ in range(60)]
    df = spark.createDataFrame(rows, "id long, g string")
    out, _ = grouped_splits(df, "id", F.col("g"), spark.createDataFrame(links, "a string, b string"), SHARES)
    pdf = out.toPandas()
    assert len(pdf) == 4000 and (pdf.groupby("entity")["split"].nunique() == 1).all()
    of = dict(zip(pdf["id"], pdf["entity"]))
    for group in components(links):
        assert len({of[i] for i, g in rows if g in group}) <= 1
    share = pdf["split"].value_counts(normalize=True)
    assert all(abs(share[k] - v) < 0.02 for k, v in SHARES.items())


def test_deal_edge_cases(spark):
    sizes = spark.createDataFrame([], "entity string, rows long")
    assert deal(sizes, SHARES).count() == 0
    one = deal(spark.createDataFrame([("a", 5)], "entity string, rows long"), SHARES).collect()
    assert [(r.entity, r.split) for r in one] == [("a", "train")]
    many = spark.range(20_000).select(F.col("id").cast("string").alias("entity"), F.lit(1).cast("long").alias("rows"))
    share = {r.split: r["count"] / 20_000 for r in deal(many, SHARES).groupBy("split").count().collect()}
    assert all(abs(share[k] - v) < 0.005 for k, v in SHARES.items())
