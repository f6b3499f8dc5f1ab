import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.topn import bisect_groups, top_n_per_group

ORDER = [("s", "desc"), ("sd", "asc")]
SCHEMA = "g string, h int, s double, sd double, id long"


def brute(rows, n):
    groups = {}
    for g, h, s, sd, i in set(rows):
        if i is not None:
            s = None if s is None or s != s else s + 0.0
            sd = None if sd is None or sd != sd else sd + 0.0
            groups.setdefault((g, h), set()).add((s is None, -(s or 0), sd is None, sd or 0, i))
    return {(k, x[4], r) for k, v in groups.items() for r, x in enumerate(sorted(v)[:n], 1)}


def run(spark, rows, n, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {((r.g, r.h), r.id, r["rank"]) for r in top_n_per_group(df, ["g", "h"], ORDER, "id", n, **options).collect()}


@pytest.mark.parametrize("seed,block", [(0, 16), (1, 1 << 18), (2, 16)])
def test_against_brute_force(spark, seed, block):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(600):
        g = "hot" if r.random() < 0.4 else None if r.random() < 0.1 else str(r.integers(0, 30))
        s = r.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.5, 1.0, -3.25, 1e300, float(r.random())])
        sd = r.choice([None, 0.1, 0.1, 0.2, float("nan")])
        row = (g, int(r.integers(0, 2)), s, sd, int(r.integers(-5, 500)) if r.random() < 0.98 else None)
        rows += [row] * int(r.integers(1, 3))
    for n in (1, 3, 50):
        assert run(spark, rows, n, block_rows=block) == brute(rows, n)


def test_edge_cases(spark):
    assert run(spark, [], 3) == set()
    assert run(spark, [("a", 1, 0.5, None, 1)], 0) == set()
    assert run(spark, [("a", 1, None, None, 9), ("a", 1, None, None, 2)], 3) == {(("a", 1), 2, 1), (("a", 1), 9, 2)}
    assert run(spark, [("a", 1, float("inf"), 0.0, 1), ("a", 1, float("-inf"), 0.0, 2), ("a", 1, None, 0.0, 3)], 9) == {(("a", 1), 1, 1), (("a", 1), 2, 2), (("a", 1), 3, 3)}


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 0.5, 1, "x", "y", 3)], "g string, s float, i int, k0 string, rank string, id int")
    out = top_n_per_group(df, ["g"], [("s", "desc")], "i", 2)
    assert out.columns == ["g", "s", "i", "rank"] and out.first()["rank"] == 1
    twice = df.select("*", F.lit(1).alias("extra"), F.lit(2).alias("extra"))
    assert top_n_per_group(twice, ["g"], [("s", "desc")], "i", 2).count() == 1


def test_no_keys_is_one_group(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 7 * 1.0)
    assert [r.id for r in top_n_per_group(df, [], [("s", "desc")], "id", 2).orderBy("rank").collect()] == [6, 13]


def test_bisection_takes_exactly_n():
    r = np.random.default_rng(0)
    gid = r.integers(0, 5, 5000)
    words = [r.integers(0, 4, 5000).astype(np.uint64), np.arange(5000, dtype=np.uint64)]
    kept = bisect_groups(gid, words, 7)
    assert (np.bincount(gid[kept]) == 7).all()
    assert len(bisect_groups(gid[:0], [w[:0] for w in words], 7)) == 0


def test_at_most_n_rows_of_a_group_leave_a_block(spark):
    df = spark.range(100_000, numPartitions=4).select(F.lit("hot").alias("g"), F.rand(1).alias("s"), "id")
    plan = top_n_per_group(df, ["g"], [("s", "desc")], "id", 3)
    assert plan.count() == 3
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 2 and text.count("Exchange") == 1


def test_found_query(spark, data, duck):
    from compare import assert_same

    from gridloom.llm.oracle import ORACLE
    from gridloom.llm.queries import QUERIES

    for name in ("p1_found", "p1_best"):
        assert_same(QUERIES[name](spark, data), duck.sql(ORACLE[name]))




def test_lowest_words_and_repeats(spark):
    """The largest identifiers and the least whole numbers keep their own words; repeats never push rows out."""
    top = 2**63 - 1
    rows = [("g", 0, 0.5, 0.1, top), ("g", 0, 0.5, 0.1, top - 1), *[("g", 0, 0.5, 0.1, 3)] * 40, *[("g", 0, 0.5, 0.1, 4)] * 30]
    assert run(spark, rows, 4) == brute(rows, 4) and len(run(spark, rows, 4)) == 4
    whole = spark.createDataFrame([("g", -top - 1, 1), ("g", -top, 2), ("g", None, 3), ("g", top, 4)], "g string, s long, id long")
    assert [r.id for r in top_n_per_group(whole, ["g"], [("s", "desc")], "id", 9).orderBy("rank").collect()] == [4, 2, 1, 3]
    assert [r.id for r in top_n_per_group(whole, ["g"], [("s", "asc")], "id", 9).orderBy("rank").collect()] == [1, 2, 4, 3]
    assert [r.id for r in top_n_per_group(whole, [], [("s", "asc")], "id", 2, block_rows=1).orderBy("rank").collect()] == [1, 2]
