import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.labels import MISSING_LABELS, plain_or_null
from gridloom.llm.overlap import interleave, near_classes, near_pairs

NUM, TXT = ["n1", "n2", "n3"], ["w1", "w2", "w3", "w4"]
SCHEMA = "id long, s string, " + ", ".join(f"{c} double" for c in NUM) + ", " + ", ".join(f"{c} string" for c in TXT) + ", band string, bucket string"


def agree(x, y, tol):
    x, y = (None if v is not None and v != v else v for v in (x, y))
    if x is None or y is None:
        return x is y
    return x == y or abs(x - y) <= tol * max(abs(x), abs(y)) < float("inf")


def text(v):
    p = None if v is None else " ".join(v.replace("\t", " ").split(" ")).strip().lower()
    p = None if p is None else " ".join(p.split())
    return None if p is None or p in MISSING_LABELS else p


def brute(rows, tol, most):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "a" and b[1] == "b" and a[0] is not None and b[0] is not None:
                d = sum(not agree(x, y, tol) for x, y in zip(a[2:5], b[2:5])) + sum(text(x) != text(y) for x, y in zip(a[5:9], b[5:9]))
                if d <= most:
                    out.add((a[0], b[0], d))
    return out


def run(spark, rows, tol=0.005, most=1, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = near_pairs(df, "id", F.col("s"), NUM, {c: plain_or_null(c) for c in TXT}, tol, most, **options).collect()
    assert len({(r.id_a, r.id_b) for r in out}) == len(out)
    return {(r.id_a, r.id_b, r.n_differing) for r in out}


def made(seed, n=160):
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        if rows and r.random() < 0.6:
            base = list(rows[r.integers(0, len(rows))])
            for k in r.choice(7, r.integers(0, 3), replace=False):
                if k < 3:
                    base[2 + k] = None if base[2 + k] is None else base[2 + k] * (1 + r.uniform(-0.0055, 0.0055))
                else:
                    base[2 + k] = r.choice(["x", " X\t", "y", "NA", None])
        else:
            base = [0, "", *[r.choice([None, 0.0, -1.0, float("nan"), float("inf")]) if r.random() < 0.2 else float(r.choice([1, -1]) * np.exp(r.normal(3, 2))) for _ in range(3)], *[r.choice(["x", "y", " z  q", None, "n/a"]) for _ in range(4)], "c", "d"]
        rows.append(tuple([len(rows), str(r.choice(["a", "b"])), *base[2:]]))
    return rows


@pytest.mark.parametrize("seed,hot,most", [(0, 0, 1), (1, 10_000, 1), (2, 0, 0), (3, 3, 1)])
def test_no_pair_is_lost(spark, seed, hot, most):
    rows = made(seed)
    assert run(spark, rows, most=most, hot_pairs=hot) == brute(rows, 0.005, most)


def test_numbers_at_cell_edges(spark):
    rows = []
    for i, x in enumerate(np.exp(np.linspace(0, 0.4, 120))):
        rows.append((2 * i, "a", float(x), 1.0, None, "p", "q", None, "", "", ""))
        rows.append((2 * i + 1, "b", float(x * (1 - 0.0049)), 1.0, None, "p", "q", "none", " - ", "", ""))
    assert run(spark, rows, most=0) == brute(rows, 0.005, 0)


def test_edge_cases(spark):
    assert run(spark, []) == set()
    nothing = (None,) * 7
    rows = [(1, "a", *nothing, "", ""), (2, "b", *nothing, "", ""), (None, "b", *nothing, "", ""), (3, None, *nothing, "", ""), (1, "a", *nothing, "", "")]
    assert run(spark, rows) == {(1, 2, 0)}
    with pytest.raises(ValueError):
        run(spark, rows, most=2)


def test_bands_hold_every_feature_once():
    a, b = interleave(["n0", "n1", "n2", "n3", "n4"], [f"w{i}" for i in range(10)])
    assert sorted(a + b) == sorted([f"n{i}" for i in range(5)] + [f"w{i}" for i in range(10)]) and abs(len(a) - len(b)) <= 1


def test_copies_are_compared_once(spark):
    """120 equal rows on either side are one pair of classes, however often the pair shares a bucket."""
    rows = [(i, "ab"[i % 2], 1.0, 2.0, 3.0, "x", "y", "z", "u", "", "") for i in range(240)] + [(1000, "b", 1.0, 2.0, 9.0, "x", "y", "z", "u", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    o = near_classes(df, "id", F.col("s"), NUM, {c: F.col(c) for c in TXT}, 0.005, 1, hot_pairs=0, keep=["bucket"])
    pairs = o.pairs.collect()
    assert sorted((p.n_a, p.n_b, p.n_differing) for p in pairs) == [(120, 1, 1), (120, 120, 0)]
    assert o.members.count() == 241 and "bucket" in o.members.columns
    for chunk in (7, 1 << 14):
        got = {(r.id_a, r.id_b) for r in o.expanded(chunk).collect()}
        assert len(got) == 120 * 121 and o.expanded(chunk).count() == len(got)
