import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.cutoff import fraction_cutoffs
from gridloom.llm.termfreq import LastSeen, marked_terms, term_counts


@pytest.mark.parametrize("counters", [2, 1 << 20])
def test_term_counts(spark, counters):
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        terms = None if r.random() < 0.05 else [r.choice(["hot", "nan", "", None, str(r.integers(0, 40)), "x" * 5000]) for _ in range(r.integers(0, 6))]
        rows += [(i, terms)] * int(r.integers(1, 3))
    want: dict = {}
    for i, terms in dict(rows).items():
        for t in terms or []:
            if t:
                want.setdefault(t, []).append(i)
    df = spark.createDataFrame([*rows, (None, ["lost"])], "id long, terms array<string>")
    got = {x.term: (x.occurrences, x.records) for x in term_counts(df, "id", F.col("terms"), counters).collect()}
    assert got == {t: (len(v), len(set(v))) for t, v in want.items()}


def test_last_seen_across_feeds():
    import pyarrow as pa

    s = LastSeen()
    s.feed(pa.array(["a", "b", "a"]), np.array([1, 1, 1]))
    s.feed(pa.array(["a", "c"]), np.array([1, 2]))
    t = s.table().to_pydict()
    assert dict(zip(t["term"], zip(t["occurrences"], t["records"]))) == {"a": (3, 1), "b": (1, 1), "c": (1, 1)}


def test_marks(spark):
    df = spark.createDataFrame([(1, ["a", "a"]), (2, ["a", "b"]), (3, None), (4, [])], "id int, term array<string>")
    out = {r.term: (r.rare, r.common, r.n_records) for r in marked_terms(df, "id", F.col("term"), 2, 0.25).collect()}
    assert out == {"a": (False, True, 4), "b": (True, False, 4)}
    assert marked_terms(df.limit(0), "id", F.col("term"), 2, 0.25).count() == 0


def brute(samples, targets):
    out = {}
    best: dict = {}
    for s, c in targets:
        if s is not None and c is not None and c == c:
            best[s] = max(c, best.get(s, -9.0))
    for s, c in best.items():
        x = sorted((v for i, (src, v) in dict(samples).items() if src == s), reverse=True)
        ok = [t for t in x if sum(v >= t for v in x) >= c * len(x)]
        if ok:
            out[s] = max(ok)
    return out


@pytest.mark.parametrize("seed,block,wave", [(0, 7, 3), (1, 1 << 18, 1 << 16)])
def test_cutoffs(spark, seed, block, wave):
    r = np.random.default_rng(seed)
    samples, seen = [], []
    for i in range(800):
        src = "hot" if r.random() < 0.4 else str(r.integers(0, 12))
        v = float(r.random()) if r.random() < 0.5 else float(r.choice([0.0, -0.0, 0.5, 1.0]))
        samples.append((i, (src, v)))
        seen += [(i, src, v)] * int(r.integers(1, 3))
    odd = [(9000, "hot", None), (9001, "hot", float("nan")), (9002, "hot", 1.5), (9003, "hot", -0.1), (None, "hot", 0.9), (9004, None, 0.9)]
    targets = [("hot", 0.3), ("hot", None), ("1", 0.0), ("2", 1.0), ("3", 1.2), ("4", float("nan")), ("5", 0.8125), ("5", 0.5), ("none", 0.5), (None, 0.5)]
    df = spark.createDataFrame(seen + odd, "i long, src string, v double").withColumns({"source": F.lit("x"), "score": F.lit("y")})
    _, cuts = fraction_cutoffs(df, "i", F.col("src"), "v", spark.createDataFrame(targets, "source string, fraction double"), block, wave)
    assert {c.source: c.threshold for c in cuts.collect()} == brute(samples, targets)


def test_nothing_to_cut(spark):
    df = spark.createDataFrame([], "i long, src string, v double")
    t = spark.createDataFrame([("a", 0.5)], "source string, fraction double")
    for d, g in ((df, t), (spark.createDataFrame([(1, "b", 0.5)], df.schema), t), (df, t.limit(0))):
        valid, cuts = fraction_cutoffs(d, "i", F.col("src"), "v", g)
        assert cuts.count() == 0 and valid.count() == d.count()
