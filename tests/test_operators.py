"""Operators on small fixtures: reference values from NumPy, edge cases, plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import names, nulls, ranks, tails
from gridloom.operators import adaptive, associate, describe, embed, ensemble, inspect, models, prepare, results, score, select, split


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names(spark):
    assert names.clean_name("a.b [c]") == "a_b_c"
    assert names.unique_names(["a", "b", "a"]) == ["a__0", "b", "a__1"]
    df = spark.createDataFrame([(1, 2, 3)], "`x y` int, `x.y` int, t int")
    out, renames = names.sanitize(df, "t")
    assert out.columns == ["x_y__0", "x_y__1", "t"]
    assert renames.apply(["x y", "new"]) == ["x_y__0", "new"]
    with pytest.raises(ValueError):
        names.sanitize(df, "missing")
    assert sorted(["t10", "t2", "a1"], key=names.natural_key) == ["a1", "t2", "t10"]
    assert names.model_safe(["a,b", "ab", "ab"]) == ["ab", "ab_1", "ab_2"]


@pytest.mark.parametrize("seed", range(5))
def test_duplicate_names_stay_unique(seed):
    r = np.random.default_rng(seed)
    given = [str(x) for x in r.choice(list("abcdefgh"), 100)]
    assert len(set(names.unique_names(given))) == 100


def test_nulls(spark):
    df = frame(spark, [("NA", float("nan"), "1"), ("x", 1.0, "2.5"), (None, None, None)], "a string, b double, c string")
    out = nulls.unify_nans(df).collect()
    assert [(r.a, r.b) for r in out] == [(None, None), ("x", 1.0), (None, None)]
    assert nulls.numeric_strings(df) == ["c"]
    assert dict(nulls.floatify(df).dtypes)["c"] == "double"
    assert {r.feature: r.n_null for r in nulls.null_profile(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}


def test_tails():
    # Well-known values.
    assert np.allclose(tails.norm_sf(np.array([0.0, 1.959963984540054])), [0.5, 0.025])
    assert np.isclose(tails.beta_inc(2.0, 3.0, 0.5), 0.6875)
    assert np.isclose(tails.gamma_sf(np.array([0.5]), np.array([3.841458820694124 / 2]))[0], 0.05)
    assert np.isclose(tails.gamma_sf(np.array([5.0]), np.array([18.307038053275146 / 2]))[0], 0.05)
    assert np.allclose(tails.clopper_pearson_upper(np.array([0, 5]), np.array([10, 5]), 0.05), [1 - 0.05 ** (1 / 10), 1.0])


def test_t_and_f_tails(spark):
    df = frame(spark, [(2.0, 5.0), (float("nan"), 5.0), (None, 5.0)], "t double, n double")
    out = [r[0] for r in df.select(tails.t_two_sided("t", "n")).collect()]
    assert np.isclose(out[0], 2 * (1 - 0.9490302605850709)) and np.isnan(out[1] if out[1] is not None else np.nan)
    f = frame(spark, [(4.0,)], "f double").select(tails.f_upper("f", F.lit(1.0), F.lit(5.0))).first()[0]
    assert np.isclose(f, 2 * (1 - 0.9490302605850709))


@pytest.mark.parametrize("seed", range(3))
def test_running_sums_with_heavy_ties(spark, seed):
    r = np.random.default_rng(seed)
    x = np.where(r.random(2000) < 0.5, 0.5, r.integers(0, 40, 2000) / 40)
    pdf = pd.DataFrame({"k": r.integers(0, 2, 2000).astype(str), "x": x, "id": r.permutation(2000), "v": r.integers(0, 2, 2000)})
    got = ranks.running_sums(spark.createDataFrame(pdf), ["k"], "x", "id", {"s": F.col("v")}).toPandas().set_index("id")
    want = pdf.sort_values(["x", "id"])
    want["i"], want["s"] = want.groupby("k").cumcount() + 1, want.groupby("k")["v"].cumsum()
    want = want.set_index("id")
    assert (got["i"].reindex(want.index) == want["i"]).all() and (got["s"].reindex(want.index) == want["s"]).all()


@pytest.mark.parametrize("seed", range(3))
def test_ranks_and_quantiles(spark, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=500), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {row.x: row.avg_rank for row in ranks.value_counts(df, [], "x").collect()}
    want = pd.Series(x).rank()
    assert all(np.isclose(got[a], b) for a, b in zip(x, want))
    q = ranks.quantiles(df, [], "x", {"a": 0.05, "b": 0.5, "c": 1.0}).first()
    assert np.allclose([q.a, q.b, q.c], np.percentile(x, [5, 50, 100]))


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert ranks.value_counts(df, ["k"], "x").count() == 0
    assert ranks.quantiles(df, ["k"], "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("n", [8, 50, 1500])
def test_entropy(spark, n):
    x = np.sort(np.random.default_rng(n).normal(size=n))
    m = int(np.sqrt(n) + 0.5)
    if n <= 10:
        want = np.log((n + 1) / m * (x[m:] - x[:-m])).mean() + sum(1 / k for k in range(m, n + 1)) + np.log(m) - np.log(n + 1)
    else:
        i = np.arange(n)
        gap = x[np.minimum(i + m, n - 1)] - x[np.maximum(i - m, 0)]
        if n > 1000:
            want = np.log(n / (2 * m) * gap).mean()
        else:
            c = np.where(i < m, 1 + i / m, np.where(i >= n - m, 1 + (n - 1 - i) / m, 2.0))
            want = np.log(n / (c * m) * gap).mean()
    got = describe.differential_entropy(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first().entropy
    assert np.isclose(got, want)


def test_describe_edge_cases(spark):
    df = frame(spark, [(None, 1.0, "a"), (None, 1.0, None), (None, float("nan"), "a")], "empty double, const double, c string")
    out = {r.feature: r for r in describe.describe_continuous(df, ["empty", "const"]).collect()}
    assert out["empty"]["mean"] is None and out["const"]["max"] == 1.0 and np.isclose(out["const"].nan_freq, 1 / 3)
    cat = describe.describe_categorical(df, ["c"]).first()
    assert (cat.n_levels, cat.nans, cat.max_name, cat.min_name) == (2, 1, "a", "nan")


@pytest.mark.parametrize("seed", range(3))
def test_mutual_information_finds_dependence(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=400)
    pdf = pd.DataFrame({"i": np.arange(400), "x": x, "noise": r.normal(size=400), "y": (x > 0).astype(int), "z": x + 0.1 * r.normal(size=400)})
    df = spark.createDataFrame(pdf)
    c = {r.feature: r.mut_info for r in associate.mutual_info(df, "i", ["x", "noise"], "y", True).collect()}
    assert c["x"] > 0.5 > 0.15 > c["noise"]
    n = {r.feature: r.mut_info for r in associate.mutual_info(df, "i", ["x", "noise"], "z", False).collect()}
    assert n["x"] > 1.0 > 0.2 > n["noise"]


def information(x, y, classify, k=3):
    """Mutual information of all rows by the full matrices of distances."""
    psi = lambda v: float(np.mean(associate._digamma(np.asarray(v, float))))
    if classify:
        sizes = {c: int((y == c).sum()) for c in set(y)}
        keep = np.array([sizes[c] > 1 for c in y])
        x, y = x[keep], y[keep]
    dx = np.abs(x[:, None] - x) / (1.0 if classify else x.std())
    if not classify:
        dy = np.abs(y[:, None] - y) / y.std()
        r = np.nextafter(np.partition(np.maximum(dx, dy), k, 1)[:, k], 0)[:, None]
        return max(0.0, psi([len(x)]) + psi([k]) - psi((dx <= r).sum(1)) - psi((dy <= r).sum(1)))
    ks = np.array([min(k, sizes[c] - 1) for c in y])
    own = np.sort(np.where(y[:, None] == y, dx, np.inf), 1)
    r = np.nextafter(own[np.arange(len(x)), ks], 0)[:, None]
    return max(0.0, psi([len(x)]) + psi(ks) - psi([sizes[c] for c in y]) - psi((dx <= r).sum(1)))


def test_mutual_information_of_all_rows(spark):
    r = np.random.default_rng(5)
    n = 2000
    x = r.normal(size=n)
    pdf = pd.DataFrame({"i": np.arange(n), "x": x, "cents": np.round(64 * x * x) / 64, "skew": np.where(r.random(n) < 0.6, 0.0, np.exp(3 * r.normal(size=n)))})
    pdf["y"] = np.where(np.arange(n) == 7, "single", np.where(r.random(n) < 0.002, "rare", np.where(np.abs(x) > 0.7, "a", "b")))
    pdf["z"] = np.abs(x) + np.round(r.normal(size=n), 2)
    df, names = spark.createDataFrame(pdf), ["x", "cents", "skew"]
    own = {f: pdf[f].to_numpy() for f in names}
    c = {t.feature: t.mut_info for t in associate.mutual_info(df, "i", names, "y", True).collect()}
    assert c == pytest.approx({f: information(v, pdf.y.to_numpy(str), True) for f, v in own.items()}, abs=1e-9)
    small = associate._information_class(associate.melt(df, names, {"y": df.y}), 3, 8)  # blocks of 8 values
    assert {t.feature: t.mut_info for t in small.collect()} == pytest.approx(c, abs=1e-9)
    wanted = {f: information(v, pdf.z.to_numpy(), False) for f, v in own.items()}
    d = {t.feature: t.mut_info for t in associate.mutual_info(df, "i", names, "z", False).collect()}
    assert d == pytest.approx(wanted, abs=1e-9)
    small = associate._information_numbers(associate.melt(df, names, {"y": df.z}), 3, 16)  # cells of 16 pairs
    assert {t.feature: t.mut_info for t in small.collect()} == pytest.approx(d, abs=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_confusion_scores(spark, seed):
    r = np.random.default_rng(seed)
    y, p = r.integers(0, 3, 40), r.integers(0, 3, 40)
    got = score.class_scores(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), [], "y", "p").first()
    sens, spec = [], []
    for k in np.unique(np.r_[y, p]):
        tp, fn, fp, tn = ((y == k) & (p == k)).sum(), ((y == k) & (p != k)).sum(), ((y != k) & (p == k)).sum(), ((y != k) & (p != k)).sum()
        sens += [tp / (tp + fn)] if tp + fn else []
        spec += [tn / (tn + fp)] if tn + fp else []
    assert np.isclose(got.sens, np.mean(sens)) and np.isclose(got.spec, np.mean(spec)) and np.isclose(got.acc, (y == p).mean())


def test_bins_merge_and_stay_monotonic():
    assert adaptive.merge_bins([0, 1, 2, 3], [5, 1, 1], [1, 1, 0], 3) == ([0, 3], [7], [2])
    assert adaptive.merge_bins([0, 1, 2], [1, 1], [0, 1], 5) == ([0, 2], [2], [1])
    assert adaptive.merge_bins([0, 1, 2, 3, 4], [3, 0, 4, 0], [1, 0, 2, 0], 3) == ([0, 1, 4], [3, 4], [1, 2])
    assert adaptive.merge_bins([0, 1, 2], [0, 0], [0, 0], 1) == ([0, 2], [0], [0])
    out = adaptive.decreasing(np.array([0.1, 0.4, 0.2]), np.array([1.0, 1.0, 2.0]))
    assert (np.diff(out) <= 1e-12).all() and np.isclose(out[1], (0.1 + 0.4) / 2 if out[0] == out[1] != out[2] else out[1])


def test_expected_error_of_odd_confidences(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"s": "m", "c": r.random(300), "w": r.integers(0, 2, 300)})
    bins = adaptive.fit_bins(spark.createDataFrame(pdf), ["s"], "c", F.col("w"))
    rows = frame(spark, [("m", None), ("m", float("nan")), ("m", 2.0), ("m", -1.0), ("other", 0.5)], "s string, c double")
    out = adaptive.expected_error(rows, ["s"], "c", bins).collect()
    by = {(r.s, str(r.c)): r.aer for r in out}
    assert np.isclose(by[("m", "None")], pdf.w.mean()) and np.isclose(by[("m", "nan")], pdf.w.mean()) and by[("other", "0.5")] is None
    assert adaptive.fit_bins(spark.createDataFrame(pdf).limit(0), ["s"], "c", F.col("w")).count() == 0


def test_curve_against_numpy(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": "a", "id": np.arange(200), "risk": np.round(r.random(200), 1), "ok": r.integers(0, 2, 200)})
    got = adaptive.coverage_curve(spark.createDataFrame(pdf), ["k"], "risk", "id", F.col("ok")).orderBy("n_accepted").toPandas()
    want = pdf.sort_values(["risk", "id"])["ok"].cumsum().to_numpy() / np.arange(1, 201)
    assert np.allclose(got["selective_accuracy"], want)


def test_temperature_and_proba(spark):
    df = frame(spark, [([2.0, 0.0], 0), ([2.0, 0.0], 1)] * 10, "logits array<double>, y int")
    assert adaptive.fit_temperature(df, "logits", "y") == pytest.approx(100.0)
    p = frame(spark, [([float("nan"), -1.0, 0.0],), ([1.0, 3.0, 0.0],)], "p array<double>").select(adaptive.normalize_proba(F.col("p")).alias("p")).collect()
    assert p[0].p == pytest.approx([1 / 3] * 3) and p[1].p == pytest.approx([0.25, 0.75, 0.0])


def test_unknown_strategy_and_unsound_stack(spark):
    stack = frame(spark, [(1, "a", 0.5, 0.1, [0.5, 0.5]), (1, "b", 0.5, 0.1, [0.1, 0.9]), (2, "a", 0.5, 0.2, [1.0, 0.0])], "row_id int, model string, acc double, aer double, proba array<double>")
    with pytest.raises(ValueError):
        ensemble.ensemble(stack, "none")
    assert [r.row_id for r in ensemble.check_stack(stack).collect()] == [2]
    for name in ensemble.STRATEGIES:
        out = ensemble.ensemble(stack, name).collect()
        assert len(out) == 2 and all(abs(sum(r.proba) - 1) < 1e-9 for r in out)


@pytest.mark.parametrize("seed", [68, 69])
def test_inference_of_random_columns(spark, seed):
    r = np.random.default_rng(seed)
    n = 500
    pdf = pd.DataFrame({
        "scale": r.integers(0, 50, n), "ident": r.permutation(30000)[:n] + 7, "real": r.normal(size=n), "word": r.choice(list("abcd"), n), "const": "x",
        "flag": r.choice(["y", "n"], n), "day": [f"2024-01-{i % 28 + 1:02d}" for i in range(n)], "uid": [f"u{i}" for i in range(n)],
    })
    s = inspect.inspect(spark.createDataFrame(pdf))
    kind = {c: k[0] for c, k in s.kinds.items()}
    assert kind["const"] == "Const" and kind["real"] == "CertainCont" and kind["word"] == "CertainCat" and kind["flag"] == "Binary"
    assert kind["day"] == "CertainTime" and kind["uid"] == "CertainId" and kind["ident"] == "CertainId" and kind["scale"].endswith("Ord")
    assert set(s.dropped) >= {"const", "day", "uid"} and "real" in s.continuous and "word" in s.categorical


def test_user_kinds_and_empty_table(spark):
    df = frame(spark, [(i % 5, i % 7) for i in range(100)], "a int, b int")
    s = inspect.inspect(df, categoricals=["a", "b"], ordinals=["b"])
    assert s.kinds["a"][0] == "UserCat" and s.kinds["b"][0] == "UserOrd"
    assert all(k[0] == "Const" for k in inspect.inspect(df.limit(0)).kinds.values())


def test_prepare(spark):
    r = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"i": np.arange(n), "x": np.where(r.random(n) < 0.1, np.nan, r.normal(size=n)), "c": r.choice(["a", "b", "c"], n), "rare": ["r%d" % (i % 100) if i < 100 else "common" for i in range(n)], "t": r.choice(["u", "v"], n)})
    p = prepare.prepare(spark.createDataFrame(pdf), ["t"], ["x"], ["c", "rare"], True)
    out = p.df.toPandas()
    assert not out[p.features].isna().any().any() and set(out["t"]) == {0, 1} and p.labels["t"] == {0: "u", 1: "v"}
    assert {"x", "x_NAN", "c_a", "c_b", "c_c", "rare_common"} <= set(p.features) and out["x_norm"].between(0, 1).all()
    assert prepare.columns_of_level(p, "x") == ["x", "x_NAN"]
    with pytest.raises(ValueError):
        prepare.encode_target(spark.createDataFrame(pdf.assign(t="same")), "t")


def test_deflate_name_collision(spark):
    df = frame(spark, [("DEFLATED",)] * 30 + [("x",)] * 2, "c string")
    out = {r.c for r in prepare.fit_deflater(df, ["c"]).apply(df).collect()}
    assert out == {"DEFLATED", "DEFLATED_OTHER"}


def test_iterative_impute_recovers_a_line(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": np.where(np.arange(300) % 10 == 0, np.nan, 2 * a + 1)})
    out = prepare.iterative_impute(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert np.allclose(out["b"], 2 * out["a"] + 1, atol=1e-4)


def test_group_folds_keep_groups(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"i": np.arange(900), "g": np.where(r.random(900) < 0.3, "hot", r.integers(0, 60, 900).astype(str)), "y": r.integers(0, 2, 900)})
    for y in (None, "y"):
        for singly in (4096, 10):
            out = split.group_folds(spark.createDataFrame(pdf), "g", 4, y, singly=singly).toPandas()
            assert len(out) == 900 and (out.groupby("g")["fold"].nunique() == 1).all() and out["fold"].nunique() == 4


def test_same_seed_same_folds(spark):
    df = spark.range(200).withColumn("y", F.col("id") % 3)
    one, two, other = (dict(split.stratified_folds(df, "id", "y", 5, s).select("id", "fold").collect()) for s in (1, 1, 2))
    assert one == two and one != other


def test_source_splits():
    assert split.source_splits([0, 1, 2], "lodo") == [([0], [1, 2]), ([1], [0, 2]), ([2], [0, 1])]
    assert split.source_splits([0, 1, 2], "list") == [([0], [1]), ([0], [2])]
    with pytest.raises(ValueError):
        split.source_splits([0], "x")


def test_bootstraps(spark):
    df = spark.range(500).withColumns({"y": (F.col("id") % 10 == 0).cast("int"), "x": F.col("id") * 1.0})
    draws = split.balanced_bootstrap(df, "id", "y", 200, 2).toPandas()
    assert len(draws) == 400 and 0.4 < draws["y"].mean() < 0.6
    m = split.bootstrap_means(df, [], "x", 100, id_col="id").first()
    assert m.low < m["mean"] < m.high


def test_stepwise_finds_the_signal(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(i=np.arange(400), y=3 * x[:, 2] - x[:, 0] + 0.1 * r.normal(size=400))
    df = spark.createDataFrame(pdf)
    assert [f for f, _ in select.stepwise(df, "i", list("abcd"), "y", 2)] == ["c", "a"]
    assert {f for f, _ in select.stepwise(df, "i", list("abcd"), "y", 2, forward=False)} == {"a", "c"}
    assert select.n_select("cont", 100) == 20 and select.n_select("cat", 3) == 3 and select.n_select("total", 10, 0.25) == 3


def test_wide_tables(spark):
    """500 columns are one pass with an expression a column."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 500))
    names = [f"c{i}" for i in range(500)]
    pdf = pd.DataFrame(x, columns=names).assign(i=np.arange(300), y=x[:, 7] * 2 + 0.01 * r.normal(size=300))
    grams = select.gram(spark.createDataFrame(pdf), "i", names, "y", 2)
    total = sum(grams)
    assert total.shape == (502, 502) and total[0, 0] == 300
    z = np.c_[np.ones(300), x - x.mean(0), pdf["y"] - pdf["y"].mean()]
    assert np.allclose(total, z.T @ z)


def test_models_beat_the_dummy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(i=np.arange(300), y=(x[:, 0] + 0.3 * r.normal(size=300) > 0).astype(int))
    rows = models.assemble(spark.createDataFrame(pdf), "i", ["a", "b"], "y")
    t = models.tune(rows, "lr", True, trials=2, folds=3)
    out = models.predict(t.model, rows, True).toPandas()
    assert t.score > 0.8 and (out["label"] == out["y_pred"]).mean() > 0.8
    cal = spark.createDataFrame(pd.DataFrame({"i": np.arange(300), "s": np.clip(pdf["a"] / 4 + 0.5, 0, 1), "h": pdf["y"]}))
    best, losses = models.choose_calibrator(cal, "i", "s", "h")
    assert losses[best] <= losses["none"]


def test_nearest_is_exact(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    qs = df.where("i < 5").selectExpr("i AS query_id", "v AS vector")
    for metric in ("l2", "cosine"):
        got = results.nearest(df, "i", "v", qs, 3, metric).toPandas()
        for q in range(5):
            d = np.linalg.norm(v - v[q], axis=1) if metric == "l2" else 1 - v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
            assert list(got[got.query_id == q].sort_values("rank")["id"]) == list(np.argsort(d)[:3])


def test_bin_join_of_odd_rows(spark):
    bins = frame(spark, [(0.0, 1.0, "a"), (2.0, 5.0, "b")], "lo double, hi double, n string")
    df = frame(spark, [(0.5,), (1.0,), (4.9,), (9.0,), (None,)], "x double")
    assert {r.x: r.n for r in results.bin_join(df, "x", bins, "lo", "hi").collect()} == {0.5: "a", 1.0: None, 4.9: "b", 9.0: None, None: None}


def test_align_to_reports_missing(spark):
    with pytest.raises(ValueError, match="3"):
        results.align_to(frame(spark, [(1,), (3,)], "i int"), frame(spark, [(1, 2)], "i int, v int"), "i")


def test_embedding(spark):
    assert np.allclose(embed.avg_pool(np.array([[[1.0], [3.0]], [[5.0], [7.0]]]), np.array([[1, 1], [0, 0]])), [[2.0], [0.0]])
    df = frame(spark, [(1, "a b"), (2, None), (3, "")], "i int, text string")
    out = {r.i: r.embedding for r in embed.embed_texts(df, "i", "text").collect()}
    assert out[2] is None and len(out[1]) == 64 and np.isclose(np.linalg.norm(out[1]), 1)
    with pytest.raises(ValueError):
        embed.check_dataset(df)
    assert embed.widen_embedding(frame(spark, [([1.0, 2.0],)], "e array<double>"), "e", 2).columns == ["embed0000", "embed0001"]


def test_embedding_reads_whole_texts(spark):
    start = "w " * 600
    out = {r.i: r.embedding for r in embed.embed_texts(frame(spark, [(1, start + "alpha " * 300), (2, start + "beta " * 300)], "i int, text string"), "i", "text").collect()}
    assert not np.allclose(out[1], out[2])


def test_windows_are_pooled():
    run = embed.windowed(lambda texts: np.array([[len(t.split()), t.count("z")] for t in texts], float), 2)
    assert np.allclose(run(["a b z", "a", ""]), [[5 / 3, 1 / 3], [1, 0], [0, 0]])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_push_down(spark, data):
    t = spark.read.parquet(f"{data}/tuning_results.parquet")
    p = plan(results.top_per_group(t.where("auc <= 1").select("study", "auc", "result_id"), ["study"], "auc", "result_id", 2))
    assert "PushedFilters: [IsNotNull(auc), LessThanOrEqual(auc,1.0)]" in p and "htune_val" not in p
    p = plan(describe.moments(spark.read.parquet(f"{data}/lineitem.parquet"), ["l_tax"]))
    assert "l_comment" not in p and "CartesianProduct" not in p and "l_quantity" not in p


def test_images(spark):
    df = frame(spark, [(1, b"ab", 0), (1, b"ab", 0), (2, None, 1)], "i int, image binary, label int")
    assert embed.image_rows(df).count() == 1
    out = {r.i: r.embedding for r in embed.embed_images(df, "i", "image", lambda xs: np.array([[len(x)] for x in xs])).collect()}
    assert out == {1: [2.0], 2: None}
