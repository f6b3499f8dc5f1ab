import numpy as np
import pandas as pd
import pytest

from gridloom.operators import associate as A
from gridloom.operators import models as L
from gridloom.operators import prepare as P
from gridloom.operators import select as Q
from gridloom.options import Options
from gridloom.plans import analysis
from gridloom.sources import saved
from gridloom.plans.analysis import _associations, analyse


def table(n=300, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    return pd.DataFrame({"x one": x, "noise": r.normal(size=n), "c": np.where(x > 0.5, "hi", r.choice(["lo", "mid"], n)), "id": [f"r{i}" for i in range(n)], "y": np.where(x + 0.3 * r.normal(size=n) > 0, "yes", "no"), "z": 2 * x + 0.1 * r.normal(size=n)})


def test_classes_with_adaptive_error(spark, tmp_path):
    df = spark.createDataFrame(table().drop(columns="z"))
    o = Options(target="y", classifiers=["lr"], htune_trials=1, feat_select=["filter"], filter_method=["assoc"], adaptive_error=True, aer_oof_folds=2, aer_ensemble=True, aer_ensemble_strategies=["strategy1_min_aer"], outdir=str(tmp_path))
    r = analyse(spark, o, df)
    assert r.schema.kinds["id"][0] == "CertainId" and "x_one" in r.selected["y.assoc"]
    acc = {(x.selection, x.metric): x.value for x in r.tables["performance"].collect()}
    assert acc[("none", "acc")] > 0.75
    back = spark.read.parquet(f"{r.folder}/results/adaptive_error_bins")
    assert back.count() >= 1 and (tmp_path / r.folder / "results/report.md").exists()
    assert r.tables["ensemble_strategy1_min_aer"].count() == r.tables["per_sample"].count() > 100
    again = analyse(spark, o, None, resume=True)  # no table given: what is read back was saved
    assert again.selected == r.selected and again.schema.kinds == r.schema.kinds and set(again.tables) == set(r.tables)
    rows = lambda x: sorted(map(str, x.tables["performance"].collect()))
    assert rows(again) == rows(r)
    kept = saved.load_run(spark, r.folder).prepared
    assert kept.one_hot.levels and kept.df.count() == 300 and kept.labels == {"y": {0: "no", 1: "yes"}}
    assert saved.load_run(spark, str(tmp_path / "nothing")) is None


def test_numbers(spark):
    df = spark.createDataFrame(table().drop(columns="y"))
    r = analyse(spark, Options(target="z", mode="regress", regressors=["elastic"], htune_trials=1, wrapper_select="step-up", n_feat_wrapper=2), df)
    assert r.selected["z.wrap"][0] == "x_one"
    r2 = {(x.selection, x.metric): x.value for x in r.tables["performance"].collect()}
    assert r2[("wrap", "r2")] > 0.9


def test_association_filter_follows_the_options(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=400)
    pdf = pd.DataFrame({"bowl": x, "noise": r.normal(size=400), "c": r.choice(["u", "v"], 400), "y": np.where(np.abs(x) > 0.7, 1, 0)})
    p = P.prepare(spark.createDataFrame(pdf), ["y"], ["bowl", "noise"], ["c"], True)
    # The classes differ in spread, not in place: information tells, ranks don't.
    t = _associations(p, "y", True, Options())
    best = {b.kind: b for b in Q.by_association(t, "score", 1, 1).collect()}
    assert {k: b.feature for k, b in best.items()} == {"cont": "bowl", "cat": "c"} and best["cont"].score > 0.3
    assert {"t", "U", "AUROC", "mut_info", "cramer_v", "H"} <= set(t.columns) and {x.level for x in t.where("feature = 'bowl'").collect()} == {None, "0", "1"}
    n = A.cat_cont(spark.createDataFrame(pdf.assign(c=np.where(x > 0, "u", "v"), d=r.choice(["u", "v"], 400))), ["c", "d"], "bowl")
    info = {k.feature: k.mut_info for k in n.collect()}
    assert info["c"] > 0.6 > 0.1 > info["d"]


def test_search_gets_trials_and_metric(spark, monkeypatch):
    class Seen(Exception):
        pass

    def tune(train, family, classify, trials, folds, **given):
        raise Seen(trials, given["metric"])

    monkeypatch.setattr(analysis.L, "tune", tune)
    monkeypatch.setattr(analysis, "_associations", lambda p, *rest: p.df)
    with pytest.raises(Seen) as seen:
        analyse(spark, Options(target="z", mode="regress", regressors=["elastic"], feat_select=[], htune_reg_metric="r2"), spark.createDataFrame(table(60).drop(columns="y")))
    assert seen.value.args == (100, "r2")


def test_search_by_another_metric(spark):
    rows = spark.createDataFrame(table(60)).selectExpr("cast(substr(id, 2) as int) i", "`x one` x", "z")
    t = L.tune(L.assemble(rows, "i", ["x"], "z"), "elastic", False, 2, 2, metric="r2")
    assert 0.5 < t.score <= 1 and len(t.trials) == 2
    with pytest.raises(ValueError):
        L.tune(rows, "elastic", False, metric="acc")


def test_unknown_values_are_refused(spark):
    for bad in ({"nan": "guess"}, {"wrapper_model": "lgbm"}, {"mt_agg_strategy": "vote"}, {"aer_confidence_metric": "tree"}, {"filter_pred_classify": "auc"}):
        with pytest.raises(ValueError):
            analyse(spark, Options(target="y", **bad), spark.createDataFrame(table(40)))


def test_rows_are_numbered_by_what_they_hold(spark):
    pdf = pd.DataFrame({"a": [1, 2, 2, 3, None], "b": ["x", "y", "y", None, "z"]})
    one = {(r.a, r.b, r[analysis.ROW]) for r in analysis.numbered(spark.createDataFrame(pdf)).collect() if r.a == r.a}
    two = {(r.a, r.b, r[analysis.ROW]) for r in analysis.numbered(spark.createDataFrame(pdf.iloc[::-1]).repartition(3)).collect() if r.a == r.a}
    assert one == two and len({i for _, _, i in one}) == 4


def test_missing_numbers(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=200)
    pdf = pd.DataFrame({"u": np.where(r.random(200) < 0.2, np.nan, x), "v": 2 * x, "y": np.where(x > 0, "a", "b")})
    df = spark.createDataFrame(pdf)
    dropped = P.prepare(df, ["y"], ["u", "v"], [], True, nan="drop")
    assert dropped.df.count() == pdf["u"].notna().sum() and dropped.indicators == []
    guessed = P.prepare(df, ["y"], ["u", "v"], [], True, nan="impute")
    got = guessed.df.select("u", "v", "u_NAN").toPandas()
    assert guessed.indicators == ["u_NAN"[:-4]] and got["u_NAN"].sum() == pdf["u"].isna().sum() and np.allclose(got["u"], got["v"] / 2, atol=1e-6)


def test_one_feature_models_of_both_kinds(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=400)
    pdf = pd.DataFrame({"i": np.arange(400), "x": r.normal(size=400), "c": np.where(x > 0, "u", "v"), "y": np.where(x > 0, "a", "b")})
    s = {(k.feature, k.model): k for k in L.univariate_predictions(spark.createDataFrame(pdf), "i", ["x"], "y", True, categorical=["c"], metrics=["acc", "bal-acc", "f1"]).collect()}
    assert s[("c", "linear")]["acc"] == 1.0 and s[("c", "linear")]["f1"] == 1.0 and s[("x", "linear")]["bal-acc"] < 0.7
    steps = Q.stepwise(spark.createDataFrame(pdf.assign(z=np.abs(x), t=np.digitize(x, [-0.5, 0.5]) * 5 % 3)), "i", ["x", "z"], "t", 1, classes=[0, 1, 2])
    assert steps[0][0] == "z"
