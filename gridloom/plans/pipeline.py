"""Queries over cleaning, inference, splits, selection, result tables, joins and models; and the whole analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions.durable import shared_dir
from gridloom.functions.labels import missing_sql, plain, plain_or_null, plain_sql
from gridloom.functions.nulls import NAN_STRINGS, floatify, unify_nans
from gridloom.operators import associate as A
from gridloom.operators import embed as B
from gridloom.operators import inspect as I
from gridloom.operators import models as L
from gridloom.operators import prepare as P
from gridloom.operators import results as R
from gridloom.operators import select as F_
from gridloom.operators import split as X
from gridloom.operators.shape import melt
from gridloom.plans.common import long_sql, rounded, rounded_sql, table
from gridloom.sources import saved
from gridloom.plans.oracles import associations_sql, infer_sql, prepare_sql, profile_sql

NUM = ["a2", "a3", "a11", "a14", "a15"]
CAT = ["a1", "a4", "a5", "a7", "a8"]
METRICS = ["acc", "auc", "sens", "spec"]


def _prep(s, d):
    """prep_rows with labels in plain form, missing ones null."""
    t = table(s, d, "prep_rows")
    return t.withColumns({c: plain_or_null(c) for c in (*CAT, "target")})


def _tuning(s, d):
    """Each result once, labels in plain form, scores that are scores."""
    t = table(s, d, "tuning_results").where(F.col("auc").between(0.0, 1.0)).dropDuplicates(["result_id"])
    return t.withColumns({"model": plain("model"), "feat_select": F.coalesce(plain("feat_select"), F.lit("none"))})


def _long(s, d):
    t = _tuning(s, d).select("result_id", "study", "model", "feat_select", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m"))
    return t.select("result_id", "study", "model", "feat_select", "m.*")


def _normalized(s, d):
    t = table(s, d, "prep_rows").select("row_id", *NUM)
    return rounded(P.fit_normalizer(t, NUM).apply(t))


def _imputed(s, d):
    t = table(s, d, "prep_rows").select("row_id", *NUM)
    return rounded(P.fit_imputer(t, NUM).apply(t))


def _deflated(s, d):
    t = table(s, d, "events").select("event_id", "event_type", "props")
    return P.fit_deflater(t, ["event_type", "props"], 110).apply(t)


def _one_hot(s, d):
    t = _prep(s, d).select("row_id", "a1", "a4")
    return rounded(P.fit_one_hot(t, ["a1", "a4"]).apply(t))


def _target_codes(s, d):
    t, _ = P.encode_target(_prep(s, d).select("row_id", "target"), "target")
    return t


def _multi_target(s, d):
    t, _ = P.encode_targets(_prep(s, d).select("row_id", "a4", "a7", "target"), ["a4", "a7", "target"])
    return t


def _robust_target(s, d):
    t, _ = P.robust_targets(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return rounded(t)


def _inferred(s, d):
    t = table(s, d, "prep_rows")
    return I.inspect(t, target="target", group="g_raw").table(s)


def _prepared(s, d):
    t = table(s, d, "prep_rows")
    p = P.prepare(t.withColumns({c: plain_or_null(c) for c in (*CAT, "target")}), ["target"], NUM, CAT, True, "g_raw")
    return rounded(melt(p.df, p.features, {"row_id": F.col("row_id"), "target": F.col("target")}))


def _round_trip(s, d):
    """The prepared table saved, read back, and shown as ``prepare`` shows it."""
    t = table(s, d, "prep_rows")
    p = P.prepare(t.withColumns({c: plain_or_null(c) for c in (*CAT, "target")}), ["target"], NUM, CAT, True, "g_raw")
    at = f"{shared_dir(s)}/saved-{uuid.uuid4().hex}"
    saved.save_prepared(p, at)
    back = saved.load_prepared(s, at)
    return rounded(melt(back.df, back.features, {"row_id": F.col("row_id"), "target": F.col("target")}))


def _formats(s, d):
    """A table written in each format and read back by its suffix."""
    n = table(s, d, "studies").select("study", "n_samples", "n_cols")
    at = f"{shared_dir(s)}/formats-{uuid.uuid4().hex}"
    copies = [saved.csv_copy(s, n, f"{at}/t", kind).withColumn("kind", F.lit(kind)) for kind in ("csv", "json", "parquet")]
    return R.stack_tables(copies)


def _group_summary(s, d):
    """Rows, groups, groups that lie in more than one fold, and whether the folds' sizes differ by no more than the largest group and a hundredth of the rows."""
    f = _group_folds(s, d)
    per = f.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("k"))
    total = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_torn"), F.max("n").alias("largest"))
    sizes = f.groupBy("fold").count().agg(F.min("count").alias("lo"), F.max("count").alias("hi"), F.count("*").alias("n_folds"))
    return total.crossJoin(sizes).select("n_rows", "n_groups", "n_folds", "n_torn", (F.col("hi") - F.col("lo") <= F.col("largest") + F.col("n_rows") / 100).cast("int").alias("even"))  # one row each


def _group_folds(s, d):
    t = X.group_folds(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", 5, "o_orderstatus")
    return t.select("o_orderkey", "o_custkey", "fold")


def _associations(s, d):
    return A.associations(table(s, d, "prep_rows"), NUM, CAT, "target", True)


def _stepwise(s, d, forward=True):
    t = table(s, d, "prep_rows")
    steps = F_.stepwise(t, "row_id", NUM[:-1], "a15", 3, forward)
    return s.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(steps)], "step int, feature string, r2 double")


def _embedded(s, d):
    rows = table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    kept = F_.by_model(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", True, "tree")
    return s.createDataFrame(kept, "feature string, weight double")


def _selections(s, d):
    """Scores of the numeric features for several class targets, by the range of their level means."""
    parts = []
    for t in ("a1", "a4", "target"):
        m = A.cont_class_moments(_prep(s, d), NUM, t)
        parts.append(m.groupBy("feature").agg(F.max(F.abs(F.col("corr"))).alias("score")).withColumn("target", F.lit(t)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tuned(s, d):
    rows = table(s, d, "prep_rows").where("a15 IS NOT NULL")
    train = L.assemble(rows, "row_id", ["a2", "a3", "a11", "a14"], "a15")
    t = L.tune(train, "elastic", False, trials=4, folds=3)
    return rounded(L.predict(t.model, train, False))


def _oof(s, d):
    rows = table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("i", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    train = L.assemble(rows, "i", ["l_quantity", "l_discount", "l_tax"], "y")
    return L.out_of_fold(train, "lr", {"regParam": 0.01}, True, 3)


def _nearest(s, d):
    e = table(s, d, "embeddings")
    qs = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(R.nearest(e, "vec_id", "embedding", qs, 5), 4)


def _knn(s, d):
    e = table(s, d, "embeddings")
    qs = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(L.knn_predict(e, "vec_id", "embedding", "label", qs, 5), 4)


def _joined(s, d):
    t = table(s, d, "prep_rows")
    base = t.select("row_id")
    others = {"train": t.where("ix_train IS NOT NULL").select("row_id", F.col("a2").alias("p")), "tests": t.where("ix_tests IS NOT NULL").select("row_id", F.col("a3").alias("p"))}
    return R.left_join_predictions(base, others, "row_id", ["p"])


def _bins_joined(s, d):
    bins = s.createDataFrame([(float(i), i * 10.0, i * 10.0 + 7.5) for i in range(5)], "bin double, low double, high double")
    return R.bin_join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", bins, "low", "high").select("l_orderkey", "l_linenumber", "bin")


def _pivot(s, d):
    return R.wide_table(_long(s, d), ["model", "feat_select"], "metric", "value", METRICS)


QUERIES = {
    "unify_nans": lambda s, d: unify_nans(table(s, d, "prep_rows")).select("row_id", *CAT, "g_raw", "target"),
    "floatify": lambda s, d: floatify(table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"))),
    "column_profile": lambda s, d: I.profile(table(s, d, "prep_rows"), [*CAT, "g_raw", "ix_train", "a2"]),
    "infer_types": _inferred,
    "inspect_target_class": lambda s, d: rounded(I.inspect_target(_prep(s, d), "target", True)),
    "inspect_target_number": lambda s, d: rounded(I.inspect_target(table(s, d, "prep_rows"), "a3", False), 4),
    "encode_target": _target_codes,
    "encode_targets": _multi_target,
    "robust_target": _robust_target,
    "group_codes": lambda s, d: P.group_codes(table(s, d, "prep_rows").select("row_id", "g_raw"), "g_raw").select("row_id", "group_code"),
    "impute_median": _imputed,
    "normalize": _normalized,
    "deflate": _deflated,
    "one_hot": _one_hot,
    "prepare": _prepared,
    "iterative_impute": lambda s, d: P.iterative_impute(table(s, d, "prep_rows").select("row_id", *NUM), NUM, 2),
    "stratified_folds": lambda s, d: X.stratified_folds(_prep(s, d).select("row_id", "target"), "row_id", "target", 5),
    "contiguous_folds": lambda s, d: X.contiguous_folds(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7),
    "group_folds": _group_folds,
    "holdout": lambda s, d: X.holdout(_prep(s, d).select("row_id", "target"), "row_id", "target"),
    "group_folds_summary": _group_summary,
    "prepared_round_trip": _round_trip,
    "format_round_trips": _formats,
    "grouped_holdout": lambda s, d: X.grouped_holdout(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus"),
    "subsample": lambda s, d: X.subsample(_prep(s, d).select("row_id", "target"), "row_id", "target", 600),
    "degenerate_folds": lambda s, d: X.degenerate(_prep(s, d).withColumn("fold", F.coalesce("test_no", F.lit(-1))).where("target IS NOT NULL"), "fold", "target", 10, 200),
    "filter_association": lambda s, d: rounded(F_.by_association(_associations(s, d), "mut_info", 3, 2)),
    "univariate_predictions": lambda s, d: L.univariate_predictions(table(s, d, "prep_rows"), "row_id", NUM, "target", True),
    "filter_prediction": lambda s, d: F_.by_prediction(L.univariate_predictions(table(s, d, "prep_rows"), "row_id", NUM[:-1], "a15", False), "mae", False, 3),
    "dummy_class": lambda s, d: rounded(L.dummy_scores(_prep(s, d), "target", True)),
    "dummy_number": lambda s, d: rounded(L.dummy_scores(table(s, d, "orders"), "o_totalprice", False), 3),
    "borda": lambda s, d: rounded(F_.borda(_selections(s, d))),
    "mean_scores": lambda s, d: rounded(F_.mean_scores(_selections(s, d))),
    "select_over_targets": lambda s, d: rounded(F_.aggregate_selections(_selections(s, d))),
    "stepwise_forward": _stepwise,
    "stepwise_backward": lambda s, d: _stepwise(s, d, False),
    "embedded_selection": _embedded,
    "tune_predict": _tuned,
    "out_of_fold": _oof,
    "wide_table": lambda s, d: rounded(_pivot(s, d), 10),
    "metric_by_study": lambda s, d: rounded(R.metric_by_target(_long(s, d).withColumnRenamed("feat_select", "target"), ["model"], "auc", ["auc", "pearson", "d", "pca"])),
    "top_per_group": lambda s, d: R.top_per_group(_tuning(s, d).select("result_id", "study", "auc"), ["study"], "auc", "result_id", 2),
    "grouped_summary": lambda s, d: rounded(R.grouped_summary(_tuning(s, d), ["model"], "auc")),
    "summary_ranges": lambda s, d: rounded(R.summary_ranges([_pivot(s, d), _pivot(s, d).withColumn("acc", F.col("acc") / 2)], ["model", "feat_select"], ["acc", "auc"]), 12),
    "latest_versions": lambda s, d: R.latest_versions(table(s, d, "tuning_results").select("study", "result_id").distinct(), "study", "result_id"),
    "left_join_predictions": _joined,
    "bin_lookup": lambda s, d: R.bin_lookup(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", [0.0, 0.02, 0.05, 0.1]).select("l_orderkey", "l_linenumber", "bin"),
    "bin_join": _bins_joined,
    "common_rows": lambda s, d: R.common_rows(table(s, d, "prep_rows").where("ix_train IS NOT NULL").select("a4", "a5", "a7"), table(s, d, "prep_rows").where("ix_tests IS NOT NULL").select("a4", "a5", "a7")),
    "missing_rows": lambda s, d: R.missing_rows(table(s, d, "studies").select("study"), table(s, d, "tuning_results").select("study")),
    "stack_tables": lambda s, d: R.stack_tables([table(s, d, "prep_rows").where("ix_train IS NOT NULL").select("row_id", "a2"), table(s, d, "prep_rows").where("ix_tests IS NOT NULL").select("a2", "row_id")], "src"),
    "nearest": _nearest,
    "knn_predict": _knn,
    "embed_texts": lambda s, d: B.embed_texts(table(s, d, "documents"), "doc_id", "text"),
    "cosine": lambda s, d: rounded(B.cosine_to(table(s, d, "embeddings"), "embedding", [1.0] + [0.0] * 63, "cosine").select("vec_id", "cosine"), 5),
}

_NANS = ", ".join(f"'{x}'" for x in NAN_STRINGS)


def _unified(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_NANS}) THEN {c} END AS {c}"


_PREP = f"p AS (SELECT * REPLACE ({', '.join(f'CASE WHEN NOT {missing_sql(c)} THEN {plain_sql(c)} END AS {c}' for c in (*CAT, 'target'))}) FROM prep_rows)"
_H = "md5('69:' || CAST({} AS VARCHAR))"
_T = f"""t AS (SELECT result_id, any_value(study) AS study, any_value({plain_sql('model')}) AS model, any_value(coalesce({plain_sql('feat_select')}, 'none')) AS feat_select,
 any_value(acc) AS acc, any_value(auc) AS auc, any_value(sens) AS sens, any_value(spec) AS spec FROM tuning_results WHERE auc >= 0 AND auc <= 1 GROUP BY result_id)"""
_Q = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_mid, quantile_cont({c}, 0.05) AS {c}_lo, quantile_cont({c}, 0.95) AS {c}_hi, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in NUM)


def _clip(c: str, x: str) -> str:
    return f"greatest({c}_lo - {c}_mid - 2 * ({c}_hi - {c}_lo), least({c}_hi - {c}_mid + 2 * ({c}_hi - {c}_lo), {x} - {c}_mid))"


_SEL = " UNION ALL ".join(
    f"SELECT feature, max(abs(c)) AS score, '{t}' AS target FROM (SELECT feature, lv, corr(x, (y = lv)::INT) AS c FROM (SELECT * FROM ({long_sql('p', NUM, keep=f'{t} AS y')}) WHERE x IS NOT NULL AND y IS NOT NULL) l, (SELECT DISTINCT {t} AS lv FROM p WHERE {t} IS NOT NULL) GROUP BY 1, 2) GROUP BY 1"
    for t in ("a1", "a4", "target")
)
_PIV = "SELECT model, feat_select, avg(acc) AS acc, avg(auc) AS auc, avg(sens) AS sens, avg(spec) AS spec FROM t GROUP BY 1, 2"

ORACLE = {
    "unify_nans": f"SELECT row_id, {', '.join(_unified(c) for c in (*CAT, 'g_raw', 'target'))} FROM prep_rows",
    "floatify": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_brand AS brand FROM part",
    "column_profile": profile_sql([*CAT, "g_raw", "ix_train", "a2"]),
    "infer_types": infer_sql(["row_id", "study", "ix_train", "ix_tests", "test_no", *[f"a{i}" for i in range(1, 16)], "loaded_at"], ["loaded_at"]),
    "prepare": prepare_sql(),
    "prepared_round_trip": prepare_sql(),
    "format_round_trips": " UNION ALL ".join(f"SELECT study, CAST(n_samples AS VARCHAR) AS n_samples, CAST(n_cols AS VARCHAR) AS n_cols, '{k}' AS kind FROM studies" for k in ("csv", "json", "parquet")),
    "group_folds_summary": "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT o_custkey) AS n_groups, CAST(5 AS BIGINT) AS n_folds, CAST(0 AS BIGINT) AS n_torn, 1 AS even FROM orders",
    "filter_association": rounded_sql(associations_sql(), ["score"]),
    "inspect_target_class": rounded_sql(
        f"WITH {_PREP}, c AS (SELECT target, count(*) AS k FROM p GROUP BY target) SELECT max(k) FILTER (WHERE target IS NOT NULL) / sum(k) AS p_max, min(k) FILTER (WHERE target IS NOT NULL) / sum(k) AS p_min, coalesce(sum(k) FILTER (WHERE target IS NULL), 0) / sum(k) AS p_nan, count(target) AS n_classes FROM c",
        ["p_max", "p_min", "p_nan"],
    ),
    "inspect_target_number": rounded_sql("SELECT avg(a3) AS mean, var_pop(a3) AS var, avg((a3 IS NULL)::INT) AS p_nan, CAST(var_pop(a3) > 0 AS INT) AS varies FROM prep_rows", ["mean", "var", "p_nan"], 4),
    "encode_target": f"WITH {_PREP}, k AS (SELECT target, dense_rank() OVER (ORDER BY target) - 1 AS code FROM p WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 20) SELECT row_id, CAST(code AS INT) AS target FROM p JOIN k USING (target)",
    "encode_targets": f"""WITH {_PREP}, r AS (SELECT row_id, a4, a7, target, (count(*) OVER (PARTITION BY a4) <= 20)::INT + (count(*) OVER (PARTITION BY a7) <= 20)::INT + (count(*) OVER (PARTITION BY target) <= 20)::INT AS rare
  FROM p WHERE a4 IS NOT NULL AND a7 IS NOT NULL AND target IS NOT NULL), g AS (SELECT * FROM r WHERE rare <= 1)
SELECT row_id, CAST(dense_rank() OVER (ORDER BY a4) - 1 AS INT) AS a4, CAST(dense_rank() OVER (ORDER BY a7) - 1 AS INT) AS a7, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS target FROM g""",
    "robust_target": rounded_sql("SELECT o_orderkey, (o_totalprice - m) / w AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.975) - quantile_cont(o_totalprice, 0.025) AS w FROM orders)", ["o_totalprice"]),
    "group_codes": f"WITH g AS (SELECT g_raw, row_number() OVER (ORDER BY {_H.format('g_raw')}) - 1 AS c FROM (SELECT DISTINCT g_raw FROM prep_rows WHERE g_raw IS NOT NULL)) SELECT row_id, coalesce(c, -1) AS group_code FROM prep_rows LEFT JOIN g USING (g_raw)",
    "impute_median": rounded_sql(
        f"SELECT row_id, {', '.join(f'coalesce({c}, {c}_mid) AS {c}' for c in NUM)}, {', '.join(f'CAST({c} IS NULL AS DOUBLE) AS {c}_NAN' for c in NUM)} FROM prep_rows, (SELECT {_Q} FROM prep_rows)", [*NUM, *[f"{c}_NAN" for c in NUM]]
    ),
    "deflate": "SELECT event_id, CASE WHEN event_type IS NULL OR count(*) OVER (PARTITION BY event_type) >= 110 THEN event_type ELSE 'DEFLATED' END AS event_type, CASE WHEN props IS NULL OR count(*) OVER (PARTITION BY props) >= 110 THEN props ELSE 'DEFLATED' END AS props FROM events",
    "one_hot": f"""WITH {_PREP} SELECT row_id, CAST(a1 IS NOT DISTINCT FROM 'slate' AS DOUBLE) AS a1_slate, CAST(a1 IS NULL AS DOUBLE) AS a1_nan, CAST(a4 IS NOT DISTINCT FROM 'owned' AS DOUBLE) AS a4_owned,
CAST(a4 IS NOT DISTINCT FROM 'rented' AS DOUBLE) AS a4_rented, CAST(a4 IS NOT DISTINCT FROM 'shared' AS DOUBLE) AS a4_shared, CAST(a4 IS NULL AS DOUBLE) AS a4_nan FROM p""",
    "stratified_folds": f"WITH {_PREP} SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY {_H.format('row_id')}, row_id) - 1) % 5 AS INT) AS fold FROM p",
    "contiguous_folds": "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders",
    "holdout": f"WITH {_PREP} SELECT row_id, target, CAST(row_number() OVER (PARTITION BY target ORDER BY {_H.format('row_id')}, row_id) <= round(0.6::DOUBLE * count(*) OVER (PARTITION BY target)) AS INT) AS is_train FROM p",
    "subsample": f"WITH {_PREP}, r AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY {_H.format('row_id')}, row_id) AS i, count(*) OVER (PARTITION BY target) AS k, count(*) OVER () AS n FROM p WHERE target IS NOT NULL) SELECT row_id, target FROM r WHERE i <= greatest(20, round(k * least(1.0::DOUBLE, 600.0::DOUBLE / n)))",
    "degenerate_folds": f"""WITH {_PREP}, c AS (SELECT coalesce(test_no, -1) AS fold, target, count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY 1, 2), t AS (SELECT target, sum(n) AS t FROM c GROUP BY 1), f AS (SELECT DISTINCT fold FROM c),
g AS (SELECT f.fold, count(*) FILTER (WHERE t - coalesce(n, 0) > 0) AS a, count(*) FILTER (WHERE n > 0) AS b, min(t - coalesce(n, 0)) AS x, min(n) AS y FROM f CROSS JOIN t LEFT JOIN c ON c.fold = f.fold AND c.target = t.target GROUP BY 1),
r AS (SELECT fold, CASE WHEN a <= 1 THEN 'one class in train' WHEN b <= 1 THEN 'one class in test' WHEN x < 10 THEN 'too few in train' WHEN y < 200 THEN 'too few in test' END AS reason FROM g) SELECT * FROM r WHERE reason IS NOT NULL""",
    "dummy_class": rounded_sql(f"WITH {_PREP}, c AS (SELECT count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY target) SELECT 'mode' AS model, 'acc' AS metric, max(n) / sum(n) AS score FROM c UNION ALL SELECT 'prior', 'acc', sum(n * n) / pow(sum(n), 2) FROM c", ["score"]),
    "dummy_number": rounded_sql(
        "WITH m AS (SELECT avg(o_totalprice) AS a, quantile_cont(o_totalprice, 0.5) AS q FROM orders) SELECT 'mean' AS model, 'mae' AS metric, avg(abs(o_totalprice - a)) AS score FROM orders, m UNION ALL SELECT 'median', 'mae', avg(abs(o_totalprice - q)) FROM orders, m", ["score"], 3
    ),
    "borda": rounded_sql(
        f"""WITH {_PREP}, s AS ({_SEL}), r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY score DESC) + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY target) AS n FROM s),
a AS (SELECT feature, sum(n - r + 1) AS points, count(DISTINCT target) AS support FROM r GROUP BY feature), b AS (SELECT *, points * pow(support / 3.0, 0.5) AS raw FROM a) SELECT feature, points::DOUBLE AS points, support, raw / max(raw) OVER () AS score FROM b""",
        ["points", "score"],
    ),
    "mean_scores": rounded_sql(f"WITH {_PREP}, s AS ({_SEL}) SELECT feature, avg(score) AS score FROM s GROUP BY feature", ["score"]),
    "wide_table": rounded_sql(f"WITH {_T} {_PIV}", METRICS, 10),
    "metric_by_study": rounded_sql(
        f"WITH {_T}, w AS (SELECT model, avg(auc) FILTER (WHERE feat_select = 'auc') AS auc, avg(auc) FILTER (WHERE feat_select = 'pearson') AS pearson, avg(auc) FILTER (WHERE feat_select = 'd') AS d, avg(auc) FILTER (WHERE feat_select = 'pca') AS pca FROM t GROUP BY model) SELECT *, list_avg([auc, pearson, d, pca]) AS mean FROM w",
        ["auc", "pearson", "d", "pca", "mean"],
    ),
    "top_per_group": f"WITH {_T} SELECT result_id, study, auc, CAST(row_number() OVER (PARTITION BY study ORDER BY auc DESC, result_id) AS INT) AS rank FROM t QUALIFY rank <= 2",
    "grouped_summary": rounded_sql(
        f"WITH {_T} SELECT model, count(*) AS count, avg(auc) AS mean, min(auc) AS min, max(auc) AS max, {', '.join(f'quantile_cont(auc, {v}) AS {n}' for n, v in (('p05', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95)))} FROM t GROUP BY model",
        ["mean", "min", "max", "p05", "p25", "p50", "p75", "p95"],
    ),
    "summary_ranges": rounded_sql(
        f"WITH {_T}, w AS ({_PIV}), u AS (SELECT model, feat_select, acc, auc FROM w UNION ALL SELECT model, feat_select, acc / 2, auc FROM w) SELECT model, feat_select, avg(acc) AS acc, printf('%.3f–%.3f', round(round(min(acc), 9), 3), round(round(max(acc), 9), 3)) AS acc_range, avg(auc) AS auc, printf('%.3f–%.3f', round(round(min(auc), 9), 3), round(round(max(auc), 9), 3)) AS auc_range FROM u GROUP BY 1, 2",
        ["acc", "auc"], 12,
    ),
    "latest_versions": "SELECT study, max(result_id) AS result_id FROM tuning_results GROUP BY study",
    "left_join_predictions": "SELECT row_id, CASE WHEN ix_train IS NOT NULL THEN a2 END AS p__train, CASE WHEN ix_tests IS NOT NULL THEN a3 END AS p__tests FROM prep_rows",
    "bin_lookup": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 ELSE 2 END AS bin FROM lineitem",
    "bin_join": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 50 AND l_quantity % 10 < 7.5 THEN floor(l_quantity / 10) END AS bin FROM lineitem",
    "common_rows": "SELECT a4, a5, a7 FROM prep_rows WHERE ix_train IS NOT NULL INTERSECT SELECT a4, a5, a7 FROM prep_rows WHERE ix_tests IS NOT NULL",
    "missing_rows": "SELECT study FROM studies EXCEPT SELECT study FROM tuning_results",
    "stack_tables": "SELECT row_id, a2, 0 AS src FROM prep_rows WHERE ix_train IS NOT NULL UNION ALL SELECT row_id, a2, 1 FROM prep_rows WHERE ix_tests IS NOT NULL",
    "nearest": rounded_sql(
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(q.v, e.v) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) AS INT) AS rank FROM e, e q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5",
        ["distance"], 4,
    ),
    "knn_predict": rounded_sql(
        f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
z AS (SELECT q.vec_id AS query_id, e.label, list_distance(q.v, e.v) AS d FROM e, e q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) <= 5),
w AS (SELECT query_id, label, count(*) AS k, min(d) AS d FROM z GROUP BY 1, 2) SELECT query_id, arg_min(label, {{'a': -k, 'b': label}}) AS y_pred, max(k) / sum(k) AS vote, min(d) AS min_dist FROM w GROUP BY query_id""",
        ["vote", "min_dist"], 4,
    ),
    "cosine": rounded_sql("SELECT vec_id, CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS cosine FROM embeddings", ["cosine"], 5),
}
ORACLE["select_over_targets"] = f"SELECT feature, score FROM ({ORACLE['borda']})"
ORACLE["normalize"] = rounded_sql(
    f"SELECT row_id, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN ({_clip(c, c)} - {_clip(c, f'{c}_min')}) / ({_clip(c, f'{c}_max')} - {_clip(c, f'{c}_min')}) END AS {c}' for c in NUM)} FROM prep_rows, (SELECT {_Q} FROM prep_rows)", NUM
)
