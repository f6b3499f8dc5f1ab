"""Queries over predictions: scores, calibration, adaptive error, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.labels import plain, plain_sql
from gridloom.operators import adaptive as E
from gridloom.operators import ensemble as N
from gridloom.operators import score as S
from gridloom.plans.common import rounded, rounded_sql, table
from gridloom.plans.oracles import bins_sql, crossfit_sql, risk_sql

SRC = ["source"]
TARGETS = (0.5, 0.8, 0.95)
ACCURACIES = (0.7, 0.9, 0.99)


def samples(s: SparkSession, d: str) -> DataFrame:
    """Each sample once, its source in plain form."""
    t = table(s, d, "test_samples").select("sample_id", plain("source").alias("source"), "y_true", "y_pred", "correct", "confidence", "aer", "p_max", "p_2nd", "p_margin")
    return t.dropDuplicates(["sample_id"])


def _wrong():
    return F.col("y_true") != F.col("y_pred")


def _valid(s, d):
    return samples(s, d).where(F.col("confidence").between(0.0, 1.0))


def _bins(s, d, **options):
    return E.fit_bins(_valid(s, d), SRC, "confidence", _wrong(), **options)


def _curve(s, d):
    return E.coverage_curve(samples(s, d), SRC, "aer", "sample_id", ~_wrong())


def stack(s: SparkSession, d: str) -> DataFrame:
    """Four models' made-up probabilities and expected errors of every row."""
    i = F.col("row_id")
    models = []
    for k, m in enumerate(("bag", "dtree", "rf", "svm")):
        p = [(i * a + k * b) % c + 1.0 for a, b, c in ((3, 17, 89), (5, 29, 83), (11, 7, 79))]
        total = p[0] + p[1] + p[2]
        models.append(F.struct(F.lit(m).alias("model"), F.lit(0.6 + 0.05 * k).alias("acc"), ((i * 7 + k * 131) % 101 / 101.0).alias("aer"), F.array(*[x / total for x in p]).alias("proba")))
    return table(s, d, "prep_rows").select("row_id", F.explode(F.array(*models)).alias("m")).select("row_id", "m.*")


def _ensemble(name: str):
    def run(s, d):
        e = N.ensemble(stack(s, d), name)
        return rounded(e.select("row_id", *[F.col("proba")[k].alias(f"p{k}") for k in range(3)], "r_star"))

    return run


def _regression(s, d):
    t = table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p"))
    return rounded(S.regression_scores(t, ["l_returnflag"], "y", "p"), 4)


def _multi(s, d):
    t = samples(s, d).select("y_true", "y_pred", F.col("correct").cast("int").alias("t2"), (F.col("p_max") >= 0.5).cast("int").alias("p2"))
    return rounded(S.multi_target_scores(t, [("y_true", "y_pred"), ("t2", "p2")]))


QUERIES = {
    "confusion": lambda s, d: S.confusion(samples(s, d), SRC, "y_true", "y_pred").withColumn("label", F.col("label").cast("int")),
    "class_scores": lambda s, d: rounded(S.class_scores(samples(s, d), SRC, "y_true", "y_pred")),
    "auroc_confidence": lambda s, d: rounded(S.auroc(_valid(s, d), SRC, "confidence", F.col("y_true") == F.col("y_pred"))),
    "regression_scores": _regression,
    "multi_target_scores": _multi,
    "calibration_scores": lambda s, d: rounded(S.calibration_scores(samples(s, d), "y_true", "p_max", ~_wrong())),
    "brier": lambda s, d: rounded(S.brier(samples(s, d), SRC, "aer", _wrong())),
    "reliability": lambda s, d: rounded(S.reliability(samples(s, d), [], "aer", _wrong())),
    "calibration_error": lambda s, d: rounded(S.calibration_error(S.reliability(samples(s, d), SRC, "aer", _wrong()), SRC), 10),
    "drift_rate": lambda s, d: rounded(S.drift_rate(samples(s, d).where("p_max + p_2nd <= 1.0").select("y_pred", F.array("p_max", "p_2nd").alias("proba")), "proba", "y_pred")),
    "threshold_accuracies": lambda s, d: rounded(S.threshold_accuracies(samples(s, d), [], "confidence", ~_wrong())),
    "aer_bins": lambda s, d: rounded(_bins(s, d, min_count=20, smooth=False).drop("raw_error")),
    "aer_bins_smooth": lambda s, d: rounded(_bins(s, d, monotonic=True)),
    "aer_bins_adaptive": lambda s, d: rounded(_bins(s, d, adaptive=True)),
    "aer_lookup": lambda s, d: rounded(E.expected_error(samples(s, d).select("sample_id", "source", "confidence"), SRC, "confidence", _bins(s, d, min_count=20, smooth=False), "expected").select("sample_id", "expected")),
    "error_bins": lambda s, d: rounded(E.error_bins(samples(s, d), SRC, "confidence", "aer", _wrong(), 5), 10),
    "coverage_curve": lambda s, d: rounded(_curve(s, d)),
    "curve_area": lambda s, d: rounded(E.curve_area(_curve(s, d), SRC)),
    "at_coverage": lambda s, d: rounded(E.at_coverage(_curve(s, d), SRC, TARGETS)),
    "at_accuracy": lambda s, d: rounded(E.at_accuracy(_curve(s, d), SRC, ACCURACIES)),
    "risk_threshold": lambda s, d: rounded(E.risk_threshold(samples(s, d), SRC, "aer", _wrong(), 0.4)),
    "crossfit_risk": lambda s, d: rounded(E.crossfit_risk(_valid(s, d), SRC, "sample_id", "confidence", _wrong())),
    "confidence_minmax": lambda s, d: rounded(E.fit_transform_confidence(samples(s, d).select("sample_id", "source", "p_margin"), SRC, "p_margin", "minmax").select("sample_id", "confidence")),
    "confidence_exp": lambda s, d: rounded(E.fit_transform_confidence(samples(s, d).select("sample_id", "source", "p_margin"), SRC, "p_margin", "exp_gamma").select("sample_id", "confidence")),
    "confidence_metrics": lambda s, d: rounded(E.confidence_metrics(stack(s, d).select("row_id", "model", "proba"), "proba").drop("proba")),
    "select_confidence": lambda s, d: rounded(E.select_confidence(samples(s, d), "sample_id", ["p_max", "p_margin", "confidence"], _wrong())),
    "best_per_model": lambda s, d: rounded(E.best_per_model(table(s, d, "tuning_results").select(plain("model").alias("model"), "auc", "result_id").where("auc <= 1"), "model", "auc", "result_id")),
    **{f"ensemble_{k}": _ensemble(k) for k in N.STRATEGIES},
}

_S = f"""s AS (SELECT sample_id, any_value({plain_sql('source')}) AS source, any_value(y_true) AS y_true, any_value(y_pred) AS y_pred, any_value(correct) AS correct, any_value(confidence) AS confidence,
  any_value(aer) AS aer, any_value(p_max) AS p_max, any_value(p_2nd) AS p_2nd, any_value(p_margin) AS p_margin, any_value((y_true <> y_pred)::INT) AS wrong FROM test_samples GROUP BY sample_id)"""
_CONF = f"""{_S}, lb AS (SELECT source, y_true AS label FROM s UNION SELECT source, y_pred FROM s),
k AS (SELECT source, count(*) = 2 AND min(label) = 0 AND max(label) = 1 AS bin FROM lb GROUP BY source),
c AS (SELECT lb.source, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_true <> label AND y_pred = label) AS fp,
  count(*) FILTER (WHERE y_true = label AND y_pred <> label) AS fn, count(*) FILTER (WHERE y_true <> label AND y_pred <> label) AS tn
  FROM lb JOIN s ON s.source = lb.source JOIN k ON k.source = lb.source WHERE NOT bin OR label = 1 GROUP BY 1, 2)"""
_EDGE = "CAST(greatest(0, least({b} - 1, CASE WHEN {x} < floor({x} * {b}) * (1.0::DOUBLE / {b}) THEN floor({x} * {b}) - 1 WHEN {x} >= (floor({x} * {b}) + 1) * (1.0::DOUBLE / {b}) THEN floor({x} * {b}) + 1 ELSE floor({x} * {b}) END)) AS INT)"


def _bin(x: str, b: str) -> str:
    return _EDGE.format(x=x, b=b)


_WILSON = "greatest(0.0, ({p} + 3.8416 / (2 * n) - 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) AS wilson_low, least(1.0, ({p} + 3.8416 / (2 * n) + 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) AS wilson_high"
_REL = f"""{_S}, r AS (SELECT source, least(1.0, greatest(0.0, aer)) AS p, wrong FROM s WHERE aer IS NOT NULL AND NOT isnan(aer)), g AS (SELECT __K {_bin('p', '10')} AS bin, count(*) AS n, sum(wrong) AS e, avg(p) AS pm FROM r GROUP BY ALL)"""
_CURVE = f"""{_S}, r AS (SELECT source, sample_id, least(1.0, greatest(0.0, aer)) AS threshold, 1 - wrong AS good FROM s WHERE aer IS NOT NULL AND NOT isnan(aer) AND NOT isinf(aer)),
c AS (SELECT source, sample_id, row_number() OVER w / count(*) OVER (PARTITION BY source) AS coverage, sum(good) OVER (PARTITION BY source ORDER BY threshold, sample_id ROWS UNBOUNDED PRECEDING) / row_number() OVER w AS selective_accuracy,
  threshold, row_number() OVER w AS n_accepted FROM r WINDOW w AS (PARTITION BY source ORDER BY threshold, sample_id))"""
# Merging of neighbouring bins up to 20 rows, as a recursion over a source's bins.
_FIT = f"""{_S}, v AS (SELECT source, least(1.0, greatest(0.0, confidence)) AS c, wrong FROM s WHERE confidence >= 0 AND confidence <= 1),
st AS (SELECT source, count(*) AS n, sum(wrong) AS e, stddev_pop(c) AS sd, max(c) - min(c) AS span FROM v GROUP BY source),
b0 AS (SELECT *, greatest(1, least(20, n // 20)) AS q FROM st),
b AS (SELECT source, n, e, CAST(CASE WHEN span < 1e-6 THEN 1 WHEN sd < 0.05 OR n < 100 THEN least(5, q) WHEN n < 500 THEN least(10, q) WHEN n < 1000 THEN least(15, q) ELSE q END AS INT) AS b FROM b0),
p AS (SELECT v.source, {_bin('v.c', 'b.b')} AS i, count(*) AS c, sum(wrong) AS w FROM v JOIN b ON v.source = b.source GROUP BY 1, 2),
f AS (SELECT b.source, i.i, coalesce(c, 0) AS c, coalesce(w, 0) AS w, b.b FROM b, LATERAL (SELECT unnest(range(b.b)) AS i) i LEFT JOIN p ON p.source = b.source AND p.i = i.i),
rec AS (SELECT source, i, b, c AS acc, 0 AS grp, c >= 20 AS done FROM f WHERE i = 0 UNION ALL
  SELECT f.source, f.i, f.b, CASE WHEN r.done THEN f.c ELSE r.acc + f.c END, CASE WHEN r.done THEN r.grp + 1 ELSE r.grp END, CASE WHEN r.done THEN f.c ELSE r.acc + f.c END >= 20 FROM rec r JOIN f ON f.source = r.source AND f.i = r.i + 1),
l AS (SELECT source, max(grp) FILTER (WHERE done) AS last FROM rec GROUP BY source),
m AS (SELECT f.source, least(grp, coalesce(last, 0)) AS bin, min(f.i) AS i0, max(f.i) AS i1, any_value(f.b) AS b, sum(c) AS n, sum(w) AS e FROM rec JOIN f ON f.source = rec.source AND f.i = rec.i JOIN l ON l.source = f.source GROUP BY 1, 2),
fit AS (SELECT m.source, CAST(bin AS INT) AS bin, i0 * (1.0::DOUBLE / m.b) AS bin_left, CASE WHEN i1 = m.b - 1 THEN 1.0 ELSE (i1 + 1) * (1.0::DOUBLE / m.b) END AS bin_right, m.n, m.e,
  CASE WHEN m.n > 0 THEN (m.e + 2.0 * least(greatest(b.e / b.n, 1e-6), 1 - 1e-6)) / (m.n + 2.0) ELSE b.e / b.n END AS expected_error FROM m JOIN b ON b.source = m.source)"""
_CLIPPED = "SELECT source, least(1.0, greatest(0.0, confidence)) AS c, wrong FROM s WHERE confidence >= 0 AND confidence <= 1"
_CANDIDATES = " UNION ALL ".join(f"SELECT sample_id, '{c}' AS source, least(1.0, greatest(0.0, {c})) AS c, wrong FROM s WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in ("p_max", "p_margin", "confidence"))
_STACK = """k AS (SELECT * FROM (VALUES (0, 'bag'), (1, 'dtree'), (2, 'rf'), (3, 'svm')) t(k, model)),
a AS (SELECT row_id, model, 0.6 + 0.05 * k AS acc, ((row_id * 7 + k * 131) % 101) / 101.0::DOUBLE AS aer, ((row_id * 3 + k * 17) % 89) + 1.0::DOUBLE AS a, ((row_id * 5 + k * 29) % 83) + 1.0::DOUBLE AS b, ((row_id * 11 + k * 7) % 79) + 1.0::DOUBLE AS c FROM prep_rows, k),
t AS (SELECT row_id, model, acc::DOUBLE AS acc, aer, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2, row_number() OVER (PARTITION BY row_id ORDER BY aer, acc DESC, model) AS rk, exp(-5.0 * greatest(1e-9, least(1.0, aer))) AS x FROM a)"""
_MEAN = "sum(w * p0) / sum(w) AS p0, sum(w * p1) / sum(w) AS p1, sum(w * p2) / sum(w) AS p2, sum(w * aer) / sum(w) AS r_star"


def _weights(w: str, more: str = "") -> str:
    return rounded_sql(f"WITH {_STACK}{more}, z AS (SELECT *, {w} AS w FROM {'t' if not more else 'u'}) SELECT row_id, {_MEAN} FROM z GROUP BY row_id", ["p0", "p1", "p2", "r_star"])


def _top(score: str) -> str:
    return _weights("CASE WHEN rk = first THEN 1.0 ELSE 0.0 END", f", q AS (SELECT *, {score} AS sc, max({score}) OVER (PARTITION BY row_id) AS best FROM t), u AS (SELECT *, min(rk) FILTER (WHERE best - sc <= 1e-12) OVER (PARTITION BY row_id) AS first FROM q)")


ORACLE = {
    "confusion": f"WITH {_CONF} SELECT source, label, tp, fp, fn, tn FROM c",
    "class_scores": rounded_sql(
        f"""WITH {_CONF}, macro AS (SELECT source, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS sens, avg(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) AS spec,
  avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) AS ppv, avg(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END) AS npv FROM c GROUP BY source),
pl AS (SELECT lb.source, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS h, count(*) FILTER (WHERE y_true = label) AS t, count(*) FILTER (WHERE y_pred = label) AS q FROM lb JOIN s USING (source) GROUP BY 1, 2),
f AS (SELECT source, avg(2.0 * h / (t + q)) AS f1, avg(CASE WHEN t > 0 THEN h / t END) AS bal_acc FROM pl GROUP BY source), a AS (SELECT source, count(*) AS n, 1 - avg(wrong) AS acc FROM s GROUP BY source)
SELECT source, n, acc, sens, spec, ppv, npv, f1, bal_acc FROM a JOIN macro USING (source) JOIN f USING (source)""",
        ["acc", "sens", "spec", "ppv", "npv", "f1", "bal_acc"],
    ),
    "auroc_confidence": rounded_sql(
        f"""WITH {_S}, r AS (SELECT source, 1 - wrong AS g, rank() OVER (PARTITION BY source ORDER BY confidence) + (count(*) OVER (PARTITION BY source, confidence) - 1) / 2.0 AS r FROM s WHERE confidence >= 0 AND confidence <= 1),
u AS (SELECT source, sum(g) AS n1, sum(1 - g) AS n0, sum(g * r) AS r1 FROM r GROUP BY source)
SELECT source, CASE WHEN n0 > 0 AND n1 > 0 THEN 0.5 + abs(0.5 - (r1 - n1 * (n1 + 1) / 2) / (n0 * n1)) ELSE 0.5 END AS auroc FROM u""",
        ["auroc"],
    ),
    "regression_scores": rounded_sql(
        """SELECT l_returnflag, avg(abs(e)) AS mae, avg(e * e) AS msqe, quantile_cont(abs(e), 0.5) AS mdae, 1 - avg(e * e) / var_pop(y) AS r2, 1 - var_pop(e) / var_pop(y) AS var_exp
FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1000.0 AS e FROM lineitem) GROUP BY l_returnflag""",
        ["mae", "msqe", "mdae", "r2", "var_exp"], 4,
    ),
    "multi_target_scores": rounded_sql(
        f"""WITH {_S}, t AS (SELECT y_true AS a, y_pred AS b, correct::INT AS c, (p_max >= 0.5)::INT AS d FROM s)
SELECT avg((a = b AND c = d)::INT) AS subset_acc, 1 - avg((a = b)::INT + (c = d)::INT) / 2 AS hamming_loss, sqrt(avg(pow(a - b, 2) + pow(c - d, 2))) AS multi_rmse FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""",
        ["subset_acc", "hamming_loss", "multi_rmse"],
    ),
    "calibration_scores": rounded_sql(
        f"""WITH {_S}, t AS (SELECT CAST(y_true AS VARCHAR) AS label, greatest(1e-15, least(1.0, p_max)) AS p, 1 - wrong AS h FROM s WHERE p_max IS NOT NULL AND y_true IS NOT NULL)
SELECT label, count(*) AS n, avg(-ln(p)) AS log_loss, avg(pow(1 - p, 2)) AS brier, avg(h) AS acc FROM t GROUP BY ROLLUP (label)""",
        ["log_loss", "brier", "acc"],
    ),
    "brier": rounded_sql(f"WITH {_S} SELECT source, avg(pow(least(1.0, greatest(0.0, aer)) - wrong, 2)) AS brier FROM s WHERE aer IS NOT NULL AND NOT isnan(aer) AND NOT isinf(aer) GROUP BY source", ["brier"]),
    "reliability": rounded_sql(
        f"WITH {_REL.replace('__K', '')} SELECT bin, bin * 0.1::DOUBLE AS bin_left, (bin + 1) * 0.1::DOUBLE AS bin_right, (bin * 0.1::DOUBLE + (bin + 1) * 0.1::DOUBLE) / 2 AS bin_center, n AS count, CAST(e AS BIGINT) AS error_count, e / n AS error_rate, pm AS p_pred_mean, {_WILSON.format(p='(e / n)')} FROM g",
        ["bin_left", "bin_right", "bin_center", "error_rate", "p_pred_mean", "wilson_low", "wilson_high"],
    ),
    "calibration_error": rounded_sql(f"WITH {_REL.replace('__K', 'source,')} SELECT source, sum(n * abs(e / n - pm)) / sum(n) AS ece FROM g GROUP BY source", ["ece"], 10),
    "drift_rate": rounded_sql(f"WITH {_S} SELECT avg(((CASE WHEN p_max >= p_2nd THEN 0 ELSE 1 END) <> y_pred)::INT) AS drift FROM s WHERE p_max + p_2nd <= 1.0", ["drift"]),
    "threshold_accuracies": rounded_sql(
        f"WITH {_S}, g AS (SELECT least(floor(confidence * 50), 50) AS st, count(*) AS c, sum(1 - wrong) AS h FROM s WHERE confidence >= 0 AND confidence <= 1 GROUP BY 1) SELECT st / 50 AS threshold, CAST(sum(c) OVER w AS BIGINT) AS n, sum(h) OVER w / sum(c) OVER w AS acc FROM g WINDOW w AS (ORDER BY st DESC)",
        ["threshold", "acc"],
    ),
    "aer_bins": rounded_sql(
        f"WITH RECURSIVE {_FIT} SELECT source, bin, bin_left, bin_right, (bin_left + bin_right) / 2 AS bin_center, CAST(n AS BIGINT) AS count, CAST(e AS BIGINT) AS error_count, expected_error, {_WILSON.format(p='(e / n)')} FROM fit",
        ["bin_left", "bin_right", "bin_center", "expected_error", "wilson_low", "wilson_high"],
    ),
    "aer_bins_smooth": bins_sql(_S, _CLIPPED, _WILSON.format(p="(e / n)"), monotonic=True),
    "aer_bins_adaptive": bins_sql(_S, _CLIPPED, _WILSON.format(p="(e / n)"), adaptive=True),
    "crossfit_risk": rounded_sql(f"{crossfit_sql(_S, 'SELECT sample_id, source, confidence AS c, wrong FROM s WHERE confidence >= 0 AND confidence <= 1')} SELECT source, sample_id, fold, aer FROM risk", ["aer"]),
    "select_confidence": rounded_sql(f"{crossfit_sql(_S, _CANDIDATES)} SELECT source AS metric, avg(pow(aer - wrong, 2)) AS brier FROM risk GROUP BY source", ["brier"]),
    "risk_threshold": risk_sql(_S, 0.4),
    "aer_lookup": rounded_sql(
        f"""WITH RECURSIVE {_FIT}, o AS (SELECT source, sum(e) / sum(n) AS overall FROM fit GROUP BY source)
SELECT sample_id, CASE WHEN confidence IS NULL OR isnan(confidence) OR isinf(confidence) THEN overall ELSE expected_error END AS expected
FROM s LEFT JOIN o ON o.source = s.source LEFT JOIN fit ON fit.source = s.source AND least(1.0, greatest(0.0, confidence)) >= bin_left AND (least(1.0, greatest(0.0, confidence)) < bin_right OR bin_right = 1.0) AND NOT isnan(confidence)""",
        ["expected"],
    ),
    "error_bins": rounded_sql(
        f"""WITH {_S}, r AS (SELECT source, {_bin('confidence', '5')} AS bin, wrong, aer FROM s WHERE confidence >= 0 AND confidence <= 1), e AS (SELECT source, unnest([0, 1, 2, 3, 4]) AS bin FROM (SELECT DISTINCT source FROM r)),
g AS (SELECT source, bin, count(*) AS c, sum(wrong) AS w, avg(aer) AS m FROM r GROUP BY 1, 2)
SELECT e.source, e.bin, coalesce(c, 0) AS count, CAST(coalesce(w, 0) AS BIGINT) AS error_count, m AS mean_expected, w / c AS error_rate FROM e LEFT JOIN g ON g.source = e.source AND g.bin = e.bin""",
        ["mean_expected", "error_rate"], 10,
    ),
    "coverage_curve": rounded_sql(f"WITH {_CURVE} SELECT * FROM c", ["coverage", "selective_accuracy", "threshold"]),
    "curve_area": rounded_sql(
        f"WITH {_CURVE}, z AS (SELECT source, coverage, selective_accuracy AS a, lag(coverage, 1, 0.0) OVER w AS c0, coalesce(lag(selective_accuracy) OVER w, selective_accuracy) AS a0 FROM c WINDOW w AS (PARTITION BY source ORDER BY n_accepted)) SELECT source, sum((coverage - c0) * (a + a0) / 2) AS auc_coverage_accuracy FROM z GROUP BY source",
        ["auc_coverage_accuracy"],
    ),
    "at_coverage": rounded_sql(
        f"WITH {_CURVE}, t AS (SELECT unnest([0.5, 0.8, 0.95]::DOUBLE[]) AS target_coverage) SELECT source, target_coverage, coverage, selective_accuracy, threshold, n_accepted FROM c, t QUALIFY row_number() OVER (PARTITION BY source, target_coverage ORDER BY abs(coverage - target_coverage), coverage) = 1",
        ["coverage", "selective_accuracy", "threshold"],
    ),
    "at_accuracy": rounded_sql(
        f"""WITH {_CURVE}, t AS (SELECT unnest([0.7, 0.9, 0.99]::DOUBLE[]) AS target_accuracy), q AS (SELECT *, selective_accuracy >= target_accuracy AS ok FROM c, t)
SELECT source, target_accuracy, coverage, selective_accuracy, threshold, n_accepted, CASE WHEN ok THEN 'ok' ELSE 'below_target' END AS status FROM q
QUALIFY row_number() OVER (PARTITION BY source, target_accuracy ORDER BY ok DESC, CASE WHEN ok THEN coverage ELSE selective_accuracy END DESC, coverage DESC) = 1""",
        ["coverage", "selective_accuracy", "threshold"],
    ),
    "confidence_minmax": rounded_sql(
        f"WITH {_S}, q AS (SELECT source, quantile_cont(p_margin, 0.01) AS lo, quantile_cont(p_margin, 0.99) AS hi FROM s WHERE p_margin IS NOT NULL GROUP BY source) SELECT sample_id, CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (p_margin - lo) / (hi - lo))) WHEN p_margin IS NOT NULL THEN 0.5 END AS confidence FROM s LEFT JOIN q USING (source)",
        ["confidence"],
    ),
    "confidence_exp": rounded_sql(
        f"WITH {_S}, q AS (SELECT source, quantile_cont(p_margin, 0.5) AS m FROM s WHERE p_margin IS NOT NULL GROUP BY source) SELECT sample_id, exp(-p_margin / CASE WHEN m > 0 THEN m ELSE 1.0 END) AS confidence FROM s LEFT JOIN q USING (source)",
        ["confidence"],
    ),
    "confidence_metrics": rounded_sql(
        f"WITH {_STACK}, z AS (SELECT row_id, model, list_reverse_sort([p0, p1, p2]) AS p FROM t) SELECT row_id, model, p[1] AS p_max, p[2] AS p_2nd, p[1] - p[2] AS p_margin FROM z", ["p_max", "p_2nd", "p_margin"]
    ),
    "best_per_model": rounded_sql(
        f"SELECT {plain_sql('model')} AS m, 0 AS x FROM tuning_results".replace("AS m, 0 AS x", "AS model, result_id, auc") + f" WHERE auc <= 1 AND {plain_sql('model')} <> 'dummy' QUALIFY row_number() OVER (PARTITION BY {plain_sql('model')} ORDER BY auc DESC, result_id) = 1", ["auc"]
    ),
    "ensemble_strategy1_min_aer": _weights("CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END"),
    "ensemble_strategy2_topn": _weights("CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END"),
    "ensemble_strategy3_acc_minus_aer": _top("acc - aer"),
    "ensemble_strategy4_exp_weighted": _weights("x"),
    "ensemble_strategy5_dynamic_threshold": _weights(
        "CASE WHEN aer <= lim OR least_aer > lim THEN 1.0 ELSE 0.0 END",
        """, e AS (SELECT row_id, avg(aer) AS e, min(aer) AS least_aer FROM t GROUP BY row_id), q AS (SELECT quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3 FROM e),
u AS (SELECT t.*, least_aer, 0.3 * CASE WHEN e < q1 THEN 0.8 WHEN e > q3 THEN 1.5 ELSE 1.0 END AS lim FROM t JOIN e USING (row_id), q)""",
    ),
    "ensemble_strategy6_overconfidence_penalty": _top("acc - 0.5 * aer"),
    "ensemble_strategy7_calibration_aware": _top("0.7 * acc - (1.0 - 0.7) * aer"),
    "ensemble_strategy8_trimmed_weighted": _weights("CASE WHEN aer <= cut THEN x ELSE 0.0 END", ", u AS (SELECT t.*, cut FROM t JOIN (SELECT row_id, quantile_cont(aer, 0.6) AS cut FROM t GROUP BY row_id) USING (row_id))"),
    "ensemble_strategy9_borda_rank": rounded_sql(
        f"""WITH {_STACK}, z AS (SELECT row_id, x, aer, 3 - (p1 > p0)::INT - (p2 > p0)::INT AS b0, 3 - (p0 >= p1)::INT - (p2 > p1)::INT AS b1, 3 - (p0 >= p2)::INT - (p1 >= p2)::INT AS b2 FROM t)
SELECT row_id, sum(x * b0) / sum(x * (b0 + b1 + b2)) AS p0, sum(x * b1) / sum(x * (b0 + b1 + b2)) AS p1, sum(x * b2) / sum(x * (b0 + b1 + b2)) AS p2, sum(x * aer) / sum(x) AS r_star FROM z GROUP BY row_id""",
        ["p0", "p1", "p2", "r_star"],
    ),
    "ensemble_strategy10_switching_hybrid": _weights(
        "CASE WHEN least_aer <= 0.15 THEN CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END WHEN least_aer <= 0.35 THEN CASE WHEN rk <= 3 THEN x ELSE 0.0 END ELSE acc * x END",
        ", u AS (SELECT *, min(aer) OVER (PARTITION BY row_id) AS least_aer FROM t)",
    ),
}
