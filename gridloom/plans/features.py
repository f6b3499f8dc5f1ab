"""Queries over descriptions and associations of features."""

from __future__ import annotations

from gridloom.functions.nulls import NAN_STRINGS, null_profile
from gridloom.operators import associate as A
from gridloom.operators import describe as D
from gridloom.plans.common import long_sql, rounded, rounded_sql, table
from gridloom.plans.oracles import information_class, information_numbers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PREP_NUM = ["a2", "a3", "a11", "a14", "a15"]
PREP_CAT = ["a1", "a4", "a5", "a7", "a8"]

QUERIES = {
    "null_profile": lambda s, d: rounded(null_profile(table(s, d, "prep_rows"), [*PREP_NUM, *PREP_CAT, "g_raw", "target"])),
    "describe_moments": lambda s, d: rounded(D.moments(table(s, d, "prep_rows"), PREP_NUM), 5),
    "describe_percentiles": lambda s, d: rounded(D.percentile_table(table(s, d, "prep_rows"), PREP_NUM)),
    "describe_percentiles_compat": lambda s, d: rounded(D.percentile_table(table(s, d, "prep_rows"), PREP_NUM, True)),
    "describe_entropy": lambda s, d: rounded(D.differential_entropy(table(s, d, "prep_rows"), PREP_NUM), 5),
    "describe_categorical": lambda s, d: rounded(D.describe_categorical(table(s, d, "prep_rows"), PREP_CAT).drop("heterog_p"), 5),
    "describe_continuous": lambda s, d: D.describe_continuous(table(s, d, "lineitem"), LINE),
    "inflation": lambda s, d: rounded(D.inflation(table(s, d, "part"), ["p_brand", "p_type", "p_size"])),
    "big_categories": lambda s, d: D.big_categories(table(s, d, "events"), ["event_type", "props"]),
    "assoc_moments": lambda s, d: rounded(A.cont_class_moments(table(s, d, "lineitem"), LINE, "l_returnflag"), 5),
    "assoc_ranks": lambda s, d: rounded(A.cont_class_ranks(table(s, d, "lineitem"), LINE, "l_returnflag"), 5),
    "assoc_cont_class": lambda s, d: A.cont_class(table(s, d, "lineitem"), LINE, "l_returnflag"),
    "assoc_pearson": lambda s, d: rounded(A.pearson(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 5),
    "assoc_spearman": lambda s, d: rounded(A.spearman(table(s, d, "prep_rows"), ["a2", "a3", "a11", "a14"], "a15")),
    "assoc_cont_cont": lambda s, d: A.cont_cont(table(s, d, "prep_rows"), ["a2", "a3", "a11", "a14"], "a15"),
    "assoc_kruskal": lambda s, d: rounded(A.kruskal(table(s, d, "prep_rows"), PREP_CAT, "a15").select("feature", "H"), 5),
    "assoc_cat_class": lambda s, d: rounded(A.cat_class(table(s, d, "orders"), ["o_orderpriority"], "o_orderstatus").drop("H_p")),
    "relative_entropy": lambda s, d: rounded(A.relative_entropy(table(s, d, "prep_rows").where("ix_train IS NOT NULL"), table(s, d, "prep_rows").where("ix_tests IS NOT NULL"), "target")),
    "mutual_info_class": lambda s, d: rounded(A.mutual_info(table(s, d, "prep_rows"), "row_id", PREP_NUM, "target", True)),
    "mutual_info_reg": lambda s, d: rounded(A.mutual_info(table(s, d, "prep_rows"), "row_id", PREP_NUM[:-1], "a15", False)),
}

_NANS = ", ".join(f"'{x}'" for x in NAN_STRINGS)
_PREP = long_sql("prep_rows", PREP_NUM)


def _quantiles(scale: int) -> str:
    q = ", ".join(f"quantile_cont(x, {v / scale!r}) AS {n}" for n, v in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)))
    return f"SELECT feature, {q}, quantile_cont(x, {0.75 / scale!r}) - quantile_cont(x, {0.25 / scale!r}) AS iqr FROM ({_PREP}) WHERE x IS NOT NULL GROUP BY feature"


_LEVELS = f"SELECT feature, coalesce(v, 'nan') AS level, count(*) AS c, count(*) FILTER (WHERE v IS NULL) AS nulls FROM ({long_sql('prep_rows', PREP_CAT, cast='VARCHAR', value='v')}) GROUP BY 1, 2"
_CC = f"""WITH l AS ({long_sql('lineitem', LINE, keep='l_returnflag AS y')}), lv AS (SELECT DISTINCT y AS level FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS c,
      rank() OVER (PARTITION BY feature, y ORDER BY x) + (count(*) OVER (PARTITION BY feature, y, x) - 1) / 2.0 AS w1, count(*) OVER (PARTITION BY feature, x) AS t FROM l)"""

ORACLE = {
    "null_profile": rounded_sql(
        "SELECT feature, count(*) AS n, count(*) FILTER (WHERE miss) AS n_null, avg(miss::INT) AS nan_freq FROM ("
        + " UNION ALL ".join(
            [f"SELECT '{c}' AS feature, {c} IS NULL OR isnan({c}) AS miss FROM prep_rows" for c in PREP_NUM]
            + [f"SELECT '{c}', {c} IS NULL OR {c} IN ({_NANS}) FROM prep_rows" for c in [*PREP_CAT, "g_raw", "target"]]
        )
        + ") GROUP BY feature",
        ["nan_freq"],
    ),
    "describe_moments": rounded_sql(
        f"""WITH l AS ({_PREP}), m AS (SELECT feature, avg(x) AS mu, var_pop(x) AS v FROM l GROUP BY feature)
SELECT l.feature, count(x) AS n, avg((x IS NULL)::INT) AS nan_freq, min(x) AS min, avg(x) AS mean, max(x) AS max, stddev_samp(x) AS sd,
       avg(pow(x - mu, 3)) / pow(any_value(v), 1.5) AS skew, avg(pow(x - mu, 4)) / pow(any_value(v), 2) - 3 AS kurt
FROM l JOIN m USING (feature) GROUP BY l.feature""",
        ["nan_freq", "min", "mean", "max", "sd", "skew", "kurt"], 5,
    ),
    "describe_percentiles": rounded_sql(_quantiles(1), ["p05", "median", "p95", "iqr"]),
    "describe_percentiles_compat": rounded_sql(_quantiles(100), ["p05", "median", "p95", "iqr"]),
    "describe_entropy": rounded_sql(
        f"""WITH l AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS i, count(*) OVER (PARTITION BY feature) AS n FROM ({_PREP}) WHERE x IS NOT NULL),
m AS (SELECT *, CAST(floor(sqrt(n) + 0.5) AS BIGINT) AS m FROM l),
g AS (SELECT a.feature, a.i, a.n, a.m, h.x - w.x AS gap FROM m a JOIN l h ON h.feature = a.feature AND h.i = least(a.i + a.m, a.n) JOIN l w ON w.feature = a.feature AND w.i = greatest(a.i - a.m, 1))
SELECT feature, avg(CASE WHEN gap > 0 THEN CASE WHEN n > 1000 THEN ln(n / (2.0 * m) * gap)
  ELSE ln(n / (m * CASE WHEN i <= m THEN 1 + (i - 1.0) / m WHEN i >= n - m + 1 THEN 1 + (n - i) * 1.0 / m ELSE 2.0 END) * gap) END ELSE CAST('-inf' AS DOUBLE) END) AS entropy FROM g GROUP BY feature""",
        ["entropy"], 5,
    ),
    "describe_categorical": rounded_sql(
        f"""WITH c AS ({_LEVELS}), t AS (SELECT *, sum(c) OVER w AS total, count(*) OVER w AS k, sum(nulls) OVER w AS nn FROM c WINDOW w AS (PARTITION BY feature))
SELECT feature, any_value(k) AS n_levels, CAST(any_value(nn) AS BIGINT) AS nans, any_value(nn / total) AS nan_freq, quantile_cont(c / total, 0.5) AS med_freq, min(c / total) AS min_freq, max(c / total) AS max_freq,
  arg_min(level, {{'a': c, 'b': level}}) AS min_name, arg_min(level, {{'a': -c, 'b': level}}) AS max_name,
  any_value(total) * sum(pow(c / total - 1.0 / k, 2) * k) AS heterog, sum(pow(c / total - 1.0 / k, 2) * k) AS heterog_freq,
  -sum(c / total * ln(c / total)) / ln(any_value(k)) AS n_entropy FROM t GROUP BY feature""",
        ["nan_freq", "med_freq", "min_freq", "max_freq", "heterog", "heterog_freq", "n_entropy"], 5,
    ),
    "mutual_info_class": rounded_sql(information_class(f"SELECT * FROM ({long_sql('prep_rows', PREP_NUM, keep='target AS y')}) WHERE x IS NOT NULL AND y IS NOT NULL"), ["mut_info"]),
    "mutual_info_reg": rounded_sql(information_numbers(PREP_NUM[:-1], "a15"), ["mut_info"]),
    "inflation": rounded_sql(
        f"SELECT feature, avg((c < 20)::INT) AS inflation, count(*) AS n_levels FROM (SELECT feature, v, count(*) AS c FROM ({long_sql('part', ['p_brand', 'p_type', 'p_size'], cast='VARCHAR', value='v')}) WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY feature",
        ["inflation"],
    ),
    "big_categories": f"""SELECT feature, v AS level, count(*) AS count, CAST(count(*) < 20 AS INT) AS deflate, count(*) OVER (PARTITION BY feature) AS n_levels,
CAST(count(*) OVER (PARTITION BY feature) >= 20 AS INT) AS big FROM ({long_sql('events', ['event_type', 'props'], cast='VARCHAR', value='v')}) WHERE v IS NOT NULL GROUP BY feature, v""",
    "assoc_moments": rounded_sql(
        f"""{_CC}, g AS (SELECT feature, level, count(*) FILTER (WHERE y <> level) AS n0, count(*) FILTER (WHERE y = level) AS n1, avg(x) FILTER (WHERE y <> level) AS m0, avg(x) FILTER (WHERE y = level) AS m1,
  var_samp(x) FILTER (WHERE y <> level) AS s0, var_samp(x) FILTER (WHERE y = level) AS s1, corr(x, (y = level)::INT) AS corr FROM l, lv GROUP BY feature, level)
SELECT feature, level, n0, n1, (m0 - m1) / sqrt(s0 / n0 + s1 / n1) AS t, pow(s0 / n0 + s1 / n1, 2) / (pow(s0 / n0, 2) / (n0 - 1) + pow(s1 / n1, 2) / (n1 - 1)) AS t_df,
  (m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2)) AS cohen_d, corr FROM g""",
        ["t", "t_df", "cohen_d", "corr"], 5,
    ),
    "assoc_ranks": rounded_sql(
        f"""{_CC}, z AS (SELECT feature, level, y, c, t, CASE WHEN y = level THEN w1 ELSE rank() OVER (PARTITION BY feature, level, y = level ORDER BY x) + (count(*) OVER (PARTITION BY feature, level, y = level, x) - 1) / 2.0 END AS w FROM r, lv),
g AS (SELECT feature, level, count(*) FILTER (WHERE y <> level) * 1.0 AS n0, count(*) FILTER (WHERE y = level) * 1.0 AS n1, sum(c) FILTER (WHERE y <> level) AS R0, sum(c) FILTER (WHERE y = level) AS R1,
  sum(t * t - 1.0) AS ties, var_samp(c - w) FILTER (WHERE y <> level) AS S0, var_samp(c - w) FILTER (WHERE y = level) AS S1 FROM z GROUP BY feature, level),
u AS (SELECT *, R0 - n0 * (n0 + 1) / 2 AS u0, n0 + n1 AS n FROM g)
SELECT feature, level, u0 AS U, (greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1)))) AS U_z,
  n0 * n1 * (R1 / n1 - R0 / n0) / (n * sqrt(n0 * S0 + n1 * S1)) AS W, 0.5 + abs(0.5 - (R1 - n1 * (n1 + 1) / 2) / (n0 * n1)) AS AUROC FROM u""",
        ["U", "U_z", "W", "AUROC"], 5,
    ),
    "assoc_pearson": rounded_sql(
        f"SELECT feature, count(*) AS n, corr(x, y) AS pearson_r, pow(corr(x, y), 2) / (1 - pow(corr(x, y), 2)) * (count(*) - 2) AS F FROM ({long_sql('lineitem', ['l_quantity', 'l_discount', 'l_tax'], keep='l_extendedprice AS y')}) GROUP BY feature",
        ["pearson_r", "F"], 5,
    ),
    "assoc_spearman": rounded_sql(
        f"""WITH l AS (SELECT * FROM ({long_sql('prep_rows', ['a2', 'a3', 'a11', 'a14'], keep='a15 AS y')}) WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT feature, corr(rx, ry) AS spearman_r FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l) GROUP BY feature""",
        ["spearman_r"],
    ),
    "assoc_kruskal": rounded_sql(
        f"""WITH l AS (SELECT feature, coalesce(v, 'nan') AS level, y FROM ({long_sql('prep_rows', PREP_CAT, keep='a15 AS y', cast='VARCHAR', value='v')}) WHERE y IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS t, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS r FROM l),
n AS (SELECT feature, count(*) * 1.0 AS N, sum(t * t - 1.0) AS T FROM r GROUP BY feature), g AS (SELECT feature, level, sum(r) AS R, count(*) AS k FROM r GROUP BY 1, 2)
SELECT feature, (12 / (any_value(N) * (any_value(N) + 1)) * sum(R * R / k) - 3 * (any_value(N) + 1)) / (1 - any_value(T) / (pow(any_value(N), 3) - any_value(N))) AS H FROM g JOIN n USING (feature) GROUP BY feature""",
        ["H"], 5,
    ),
    "assoc_cat_class": rounded_sql(
        """WITH p AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS a, o_orderstatus AS b FROM orders), lv AS (SELECT DISTINCT b AS level FROM p),
e AS (SELECT feature, level, a, CAST(b = level AS VARCHAR) AS b FROM p, lv UNION ALL SELECT feature, NULL, a, b FROM p),
o AS (SELECT feature, level, a, b, count(*) * 1.0 AS o FROM e GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY feature, level, a) AS ra, sum(o) OVER (PARTITION BY feature, level, b) AS cb, sum(o) OVER (PARTITION BY feature, level) AS n FROM o),
c AS (SELECT feature, level, sqrt((sum(o * o / (ra * cb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS cramer_v, sum(o / n * ln(o * n / (ra * cb))) AS mut_info FROM m GROUP BY feature, level),
k AS (SELECT *, rank() OVER (PARTITION BY feature, level ORDER BY b) + (count(*) OVER (PARTITION BY feature, level, b) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, level, b) AS t FROM e WHERE level IS NOT NULL),
n AS (SELECT feature, level, count(*) * 1.0 AS N, sum(t * (t * 1.0 * t - 1) / t) AS T FROM k GROUP BY 1, 2), g AS (SELECT feature, level, a, sum(r) AS R, count(*) AS q FROM k GROUP BY 1, 2, 3),
h AS (SELECT feature, level, (12 / (any_value(N) * (any_value(N) + 1)) * sum(R * R / q) - 3 * (any_value(N) + 1)) / (1 - any_value(T) / (pow(any_value(N), 3) - any_value(N))) AS H FROM g JOIN n USING (feature, level) GROUP BY feature, level)
SELECT c.feature, c.level, cramer_v, mut_info, H FROM c LEFT JOIN h ON h.feature = c.feature AND h.level = c.level""",
        ["cramer_v", "mut_info", "H"],
    ),
    "relative_entropy": rounded_sql(
        """WITH a AS (SELECT target, count(*) / sum(count(*)) OVER () AS p FROM prep_rows WHERE ix_train IS NOT NULL AND target IS NOT NULL GROUP BY target),
b AS (SELECT target, count(*) / sum(count(*)) OVER () AS q FROM prep_rows WHERE ix_tests IS NOT NULL AND target IS NOT NULL GROUP BY target)
SELECT sum(CASE WHEN q IS NULL THEN CAST('inf' AS DOUBLE) ELSE p * log2(p / q) END) AS kl FROM a LEFT JOIN b USING (target)""",
        ["kl"],
    ),
}
