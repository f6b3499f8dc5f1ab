"""DuckDB SQL of queries whose statement takes more than an expression: inference, preparation, nearest-neighbour information, fitted bins, risk control."""

from __future__ import annotations

from collections.abc import Sequence

from gridloom.functions.labels import missing_sql, plain_sql
from gridloom.functions.nulls import NAN_STRINGS
from gridloom.operators.inspect import CATEGORY_VERBS, CATEGORY_WORDS, SCALE_ENDS, VERB_MARKS
from gridloom.plans.common import long_sql, rounded_sql

NUM = ["a2", "a3", "a11", "a14", "a15"]
CAT = ["a1", "a4", "a5", "a7", "a8"]
_NANS = ", ".join(f"'{x}'" for x in NAN_STRINGS)
_TIMES = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%Y-%m-%dT%H:%M:%S", "%d-%m-%Y", "%H:%M:%S", "%H:%M", "%d %b %Y", "%b %d, %Y")


def profile_sql(columns: Sequence[str]) -> str:
    return f"""WITH u AS (SELECT feature, CASE WHEN v NOT IN ({_NANS}) THEN v END AS v FROM ({long_sql('prep_rows', columns, cast='VARCHAR', value='v')})),
c AS (SELECT feature, v, count(*) AS c, regexp_full_match(v, '-?[0-9]+') AS is_int, try_cast(v AS DOUBLE) IS NOT NULL AS is_float, contains(v, '.') AS has_dot FROM u GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN is_int THEN try_cast(v AS BIGINT) END AS i, NOT is_float AND regexp_matches(v, '[0-9]') AND try_strptime(v, {list(_TIMES)}) IS NOT NULL AS is_time FROM c),
d AS (SELECT *, nullif(i - lag(i) OVER (PARTITION BY feature ORDER BY i NULLS FIRST, v), 0) AS d FROM f)
SELECT feature, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS n_null, count(v) AS n_distinct, max(c) FILTER (WHERE v IS NOT NULL) AS max_count,
  CAST(coalesce(sum(c) FILTER (WHERE is_int), 0) AS BIGINT) AS n_int, CAST(coalesce(sum(c) FILTER (WHERE v IS NOT NULL AND is_float), 0) AS BIGINT) AS n_float,
  CAST(coalesce(sum(c) FILTER (WHERE is_time), 0) AS BIGINT) AS n_time, CAST(coalesce(sum(c) FILTER (WHERE has_dot), 0) AS BIGINT) AS n_dot,
  count(*) FILTER (WHERE v IS NOT NULL AND c < 20) AS n_small, min(i) AS int_min, max(i) AS int_max, nullif(count(d), 0) AS n_gaps,
  CASE WHEN count(d) > 0 THEN count(*) FILTER (WHERE d = 1) END AS n_unit_gaps, min(d) AS gap_min, max(d) AS gap_max FROM d GROUP BY feature"""


_NAMED = " OR ".join([f"contains(lower(feature), '{w}')" for w in CATEGORY_WORDS] + [f"contains(lower(feature), '{v}{m}')" for v in CATEGORY_VERBS for m in VERB_MARKS])


def infer_sql(columns: Sequence[str], times: Sequence[str]) -> str:
    """The rules of inference in their order, as one CASE over the profile."""
    return f"""WITH p AS (SELECT *, n - n_null AS present, n_distinct + (n_null > 0)::INT AS levels, int_max - int_min + 1 AS span FROM ({profile_sql(columns)})),
q AS (SELECT *, n_int = present AS all_int, n_float = present AS all_float, n_float = present AND n_int <> present AS real FROM p),
o AS (SELECT *, CASE WHEN n_int = 0 OR n_int < present THEN NULL WHEN n_distinct = 1 THEN 'CertainOrd:one whole number' WHEN int_min NOT IN (0, 1) THEN 'CertainOrd:whole numbers that don''t start at 0 or 1'
  WHEN n_distinct = present AND present <= span AND present < 200000 AND exp(coalesce(list_sum(list_transform(range(1, present - 1), lambda x: ln(1 - x / span))), 0)) >= 0.5 THEN 'MaybeOrd:all different, as draws from so wide a range would be'
  WHEN gap_min = gap_max THEN CASE WHEN int_max = 1 THEN 'CertainOrd:0 and 1 only' ELSE 'MaybeOrd:evenly spaced' END WHEN n_unit_gaps / n_gaps >= 0.8 THEN 'MaybeOrd:mostly consecutive'
  WHEN n_distinct / span >= 0.8 THEN 'MaybeOrd:most of the range occurs' WHEN int_max IN {SCALE_ENDS} THEN 'MaybeOrd:ends like a common scale' END AS o FROM q),
k AS (SELECT feature, CASE WHEN levels <= 1 THEN 'Const:a single value' WHEN feature IN ({', '.join(f"'{t}'" for t in times)}) THEN 'CertainTime:stored as a time'
  WHEN NOT all_float AND n_time = present THEN 'CertainTime:every value reads as a time' WHEN NOT all_float AND n_time / present > 0.5 THEN 'CertainTime:most values read as times'
  WHEN NOT real AND present >= n / 2 AND max_count = 1 THEN 'CertainId:no value occurs twice'
  WHEN levels = 2 THEN CASE WHEN n_null > 0 THEN 'BinaryViaNan:one value and missing' ELSE 'Binary:two values' END WHEN levels = 3 AND n_null > 0 THEN 'BinaryPlusNan:two values and missing'
  WHEN real THEN 'CertainCont:numbers with fractions' WHEN NOT all_float AND n_time / present > 0.3 THEN 'MaybeTime:many values read as times'
  WHEN present >= n / 2 AND n_distinct >= present / 2 AND NOT all_int THEN 'MaybeId:most values occur once'
  WHEN o LIKE 'CertainOrd%' THEN o WHEN NOT all_int AND NOT all_float THEN 'CertainCat:not numbers' WHEN o IS NULL THEN 'MaybeCat:few whole numbers may be names'
  WHEN ({_NAMED}) AND n_small = 0 THEN 'CoercedCat:unclear, named like a category without rare levels' ELSE 'CoercedOrd:unclear whole numbers' END AS k FROM o)
SELECT feature AS feature_name, CAST(NULL AS VARCHAR) AS "user", split_part(k, ':', 1) AS inferred, substr(k, instr(k, ':') + 1) AS reason FROM k"""


def prepare_sql() -> str:
    """Prepared features as (row, feature, value): imputed numbers, indicators, encoded levels."""
    plain = ", ".join(f"CASE WHEN NOT {missing_sql(c)} THEN {plain_sql(c)} END AS {c}" for c in (*CAT, "target"))
    parts = [f"SELECT row_id, target, '{c}' AS feature, coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM r)) AS x FROM r" for c in NUM]
    parts += [f"SELECT row_id, target, '{c}_NAN', CAST({c} IS NULL AS DOUBLE) FROM r WHERE (SELECT count(*) - count({c}) FROM r) > 0" for c in NUM]
    with_ = ""
    for c in CAT:
        with_ += f""", d_{c} AS (SELECT row_id, target, CASE WHEN {c} IS NULL OR count(*) OVER (PARTITION BY {c}) >= 20 THEN {c} ELSE 'DEFLATED' END AS v FROM r),
l_{c} AS (SELECT v, row_number() OVER (ORDER BY v NULLS LAST) AS i, count(v) OVER () AS k FROM (SELECT DISTINCT v FROM d_{c}))"""
        parts.append(f"SELECT row_id, target, '{c}_' || coalesce(l.v, 'nan'), CAST(d.v IS NOT DISTINCT FROM l.v AS DOUBLE) FROM d_{c} d, l_{c} l WHERE NOT (k = 2 AND i = 1)")
    return rounded_sql(
        f"""WITH p AS (SELECT row_id, {', '.join(NUM)}, {plain} FROM prep_rows), k AS (SELECT target, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS code FROM p WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 20),
r AS (SELECT p.* REPLACE (code AS target) FROM p JOIN k ON p.target = k.target){with_} {' UNION ALL '.join(parts)}""", ["x"])  # fmt: skip


def psi(n: str) -> str:
    """The digamma function by its asymptotic series after six steps up."""
    up = f"({n} + 6.0)"
    return f"(ln({up}) - 0.5 / {up} - 1 / (12 * pow({up}, 2)) + 1 / (120 * pow({up}, 4)) - 1 / (252 * pow({up}, 6)) - {' - '.join(f'1.0 / ({n} + {i}.0)' for i in range(6))})"


def information_class(rows: str) -> str:
    """Nearest-neighbour information of ``rows`` (feature, y, x), the neighbours found row by row."""
    gaps = ", ".join([f"x - lag(x, {j}) OVER w, lead(x, {j}) OVER w - x" for j in (1, 2, 3)])
    return f"""SELECT feature, greatest(0.0, {psi('any_value(n)')} + sum(t) / any_value(n)) AS mut_info FROM (
  SELECT a.feature, any_value(a.n) AS n, {psi('any_value(kk)')} - {psi('any_value(a.size)')} - {psi('greatest(count(*), 1)')} AS t
  FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS n, row_number() OVER () AS i, nextafter(list_sort(list_filter(gaps, lambda z: z IS NOT NULL))[kk], 0.0::DOUBLE) AS radius
        FROM (SELECT *, least(3, size - 1) AS kk, [{gaps}] AS gaps FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size FROM ({rows})) WHERE size > 1 WINDOW w AS (PARTITION BY feature, y ORDER BY x))) a
  JOIN (SELECT * FROM (SELECT feature, x, count(*) OVER (PARTITION BY feature, y) AS size FROM ({rows})) WHERE size > 1) b ON a.feature = b.feature AND abs(b.x - a.x) <= a.radius GROUP BY a.feature, a.i) GROUP BY feature"""


def information_numbers(columns: Sequence[str], target: str) -> str:
    return f"""WITH l AS (SELECT * FROM ({long_sql('prep_rows', columns, keep=f'row_id, {target} AS y')}) WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT feature, count(*) AS n, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sx, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS sy FROM l GROUP BY feature),
r AS (SELECT l.feature, row_id, x, y, n, sx, sy FROM l JOIN s ON l.feature = s.feature),
d AS (SELECT a.feature, a.row_id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.sx) AS sx, any_value(a.sy) AS sy, any_value(a.n) AS n, nextafter(min(greatest(abs(a.x - b.x) / a.sx, abs(a.y - b.y) / a.sy), 3)[3], 0.0::DOUBLE) AS d
  FROM r a JOIN r b ON a.feature = b.feature AND a.row_id <> b.row_id GROUP BY 1, 2),
m AS (SELECT d.feature, d.row_id, any_value(d.n) AS n, count(*) FILTER (WHERE abs(b.x - d.x) / d.sx <= d) AS mx, count(*) FILTER (WHERE abs(b.y - d.y) / d.sy <= d) AS my FROM d JOIN r b ON d.feature = b.feature GROUP BY 1, 2)
SELECT feature, greatest(0.0, {psi('any_value(n)')} + {psi('3')} - sum({psi('mx')} + {psi('my')}) / any_value(n)) AS mut_info FROM m GROUP BY feature"""


def associations_sql() -> str:
    """The largest information of each feature over the levels and all classes, then the strongest three and two."""
    rows = f"SELECT * FROM ({long_sql('prep_rows', NUM, keep='target AS y')}) WHERE x IS NOT NULL AND y IS NOT NULL"
    every = f"SELECT feature || chr(1) AS feature, y, x FROM ({rows}) UNION ALL SELECT feature || chr(1) || level, CAST(y = level AS VARCHAR), x FROM ({rows}), (SELECT DISTINCT target AS level FROM prep_rows WHERE target IS NOT NULL)"
    return f"""WITH every AS (SELECT * FROM ({every})), cont AS (SELECT split_part(feature, chr(1), 1) AS feature, 'cont' AS kind, max(mut_info) AS score FROM ({information_class('SELECT * FROM every')}) GROUP BY 1),
l AS (SELECT feature, coalesce(v, 'nan') AS a, y AS b FROM ({long_sql('prep_rows', CAT, keep='target AS y', cast='VARCHAR', value='v')}) WHERE y IS NOT NULL), lv AS (SELECT DISTINCT b AS level FROM l),
e AS (SELECT feature, level, a, CAST(b = level AS VARCHAR) AS b FROM l, lv UNION ALL SELECT feature, NULL, a, b FROM l), o AS (SELECT feature, level, a, b, count(*) * 1.0 AS o FROM e GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY feature, level, a) AS ra, sum(o) OVER (PARTITION BY feature, level, b) AS cb, sum(o) OVER (PARTITION BY feature, level) AS n FROM o),
cat AS (SELECT feature, 'cat' AS kind, max(s) AS score FROM (SELECT feature, level, greatest(0.0, sum(o / n * ln(o * n / (ra * cb)))) AS s FROM m GROUP BY 1, 2) GROUP BY feature),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, feature) AS INT) AS rank FROM (SELECT * FROM cont UNION ALL SELECT * FROM cat))
SELECT feature, kind, score, rank FROM z WHERE rank <= CASE WHEN kind = 'cont' THEN 3 ELSE 2 END"""


EDGE = "CAST(greatest(0, least({b} - 1, CASE WHEN {x} < floor({x} * {b}) * (1.0::DOUBLE / {b}) THEN floor({x} * {b}) - 1 WHEN {x} >= (floor({x} * {b}) + 1) * (1.0::DOUBLE / {b}) THEN floor({x} * {b}) + 1 ELSE floor({x} * {b}) END)) AS INT)"


def fit_sql(rows: str, least: int = 10, smooth: bool = True, monotonic: bool = False, adaptive: bool = False) -> str:
    """CTEs up to ``fit``: the fitted bins of each source of ``rows`` (source, c in [0, 1], wrong). Bins are merged by a recursion over their rows."""
    uniform = "CASE WHEN sd < 0.05 OR n < 100 THEN least(5, q) WHEN n < 500 THEN least(10, q) WHEN n < 1000 THEN least(15, q) ELSE q END"
    levels = ", ".join(repr(i / 20) for i in range(1, 20))
    inn = "CASE WHEN b > 1 THEN list_sort(list_distinct(list_filter(qs, lambda z: z > 0 AND z < 1))) ELSE [] END" if adaptive else "list_transform(range(1, b), lambda z: z / b::DOUBLE)"
    at = "CAST(len(list_filter(b.inn, lambda z: z <= v.c)) AS INT)" if adaptive else EDGE.format(x="v.c", b="b.b")
    left = "coalesce(any_value(b.edges)[min(f.i) + 1], 0)" if adaptive else "min(f.i) * (1.0::DOUBLE / any_value(b.b))"
    right = "any_value(b.edges)[max(f.i) + 2]" if adaptive else "CASE WHEN max(f.i) = any_value(b.b) - 1 THEN 1.0 ELSE (max(f.i) + 1) * (1.0::DOUBLE / any_value(b.b)) END"
    sm = "CASE WHEN count(*) OVER p >= 3 THEN sum(n * e1) OVER s / sum(n) OVER s ELSE e1 END" if smooth else "e1"
    mono = "(SELECT min(top) FROM (SELECT max(av) AS top FROM (SELECT a.bin AS lo, c.bin AS hi, (SELECT sum(x.n * x.e2) / sum(x.n) FROM s2 x WHERE x.source = z.source AND x.bin BETWEEN a.bin AND c.bin) AS av FROM s2 a, s2 c WHERE a.source = z.source AND c.source = z.source AND a.bin <= z.bin AND c.bin >= z.bin) GROUP BY lo))" if monotonic else "e2"
    return f"""v AS ({rows}), st AS (SELECT source, count(*) AS n, sum(wrong) AS e, stddev_pop(c) AS sd, max(c) - min(c) AS span, quantile_cont(c, [{levels}]) AS qs FROM v GROUP BY source),
b0 AS (SELECT *, greatest(1, least(20, n // {least})) AS q FROM st), b1 AS (SELECT source, n, e, qs, CAST(CASE WHEN span < 1e-6 THEN 1 ELSE {'q' if adaptive else uniform} END AS INT) AS b FROM b0),
b2 AS (SELECT *, {inn} AS inn FROM b1), b AS (SELECT *, len(inn) + 1 AS k, list_concat(list_concat([0.0::DOUBLE], inn), [1.0::DOUBLE]) AS edges FROM b2),
p AS (SELECT v.source, {at} AS i, count(*) AS c, sum(wrong) AS w FROM v JOIN b ON v.source = b.source GROUP BY 1, 2),
f AS (SELECT b.source, i.i, coalesce(c, 0) AS c, coalesce(w, 0) AS w FROM b, LATERAL (SELECT unnest(range(b.k)) AS i) i LEFT JOIN p ON p.source = b.source AND p.i = i.i),
rec AS (SELECT source, i, c AS acc, 0 AS grp, c >= {least} AS done FROM f WHERE i = 0 UNION ALL
  SELECT f.source, f.i, CASE WHEN r.done THEN f.c ELSE r.acc + f.c END, CASE WHEN r.done THEN r.grp + 1 ELSE r.grp END, CASE WHEN r.done THEN f.c ELSE r.acc + f.c END >= {least} FROM rec r JOIN f ON f.source = r.source AND f.i = r.i + 1),
l AS (SELECT source, max(grp) FILTER (WHERE done) AS last FROM rec GROUP BY source),
m AS (SELECT f.source, least(grp, coalesce(last, 0)) AS bin, {left} AS bin_left, {right} AS bin_right, sum(c) AS n, sum(w) AS e FROM rec JOIN f ON f.source = rec.source AND f.i = rec.i JOIN l ON l.source = f.source JOIN b ON b.source = f.source GROUP BY 1, 2),
s1 AS (SELECT m.source, CAST(bin AS INT) AS bin, bin_left, bin_right, m.n, m.e, CASE WHEN m.n > 0 THEN (m.e + 2.0 * least(greatest(b.e / b.n, 1e-6), 1 - 1e-6)) / (m.n + 2.0) ELSE b.e / b.n END AS e1 FROM m JOIN b ON b.source = m.source),
s2 AS (SELECT *, {sm} AS e2 FROM s1 WINDOW p AS (PARTITION BY source), s AS (PARTITION BY source ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
fit AS (SELECT source, bin, bin_left, bin_right, n, e, greatest(0.0, least(1.0, {mono})) AS expected_error FROM s2 z)"""


BIN_COLUMNS = ["bin_left", "bin_right", "bin_center", "raw_error", "expected_error", "wilson_low", "wilson_high"]


def bins_sql(samples: str, rows: str, wilson: str, **options) -> str:
    return rounded_sql(
        f"WITH RECURSIVE {samples}, {fit_sql(rows, **options)} SELECT source, bin, bin_left, bin_right, (bin_left + bin_right) / 2 AS bin_center, CAST(n AS BIGINT) AS count, CAST(e AS BIGINT) AS error_count, e / n AS raw_error, expected_error, {wilson} FROM fit",
        BIN_COLUMNS,
    )


#: A sample's fold of five, from its digest.
FOLD = "(CAST('0x' || substr(md5('69:' || CAST(sample_id AS VARCHAR)), 1, 8) AS BIGINT) % 5)"


def crossfit_sql(samples: str, rows: str) -> str:
    """CTEs up to ``risk`` (sample_id, source, fold, wrong, aer) of ``rows`` (sample_id, source, c, wrong): each row's expected error from the bins of the other folds."""
    train = "SELECT source || chr(1) || k AS source, c, wrong FROM own, (SELECT unnest(range(5)) AS k) WHERE k <> fold"
    return f"""WITH RECURSIVE {samples}, own AS (SELECT *, {FOLD} AS fold FROM ({rows})), {fit_sql(train)},
risk AS (SELECT sample_id, own.source, CAST(fold AS INT) AS fold, wrong, expected_error AS aer FROM own JOIN fit ON fit.source = own.source || chr(1) || fold AND c >= bin_left AND (c < bin_right OR bin_right = 1.0))"""


def risk_sql(samples: str, target: float, alpha: float = 0.05) -> str:
    """Risk control by summed binomial probabilities; the bound by halving an interval."""
    tail = lambda n, k, p: f"list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"
    return rounded_sql(
        f"""WITH RECURSIVE {samples}, g AS (SELECT source, aer, count(*) AS c, sum(wrong) AS w FROM s WHERE aer IS NOT NULL AND NOT isnan(aer) AND NOT isinf(aer) GROUP BY 1, 2),
a AS (SELECT source, aer, sum(c) OVER w AS n, sum(w) OVER w AS k, count(*) OVER (PARTITION BY source) AS m, sum(c) OVER (PARTITION BY source) AS total FROM g WINDOW w AS (PARTITION BY source ORDER BY aer)),
ok AS (SELECT * FROM a WHERE k < n AND {tail('n', 'k', target)} <= {alpha} / m), top AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source ORDER BY aer DESC) = 1),
h AS (SELECT source, n, k, m, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM top UNION ALL
  SELECT source, n, k, m, CASE WHEN {tail('n', 'k', '((lo + hi) / 2)')} > {alpha} / m THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail('n', 'k', '((lo + hi) / 2)')} > {alpha} / m THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM h WHERE step < 45),
u AS (SELECT source, lo AS upper FROM h WHERE step = 45), d AS (SELECT DISTINCT source, m, total FROM a)
SELECT d.source, aer AS t_star, CAST(n AS BIGINT) AS oof_n, CAST(k AS BIGINT) AS oof_k, k / n AS oof_error_rate, upper AS oof_cp_upper, n / top.total AS oof_coverage, d.m AS bonferroni_m, CASE WHEN n IS NULL THEN 'none' ELSE 'ok' END AS status
FROM d LEFT JOIN top ON top.source = d.source LEFT JOIN u ON u.source = d.source""",
        ["t_star", "oof_error_rate", "oof_cp_upper", "oof_coverage"],
    )
