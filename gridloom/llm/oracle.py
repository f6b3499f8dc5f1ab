"""DuckDB SQL for those queries of this subpackage that SQL can state."""

from __future__ import annotations

from gridloom.functions.labels import missing_sql, plain_sql
from gridloom.llm.queries import NUMBERS, WORDS

_BEST = f"""
SELECT study, model, feat_select, auc, auc_sd, result_id,
       CAST(row_number() OVER (PARTITION BY study, model, feat_select ORDER BY auc DESC, auc_sd ASC NULLS LAST, result_id) AS INTEGER) AS rank
FROM (SELECT DISTINCT result_id, study, {plain_sql('model')} AS model, {plain_sql('feat_select')} AS feat_select, auc, auc_sd
      FROM tuning_results WHERE auc >= 0 AND auc <= 1)
QUALIFY rank <= (SELECT amount FROM run_settings WHERE setting = 'top_n')"""

_LEVELS = "list_concat(coalesce(to_deflate, []), coalesce(to_keep, []))"
_TERMS = f"""
WITH d AS (SELECT info_id, any_value({_LEVELS}) AS levels FROM inflation_info GROUP BY info_id),
e AS (SELECT info_id, {plain_sql('x')} AS term FROM (SELECT info_id, unnest(levels) AS x FROM d)),
n AS (SELECT count(*) AS n_records FROM d),
t AS (SELECT term, count(*) AS occurrences, count(DISTINCT info_id) AS records FROM e WHERE term <> '' GROUP BY term)
SELECT term, occurrences, records, n_records,
       records < (SELECT amount FROM run_settings WHERE setting = 'rare_below_records') AS rare,
       records > n_records * (SELECT amount FROM run_settings WHERE setting = 'common_above_fraction') AS common
FROM t, n"""

_CUTS = f"""
WITH s AS (SELECT DISTINCT sample_id, {plain_sql('source')} AS source, confidence FROM test_samples WHERE confidence >= 0 AND confidence <= 1),
r AS (SELECT {plain_sql('source')} AS source, max(coverage) AS coverage FROM coverage_report WHERE coverage IS NOT NULL AND NOT isnan(coverage) GROUP BY 1),
q AS (SELECT source, coverage, confidence, count(*) OVER (PARTITION BY source ORDER BY confidence DESC) AS least, count(*) OVER (PARTITION BY source) AS n
      FROM s JOIN r USING (source)),
c AS (SELECT source, coverage, n, max(confidence) AS threshold FROM q WHERE least >= coverage * n GROUP BY source, coverage, n)"""


def _agree(c: str) -> str:
    if c in NUMBERS:
        return f"CASE WHEN x.{c} IS NULL OR y.{c} IS NULL THEN x.{c} IS NULL AND y.{c} IS NULL ELSE abs(x.{c} - y.{c}) <= 0.005 * greatest(abs(x.{c}), abs(y.{c})) END"
    return f"x.{c} IS NOT DISTINCT FROM y.{c}"


_FEATURES = ", ".join([*NUMBERS, *[f"CASE WHEN NOT {missing_sql(c)} THEN {plain_sql(c)} END AS {c}" for c in WORDS]])
_BARE = ", ".join((*NUMBERS, *WORDS))
_DIFFERS = " + ".join(f"(NOT ({_agree(c)}))::INT" for c in (*NUMBERS, *WORDS))
# A pair that differs in one feature at most agrees in one of these two sets of words.
_HALVES = (WORDS[:5], WORDS[5:])
_PAIRS = f"""
WITH f AS (SELECT row_id, ix_train, ix_tests, test_no, study, {_FEATURES} FROM prep_rows),
a AS (SELECT * FROM f WHERE ix_train IS NOT NULL), b AS (SELECT * FROM f WHERE ix_train IS NULL AND ix_tests IS NOT NULL),
p AS ({" UNION ".join(
    f"SELECT x.row_id AS id_a, y.row_id AS id_b, {_DIFFERS} AS n FROM a x JOIN b y ON " + " AND ".join(f"coalesce(x.{c}, '-') = coalesce(y.{c}, '-')" for c in half) + f" WHERE {_DIFFERS} <= 1"
    for half in _HALVES)})"""

_ENTITIES = f"""
WITH RECURSIVE l AS (SELECT DISTINCT {plain_sql('g_left')} AS a, {plain_sql('g_right')} AS b FROM group_links WHERE NOT {missing_sql('g_left')} AND NOT {missing_sql('g_right')}),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
rows_ AS (SELECT row_id, ix_train, ix_tests, {plain_sql('g_raw')} AS g FROM prep_rows WHERE NOT {missing_sql('g_raw')})"""

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT result_id FROM ({_BEST})",
    "p1_best": _BEST,
    "p2_found": f"{_PAIRS} SELECT least(id_a, id_b) AS row_id_a, greatest(id_a, id_b) AS row_id_b FROM p",
    "p2_overlap": f"""{_PAIRS} SELECT test_no, study, count(*) AS n_pairs, count(*) FILTER (WHERE n = 0) AS n_exact, count(DISTINCT id_b) AS n_test_rows
FROM p JOIN b ON id_b = row_id GROUP BY test_no, study""",
    "p2_classes": f"""{_PAIRS}, u AS (SELECT row_id, 'train' AS split, {_BARE} FROM a UNION ALL SELECT row_id, 'test', {_BARE} FROM b),
k AS (SELECT row_id, min(row_id) OVER w AS class_id, count(*) OVER w AS n_rows, split FROM u WINDOW w AS (PARTITION BY split, {_BARE})),
l AS (SELECT 'train' AS split, id_a AS row_id, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'test', id_b, count(*) FROM p GROUP BY ALL)
SELECT row_id, split, class_id, n_rows, coalesce(n, 0) AS n_links FROM k LEFT JOIN l USING (row_id, split)""",
    "p3_found": f"SELECT term, 'rare' AS mark FROM ({_TERMS}) WHERE rare UNION ALL SELECT term, 'common' FROM ({_TERMS}) WHERE common",
    "p3_terms": _TERMS,
    "p3_totals": f"""
SELECT info_id, CAST(any_value(n_total) AS BIGINT) AS n_total,
       CAST(any_value(len(list_distinct(list_filter(list_transform({_LEVELS}, lambda x: {plain_sql('x')}), lambda y: y <> '')))) AS BIGINT) AS n_levels,
       CAST(coalesce(any_value(n_total) = n_levels, false) AS INTEGER) AS holds
FROM inflation_info WHERE info_id IS NOT NULL GROUP BY info_id""",
    "p4_found": f"{_CUTS} SELECT source, sample_id FROM s JOIN c USING (source) WHERE confidence >= threshold",
    "p4_cutoffs": f"{_CUTS} SELECT source, c.coverage, n, threshold, count(*) FILTER (WHERE confidence >= threshold) AS n_accepted FROM s JOIN c USING (source) GROUP BY source, c.coverage, n, threshold",
    "p5_summary": f"""{_ENTITIES}, sizes AS (SELECT coalesce('g:' || root, 'g:' || g) AS entity, count(*) AS n FROM rows_ LEFT JOIN roots ON g = node GROUP BY 1
  UNION ALL SELECT 'r:' || row_id, 1 FROM prep_rows WHERE {missing_sql('g_raw')})
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_entities, CAST(0 AS BIGINT) AS n_torn, 1 AS shares_hold FROM sizes""",
    "p5_found": f"""{_ENTITIES} SELECT min(row_id) AS first_row_id FROM rows_ LEFT JOIN roots ON g = node GROUP BY coalesce(root, g)
HAVING count(ix_train) > 0 AND count(ix_tests) > 0""",
}
