"""The registered queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.labels import plain, plain_or_null
from gridloom.llm.cutoff import fraction_cutoffs, sized_broadcast
from gridloom.llm.overlap import Overlap, near_classes
from gridloom.llm.packing import pack_texts
from gridloom.llm.pii import KINDS, find_pii, redact
from gridloom.llm.splits import entities, grouped_splits, spanning_forest
from gridloom.llm.termfreq import marked_terms, record_terms
from gridloom.llm.tokenizer import encode_corpus
from gridloom.llm.topn import top_n_per_group

NUMBERS = ("a2", "a3", "a11", "a14", "a15")
WORDS = ("a1", "a4", "a5", "a6", "a7", "a8", "a9", "a10", "a12", "a13")


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _settings(spark: SparkSession, at: str) -> dict[str, float]:
    """The numbers of run_settings, a table of fixed size; more than 10,000 rows are an error."""
    return {r.setting: r.amount for r in _fixed(_table(spark, at, "run_settings"), 10_000)}


def _fixed(df: DataFrame, most: int) -> list:
    """All rows of a table of fixed size; raises if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table of fixed size")
    return rows


def _best(spark: SparkSession, at: str) -> DataFrame:
    rows = _table(spark, at, "tuning_results").where(F.col("auc").between(0.0, 1.0))
    rows = rows.select("result_id", "study", plain("model").alias("model"), plain("feat_select").alias("feat_select"), "auc", "auc_sd")
    n = int(_settings(spark, at)["top_n"])
    return top_n_per_group(rows, ["study", "model", "feat_select"], [("auc", "desc"), ("auc_sd", "asc")], "result_id", n)


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return _best(spark, at).select("result_id")


def p1_best(spark: SparkSession, at: str) -> DataFrame:
    return _best(spark, at)


def _side() -> Column:
    return F.when(F.col("ix_train").isNotNull(), F.lit("a")).when(F.col("ix_tests").isNotNull(), F.lit("b"))


def _overlap(spark: SparkSession, at: str) -> Overlap:
    s = _settings(spark, at)
    words = {c: plain_or_null(c) for c in WORDS}
    return near_classes(
        _table(spark, at, "prep_rows"), "row_id", _side(), NUMBERS, words, s["near_relative_tolerance"], int(s["near_max_differing_features"]), keep=["test_no", "study"]
    )


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    ids = (F.col("id_a"), F.col("id_b"))
    return _overlap(spark, at).expanded().select(F.least(*ids).alias("row_id_a"), F.greatest(*ids).alias("row_id_b"))


def p2_overlap(spark: SparkSession, at: str) -> DataFrame:
    """Pairs, exact ones, and test rows that have any, per test file and study of the test row; from classes, no pair of rows is made."""
    o = _overlap(spark, at)
    links = o.pairs.groupBy("kb1", "kb2").agg(F.sum("n_a").alias("pairs"), F.sum(F.when(F.col("n_differing") == 0, F.col("n_a")).otherwise(0)).alias("exact"))
    tests = o.members.where("side = 'b'").groupBy("test_no", "study", F.col("k1").alias("kb1"), F.col("k2").alias("kb2")).agg(F.count("*").alias("n"))
    report = tests.join(links, ["kb1", "kb2"]).groupBy("test_no", "study")
    return report.agg(F.sum(F.col("n") * F.col("pairs")).alias("n_pairs"), F.sum(F.col("n") * F.col("exact")).alias("n_exact"), F.sum("n").alias("n_test_rows"))


def p2_classes(spark: SparkSession, at: str) -> DataFrame:
    """Each row of a split with its class of equal rows, known by the class's least row on its side, the class's rows, and its linked rows of the other side."""
    o = _overlap(spark, at)
    a, b = ["ka1", "ka2"], ["kb1", "kb2"]
    links = o.pairs.groupBy(*a).agg(F.sum("n_b").alias("n_links")).select(F.lit("a").alias("side"), F.col("ka1").alias("k1"), F.col("ka2").alias("k2"), "n_links")
    links = links.unionByName(o.pairs.groupBy(*b).agg(F.sum("n_a").alias("n_links")).select(F.lit("b").alias("side"), F.col("kb1").alias("k1"), F.col("kb2").alias("k2"), "n_links"))
    key = ["side", "k1", "k2"]
    classes = o.members.groupBy(*key).agg(F.min("id").alias("class_id"), F.count("*").alias("n_rows")).join(links, key, "left")
    linked = o.members.join(classes, key)
    return linked.select(F.col("id").alias("row_id"), F.when(F.col("side") == "a", "train").otherwise("test").alias("split"), "class_id", "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _levels() -> Column:
    """Plain forms of all entries of both lists."""
    both = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("to_deflate", "to_keep")])
    return F.transform(both, plain)


def _terms(spark: SparkSession, at: str) -> DataFrame:
    s = _settings(spark, at)
    return marked_terms(_table(spark, at, "inflation_info"), "info_id", _levels(), s["rare_below_records"], s["common_above_fraction"])


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    marks = F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common")))
    return _terms(spark, at).select("term", F.explode(F.array_compact(marks)).alias("mark"))


def p3_terms(spark: SparkSession, at: str) -> DataFrame:
    return _terms(spark, at)


def p3_totals(spark: SparkSession, at: str) -> DataFrame:
    """Each record's n_total against the distinct levels of its lists."""
    table = _table(spark, at, "inflation_info")
    levels = record_terms(table, "info_id", _levels()).select("info_id", F.col("n_terms").alias("n_levels"))
    rows = table.where("info_id IS NOT NULL").groupBy("info_id").agg(F.max("n_total").cast("long").alias("n_total"))
    return rows.join(levels, "info_id").withColumn("holds", F.coalesce((F.col("n_total") == F.col("n_levels")).cast("int"), F.lit(0)))


def _cutoffs(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, at, "coverage_report").select(plain("source").alias("source"), F.col("coverage").alias("fraction"))
    return fraction_cutoffs(_table(spark, at, "test_samples"), "sample_id", plain("source"), "confidence", targets)


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    valid, cuts = _cutoffs(spark, at)
    kept = valid.join(sized_broadcast(cuts.select("source", "threshold")), "source").where("score >= threshold")
    return kept.select("source", F.col("id").alias("sample_id"))


def p4_cutoffs(spark: SparkSession, at: str) -> DataFrame:
    valid, cuts = _cutoffs(spark, at)
    kept = valid.join(sized_broadcast(cuts), "source").groupBy("source", "fraction", "n", "threshold")
    return kept.agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n_accepted")).withColumnRenamed("fraction", "coverage")


def _links(spark: SparkSession, at: str) -> DataFrame:
    return _table(spark, at, "group_links").select(plain_or_null("g_left").alias("a"), plain_or_null("g_right").alias("b"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    rows = _table(spark, at, "prep_rows").select("row_id", "g_raw", F.col("ix_train").isNotNull().alias("in_train"), F.col("ix_tests").isNotNull().alias("in_tests"))
    of = entities(rows, ["row_id", "in_train", "in_tests"], plain_or_null("g_raw"), spanning_forest(_links(spark, at))).where("entity IS NOT NULL")
    torn = of.groupBy("entity").agg(F.min("row_id").alias("first_row_id"), F.max("in_train").alias("train"), F.max("in_tests").alias("tests"))
    return torn.where("train AND tests").select("first_row_id")


def _splits(spark: SparkSession, at: str) -> DataFrame:
    s = _settings(spark, at)
    shares = {k: s[f"split_{k}"] for k in ("train", "validation", "test")}
    return grouped_splits(_table(spark, at, "prep_rows"), "row_id", plain_or_null("g_raw"), _links(spark, at), shares)[0]


def p5_splits(spark: SparkSession, at: str) -> DataFrame:
    return _splits(spark, at)


def p5_summary(spark: SparkSession, at: str) -> DataFrame:
    """Rows and entities in all, entities that lie in more than one split, and whether each split's share is as near as the largest entity allows."""
    s = _settings(spark, at)
    of = _splits(spark, at)
    per = of.groupBy("entity").agg(F.count("*").alias("rows"), F.count_distinct("split").alias("splits"))
    total = per.agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_entities"), F.count_if(F.col("splits") > 1).alias("n_torn"), F.max("rows").alias("largest"))
    sizes = of.agg(*[F.count_if(F.col("split") == k).alias(k) for k in ("train", "validation", "test")])
    off = [F.abs(F.col(k) - F.lit(s[f"split_{k}"]) / sum(s[f"split_{x}"] for x in ("train", "validation", "test")) * F.col("n_rows")) for k in ("train", "validation", "test")]
    near = F.greatest(*off) <= F.greatest(F.col("largest"), 0.01 * F.col("n_rows"))
    return total.crossJoin(sizes).select("n_rows", "n_entities", "n_torn", near.cast("int").alias("shares_hold"))  # one row each


def p6_ids(spark: SparkSession, at: str) -> DataFrame:
    return encode_corpus(_table(spark, at, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, at: str) -> DataFrame:
    return pack_texts(_table(spark, at, "documents"), "doc_id", "text", int(_settings(spark, at)["container_tokens"]))


def p7_fill(spark: SparkSession, at: str) -> DataFrame:
    """Of the containers: tokens in all, whether any is overfull, pieces that were cut although they fit, and whether 98 percent of the room is used."""
    capacity = int(_settings(spark, at)["container_tokens"])
    packed = p7_containers(spark, at)
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    full = per.agg(F.sum("tokens").alias("n_tokens"), F.count_if(F.col("tokens") > capacity).alias("n_overfull"), F.count("*").alias("n"))
    cut = packed.where("piece > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.max("piece").alias("p"))
    texts = packed.join(cut.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"))
    fits = texts.agg(F.count_if(F.col("tokens") <= capacity).alias("n_cut_needlessly"))
    used = F.col("n_tokens") >= 0.98 * capacity * (F.col("n") - 1)  # the last one may stay open
    return full.crossJoin(fits).select("n_tokens", "n_overfull", "n_cut_needlessly", used.cast("int").alias("well_filled"))  # one row each


def _names(spark: SparkSession, at: str) -> list[str]:
    """The parts of names known to the project, a table of fixed size."""
    rows = _table(spark, at, "name_parts").where("name_part IS NOT NULL").select("name_part", "part_kind")
    return [(r.name_part, r.part_kind) for r in _fixed(rows, 1_000_000)]


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """The five kinds that the test data defines; ``p8_redacted`` replaces account numbers too."""
    return find_pii(_table(spark, at, "documents"), "doc_id", "text", _names(spark, at), [k for k in KINDS if k != "account_number"])


def p8_redacted(spark: SparkSession, at: str) -> DataFrame:
    return redact(_table(spark, at, "documents"), "doc_id", "text", _names(spark, at))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_best, p2_found, p2_overlap, p2_classes, p3_found, p3_terms, p3_totals, p4_found, p4_cutoffs,
        p5_found, p5_splits, p5_summary, p6_ids, p7_containers, p7_fill, p8_found, p8_redacted,
    )
}
