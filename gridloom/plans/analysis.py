"""The whole analysis of a table: inspect, prepare, describe, associate, select, tune, score, adaptive error, write."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.durable import Stage
from gridloom.functions.names import sanitize
from gridloom.functions.ranks import hashed_positions
from gridloom.operators import adaptive as E
from gridloom.operators import associate as A
from gridloom.operators import describe as D
from gridloom.operators import ensemble as N
from gridloom.operators import inspect as I
from gridloom.operators import models as L
from gridloom.operators import prepare as P
from gridloom.operators import results as R
from gridloom.operators import score as S
from gridloom.operators import select as Q
from gridloom.operators import split as X
from gridloom.options import Options
from gridloom.sources import readers, saved, writers

ROW = "_row_id"


@dataclass
class Report:
    """Everything an analysis found; tables are DataFrames."""

    schema: I.Schema
    tables: dict[str, DataFrame] = field(default_factory=dict)
    selected: dict[str, list[str]] = field(default_factory=dict)
    tuned: dict[str, dict] = field(default_factory=dict)
    folder: str | None = None

    def to_markdown(self) -> str:
        parts = ["# Columns", self.schema.to_markdown(), "# Selected features", *[f"* {k}: {', '.join(v) or 'none'}" for k, v in self.selected.items()]]
        for name in ("performance", "adaptive_error_bins", "coverage"):
            if name in self.tables:
                parts += [f"# {name.replace('_', ' ').capitalize()}", writers.to_markdown(self.tables[name])]
        return "\n\n".join(parts) + "\n"


def load(spark: SparkSession, options: Options) -> DataFrame:
    """The table that the options name, with ``_src`` where train and test files were given, and a row number."""
    if options.df_train:
        df = readers.read_train_tests(spark, options.df_train, options.df_tests, options.separator)
    elif options.spreadsheet:
        df = readers.read_spreadsheet(spark, options.spreadsheet, options.separator)[0]
    elif options.df:
        df = readers.read_table(spark, options.df, options.separator)
    else:
        raise ValueError("no table given: df, df_train or spreadsheet")
    return numbered(df)


def numbered(df: DataFrame) -> DataFrame:
    """Rows numbered in the order of a hash of what they hold, so that the numbers, and the splits drawn by them, don't depend on the files' layout.

    Equal rows get neighbouring numbers in any order; they can stand for each other.
    """
    cells = [c for f in df.schema for c in (F.isnull(F.col(f"`{f.name}`")), F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`"))]
    keyed = df.withColumn("_key", F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), *cells)), F.hex(F.xxhash64(*cells, F.lit(2)))))
    return hashed_positions(keyed, [], 0, "_key", ROW).drop("_key", f"{ROW}_of")


def _associations(p: P.Prepared, target: str, classify: bool, o: Options) -> DataFrame:
    """All statistics of each feature, with ``score``, the one that the options choose for its kind."""
    raw = [f"{c}_raw" for c in (p.one_hot.levels if p.one_hot else {})]
    t = A.associations(p.df, p.continuous, raw, target, classify)
    metrics = {"cont": o.filter_assoc_cont_classify, "cat": o.filter_assoc_cat_classify} if classify else {"cont": o.filter_assoc_cont_regress, "cat": o.filter_assoc_cat_regress}
    unknown = [m for kind, m in metrics.items() if (p.continuous if kind == "cont" else raw) and (m not in t.columns or m not in A.HIGHER_IS_BETTER)]
    if unknown:
        raise ValueError(f"unknown association: {unknown}")
    score = F.coalesce(*[F.when(F.col("kind") == kind, F.col(m)) for kind, m in metrics.items() if m in t.columns])
    return t.withColumns({"feature": F.when(F.col("kind") == "cat", F.regexp_replace("feature", "_raw$", "")).otherwise(F.col("feature")), "score": score})


def _select(p: P.Prepared, target: str, classify: bool, o: Options, associations: DataFrame, predictions: DataFrame | None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"none": list(p.features)}
    if "filter" in o.feat_select:
        n_cont, n_cat = Q.n_select("cont", len(p.continuous), o.n_filter_cont), Q.n_select("cat", len(p.categorical), o.n_filter_cat)
        if "assoc" in o.filter_method:
            chosen = Q.by_association(associations, "score", n_cont, n_cat).orderBy("kind", "rank").collect()
            out["assoc"] = [c for r in chosen for c in P.columns_of_level(p, r.feature)]
        if predictions is not None:
            metric, higher = o.filter_pred_classify if classify else o.filter_pred_regress, classify or o.filter_pred_regress in ("r2", "var-exp")
            raw = F.col("feature").endswith("_raw")
            chosen = [r for kind, n in ((~raw, n_cont), (raw, n_cat)) for r in Q.by_prediction(predictions.where(kind), metric, higher, n).orderBy("rank").collect()]
            out["pred"] = [c for r in chosen for c in P.columns_of_level(p, r.feature.removesuffix("_raw") if r.feature not in p.continuous else r.feature)]
    if "embed" in o.feat_select:
        for how in o.embed_select:
            out[f"embed_{how}"] = [f for f, _ in Q.by_model(p.df, p.features, target, classify, how, seed=o.seed)]
    if o.wrapper_select or "wrap" in o.feat_select:
        redundancy = o.redundant_threshold if o.redundant_wrapper_selection else None
        classes = sorted(p.labels[target]) if classify and target in p.labels else None
        out["wrap"] = [f for f, _ in Q.stepwise(p.df, ROW, p.features, target, o.n_feat_wrapper, o.wrapper_select != "step-down", redundancy, seed=o.seed, classes=classes)]
    return {k: v for k, v in out.items() if v}


def _holdout(p: P.Prepared, target: str, classify: bool, o: Options, sources: list[int]) -> list[tuple[str, DataFrame, DataFrame]]:
    if len(sources) > 1:
        return [(f"{a}-{b}", p.df.where(F.col("_src").isin(a)), p.df.where(F.col("_src").isin(b))) for a, b in X.source_splits(sources, o.df_tests_method)]
    if p.group:
        split = X.grouped_holdout(p.df, p.group, target if classify else None, 1 - o.test_val_size, o.seed)
    else:
        split = X.holdout(p.df, ROW, target if classify else None, 1 - o.test_val_size, o.seed)
    return [("holdout", split.where("is_train = 1"), split.where("is_train = 0"))]


def _scores(predicted: DataFrame, classify: bool) -> DataFrame:
    wide = S.class_scores(predicted, [], "label", "y_pred").drop("n") if classify else S.regression_scores(predicted, [], "label", "y_pred")
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def analyse(spark: SparkSession, options: Options, df: DataFrame | None = None, resume: bool = False) -> Report:
    """Runs the analysis; with ``outdir`` all tables are written to the run's folder, named by the options.

    ``resume`` reads a run with these options back from there, if it was finished.

    One model is tuned for each target, family, selection and split; predictions, not models, are
    what later steps read.
    """
    o, classify = options, options.mode == "classify"
    o.check()
    folder = f"{o.outdir.rstrip('/')}/{writers.run_key(o.to_dict())}" if o.outdir else None
    if folder and resume and (back := saved.load_run(spark, folder)):
        return Report(I.Schema({r.feature_name: (r.inferred, r.reason, r.user) for r in back.tables["inspection"].collect()}), back.tables, back.selected, back.tuned, folder)
    raw = load(spark, o) if df is None else df if ROW in df.columns else numbered(df)
    rows, renames = sanitize(raw, o.all_targets()[0])
    targets = renames.apply(o.all_targets())
    group = renames.apply([o.grouper])[0] if o.grouper else None
    own = [ROW, *(["_src"] if "_src" in rows.columns else [])]
    schema = I.inspect(rows.drop(*targets, *own), None, renames.apply(o.categoricals), renames.apply(o.ordinals), renames.apply(o.drops), group)
    report = Report(schema)
    p = P.prepare(rows, targets, schema.continuous, schema.categorical, classify, group, o.nan, True, o.norm == "robust")
    p.validate(classify)
    stage = Stage(spark, "analysis")  # tables that many later steps read
    p.df = stage.write(p.df)
    sources = sorted(r[0] for r in rows.select("_src").distinct().collect()) if "_src" in rows.columns else [0]
    report.tables["inspection"] = schema.table(spark)
    described = D.describe_all(rows, p.continuous, p.categorical, targets[0], classify)
    report.tables |= {f"describe_{k}": t for k, t in described.items() if t is not None}
    for t in targets[1:]:
        report.tables[f"describe_target_{t}"] = D.describe_all(rows, [], [], t, classify)["target"]
    performance, aer = [], []
    for target in targets:
        own_p = p.for_target(target) if len(targets) > 1 else p
        associations = report.tables[f"associations_{target}"] = stage.write(_associations(own_p, target, classify, o))
        predictions = None
        if "filter" in o.feat_select and "pred" in o.filter_method and not o.no_preds:
            raw_cat = [f"{c}_raw" for c in (own_p.one_hot.levels if own_p.one_hot else {})]
            known = L.UNIVARIATE[classify]
            predictions = report.tables[f"predictions_{target}"] = stage.write(L.univariate_predictions(own_p.df, ROW, own_p.continuous, target, classify, seed=o.seed, categorical=raw_cat, metrics=known))
        chosen = _select(own_p, target, classify, o, associations, predictions)
        report.selected |= {f"{target}.{k}": v for k, v in chosen.items()}
        for how, features in chosen.items():
            for split, train, test in _holdout(own_p, target, classify, o, sources):
                a, b = (stage.write(L.assemble(part, ROW, features, target)) for part in (train, test))
                for name in o.classifiers if classify else o.regressors:
                    t = L.tune(a, name, classify, o.htune_trials, 3, seed=o.seed, metric=o.htune_cls_metric if classify else o.htune_reg_metric)
                    report.tuned[f"{target}.{how}.{split}.{name}"] = {"params": t.params, "score": t.score}
                    predicted = stage.write(L.predict(t.model, b, classify))
                    tags = {"target": F.lit(target), "model": F.lit(name), "selection": F.lit(how), "split": F.lit(split)}
                    performance.append(_scores(predicted, classify).withColumns(tags))
                    if classify and o.adaptive_error and how == "none":
                        oof = stage.write(E.confidence_metrics(L.out_of_fold(a, name, t.params, True, o.aer_oof_folds, o.seed), "proba").withColumns(tags))
                        held = E.confidence_metrics(predicted, "proba").withColumns(tags)
                        aer.append((oof, held, t.score))
    if len(targets) > 1:
        ranked = [report.tables[f"associations_{t}"].groupBy("feature").agg(F.max(F.abs("score")).alias("score")).where("score IS NOT NULL").withColumn("target", F.lit(t)) for t in targets]
        agreed = Q.aggregate_selections(reduce(DataFrame.unionByName, ranked), o.mt_agg_strategy, most=o.mt_top_k)
        report.tables["selection_over_targets"] = agreed
        report.selected["all.assoc"] = [r.feature for r in agreed.collect()]
    report.tables["performance"] = reduce(DataFrame.unionByName, performance)
    keys = ["target", "model", "selection", "split"]
    names = sorted({r.metric for r in report.tables["performance"].select("metric").distinct().collect()})  # a handful
    report.tables["final"] = R.wide_table(report.tables["performance"], keys, "metric", "value", names)
    if aer:
        _adaptive(report, aer, o)
    if o.outdir:
        report.folder = folder
        saved.save_run(folder, o, report.tables, report.selected, report.tuned, report.to_markdown(), p, ("per_sample", *[k for k in report.tables if k.startswith("ensemble_")]))
    return report


def _adaptive(report: Report, parts: list, o: Options) -> None:
    """Bins from out-of-fold confidences, expected errors of the held-out rows, coverage, risk control and ensembles."""
    keys = ["target", "split", "model"]
    oof = reduce(DataFrame.unionByName, [x[0].drop("fold", "selection") for x in parts])
    held = reduce(DataFrame.unionByName, [x[1].drop("selection") for x in parts])
    wrong = F.col("label") != F.col("y_pred")
    options = {"n_bins": o.aer_bins, "min_count": o.aer_min_bin_count, "smooth": o.aer_smooth, "monotonic": o.aer_monotonic, "prior": o.aer_prior_strength, "adaptive": o.aer_adaptive_binning}
    stage = Stage(oof.sparkSession, "adaptive")
    metric = o.aer_confidence_metric
    if metric == "auto":  # the one whose cross-fitted expected error predicts errors best
        ranked = oof.withColumn("_key", F.concat_ws("/", *keys, "id"))
        brier = report.tables["confidence_choice"] = stage.write(E.select_confidence(ranked, "_key", ["p_max", "p_margin"], wrong))
        best = brier.orderBy("brier", "metric").first()
        metric = best.metric if best else "p_max"
    bins = stage.write(E.fit_bins(oof, keys, metric, wrong, **options))
    scored = stage.write(E.expected_error(held, keys, metric, bins))
    risk = E.expected_error(oof, keys, metric, bins)
    curve = stage.write(E.coverage_curve(scored, keys, "aer", "id", ~wrong))
    report.tables |= {
        "adaptive_error_bins": bins, "per_sample": scored, "coverage": E.at_coverage(curve, keys, [0.5, 0.8, 0.9, 0.95, 1.0]), "coverage_area": E.curve_area(curve, keys),
        "risk_control": E.risk_threshold(risk, keys, "aer", wrong, o.aer_target_error, o.aer_alpha, o.aer_nmin),
        "reliability": S.reliability(scored, keys, "aer", wrong), "most_uncertain": scored.orderBy(F.desc("aer"), "id").limit(20),
    }
    if o.aer_ensemble:
        acc = oof.groupBy(*keys).agg(F.avg((~wrong).cast("double")).alias("acc"))  # a row a model
        if o.aer_top_k:
            acc = acc.withColumn("_r", F.row_number().over(W.partitionBy("target", "split").orderBy(F.desc("acc"), "model"))).where(F.col("_r") <= o.aer_top_k).drop("_r")
        stack = scored.join(acc, keys).select(F.concat_ws("/", "target", "split", "id").alias("row_id"), "model", "acc", "aer", "proba")
        params = {"top_n": o.aer_ens_top_n, "beta": o.aer_ens_beta, "tau0": o.aer_ens_tau0, "lam": o.aer_ens_lambda, "alpha": o.aer_ens_alpha, "trim_q": o.aer_ens_trim_q, "tau_low": o.aer_ens_tau_low, "tau_high": o.aer_ens_tau_high}
        for name in o.aer_ensemble_strategies or list(N.STRATEGIES):
            report.tables[f"ensemble_{name}"] = N.ensemble(stack, name, **params)
