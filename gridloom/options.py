"""Options of a run: one dataclass, and the command line that fills it."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields
from collections.abc import Sequence


def _list(text: str) -> list[str]:
    return [t for t in text.replace(" ", ",").split(",") if t]


@dataclass
class Options:
    """What is analysed, and how. Field names are the flags with underscores."""

    spreadsheet: str | None = None
    df: str | None = None
    df_train: str | None = None
    df_tests: list[str] = field(default_factory=list)
    df_tests_method: str = "list"
    separator: str = ","
    target: str = "target"
    targets: list[str] = field(default_factory=list)
    grouper: str | None = None
    categoricals: list[str] = field(default_factory=list)
    ordinals: list[str] = field(default_factory=list)
    drops: list[str] = field(default_factory=list)
    mode: str = "classify"
    classifiers: list[str] = field(default_factory=lambda: ["lr", "rf"])
    regressors: list[str] = field(default_factory=lambda: ["elastic", "rf"])
    feat_select: list[str] = field(default_factory=lambda: ["filter"])
    embed_select: list[str] = field(default_factory=lambda: ["linear"])
    wrapper_select: str | None = None
    wrapper_model: str = "linear"
    norm: str = "robust"
    nan: str = "mean"
    n_feat_filter: float = 0.5
    n_feat_wrapper: int = 20
    n_filter_cont: float = 0.5
    n_filter_cat: float = 0.5
    filter_method: list[str] = field(default_factory=lambda: ["assoc"])
    filter_assoc_cont_classify: str = "mut_info"
    filter_assoc_cat_classify: str = "mut_info"
    filter_assoc_cont_regress: str = "F"
    filter_assoc_cat_regress: str = "H"
    filter_pred_regress: str = "mae"
    filter_pred_classify: str = "acc"
    redundant_wrapper_selection: bool = False
    redundant_threshold: float = 0.005
    redundant_corr_threshold: float = 0.8
    htune_trials: int = 100
    htune_cls_metric: str = "bal-acc"
    htune_reg_metric: str = "mae"
    test_val_size: float = 0.4
    mt_agg_strategy: str = "borda"
    mt_top_k: int | None = None
    adaptive_error: bool = False
    aer_oof_folds: int = 5
    aer_bins: int = 20
    aer_target_error: float = 0.05
    aer_alpha: float = 0.05
    aer_min_bin_count: int = 10
    aer_prior_strength: float = 2.0
    aer_smooth: bool = True
    aer_monotonic: bool = False
    aer_adaptive_binning: bool = False
    aer_confidence_metric: str = "auto"
    aer_nmin: int = 1
    aer_top_k: int = 0
    aer_ensemble: bool = False
    aer_ensemble_strategies: list[str] = field(default_factory=list)
    aer_ens_top_n: int = 3
    aer_ens_beta: float = 5.0
    aer_ens_tau0: float = 0.3
    aer_ens_lambda: float = 0.5
    aer_ens_alpha: float = 0.7
    aer_ens_trim_q: float = 0.6
    aer_ens_tau_low: float = 0.15
    aer_ens_tau_high: float = 0.35
    outdir: str | None = None
    no_preds: bool = False
    verbosity: int = 1
    no_warn_explosion: bool = False
    seed: int = 69

    def all_targets(self) -> list[str]:
        return self.targets or [self.target]

    def check(self) -> None:
        """Raises for a value that no operator knows; nothing is replaced by a default."""
        known = {
            "mode": ("classify", "regress"), "nan": ("mean", "median", "impute", "drop"), "wrapper_model": ("linear",), "wrapper_select": (None, "step-up", "step-down"),
            "mt_agg_strategy": ("borda", "freq"), "aer_confidence_metric": ("auto", "p_max", "p_margin"), "df_tests_method": ("single", "list", "lodo"),
            "filter_pred_classify": ("acc", "bal-acc", "f1"), "filter_pred_regress": ("mae", "msqe", "mdae", "r2", "var-exp"), "norm": ("robust", "minmax"),
        }
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} can't be {getattr(self, name)!r}, only one of {values}")

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


def parser() -> argparse.ArgumentParser:
    """The command line; flags that aren't given leave no trace, so that they can be told from defaults."""
    p = argparse.ArgumentParser("gridloom", argument_default=argparse.SUPPRESS)
    for f in fields(Options):
        default = getattr(Options(), f.name)
        flag = "--" + f.name.replace("_", "-")
        if f.name == "aer_smooth":
            p.add_argument("--no-aer-smooth", dest="aer_smooth", action="store_false")
        elif isinstance(default, bool):
            p.add_argument(flag, dest=f.name, action="store_true")
        elif isinstance(default, list):
            p.add_argument(flag, dest=f.name, type=_list)
        elif isinstance(default, (int, float)) or f.name == "mt_top_k":
            p.add_argument(flag, dest=f.name, type=int if f.name == "mt_top_k" else type(default))
        else:
            p.add_argument(flag, dest=f.name)
    p.add_argument("--version", action="version", version="gridloom 0.1")
    return p


def parse(args: Sequence[str], embedded: Sequence[str] = ()) -> Options:
    """Options from the command line, then from the table's own preamble, then the defaults."""
    clean = [a for a in embedded if a != "--"]
    own = vars(parser().parse_args(clean)) if clean else {}
    return Options(**{**own, **vars(parser().parse_args([a for a in args if a != "--"]))})
