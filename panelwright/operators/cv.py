"""Cross-validation: features once, every model on every fold, predictions in one long table."""

from __future__ import annotations

import copy
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import Config
from panelwright.operators.features import ALL_FEATURES, FAMILIES, ROW_FEATURES, UNBOUNDED, UNBOUNDED_MEMORY, build_memory_features
from panelwright.operators.folds import Fold, assign, date_axis, make_folds
from panelwright.operators.metrics import check_scored, per_fold
from panelwright.operators.models import BoostedTrees, Carry, ConstantMedian, Ridge, Zero
from panelwright.operators.reveal import add_revealed_target
from panelwright.schema import KEY, check_keys


CONCURRENT = 8


@dataclass
class CvResult:
    folds: list[Fold]
    oof: DataFrame
    coefficients: dict = field(default_factory=dict)
    importance: dict = field(default_factory=dict)

    def release(self) -> CvResult:
        self.oof.unpersist()
        return self


def default_models(cfg: Config) -> list:
    return [Zero(), ConstantMedian(), Carry("carry_raw", 1.0), Carry(), Ridge(alpha=cfg.ridge_alpha), Ridge("ridge_noscale", alpha=cfg.ridge_alpha, rescale=False)]


def memory_models(cfg: Config, ablate: bool = False, **trees) -> list:
    """The two-by-two of ridge and trees on row features and on all, and on request trees less one family each."""
    skip = [*UNBOUNDED, *UNBOUNDED_MEMORY]
    out = [Zero(), Ridge(alpha=cfg.ridge_alpha), BoostedTrees("gbt_row", list(ROW_FEATURES), **trees), Ridge("ridge_mem", cfg.ridge_alpha, list(ALL_FEATURES), skip=skip), BoostedTrees("gbt_mem", list(ALL_FEATURES), **trees)]
    if ablate:
        out += [BoostedTrees(f"gbt_mem_minus_{f}", [c for c in ALL_FEATURES if c not in cols], **trees) for f, cols in FAMILIES.items()]
    return out


#: Ridge variants of the ablation, as changes of the model and of the configuration.
RIDGE_VARIANTS = {
    "shipped": ({}, {}),
    "no_feature_clip": ({"clip_in_fit": False, "clip_in_predict": False}, {}),
    "clip_fit_only": ({"clip_in_predict": False}, {}),
    "clip_predict_only": ({"clip_in_fit": False}, {}),
    "no_target_clip": ({}, {"fit_clip_bps": None}),
    "target_clip_20": ({}, {"fit_clip_bps": 20.0}),
    "alpha_1e4": ({"alpha": 1e4}, {}),
    "alpha_1e6": ({"alpha": 1e6}, {}),
    "no_rescale": ({"rescale": False}, {}),
}


def prepare(df: DataFrame, cfg: Config, builder=build_memory_features) -> DataFrame:
    """Drop unlabelled rows, reveal, build: lags and ranks are over labelled rows, in this order."""
    return builder(add_revealed_target(df.where("target is not null")), cfg)


def at_once(f, jobs: list) -> list:
    """Independent fits run side by side: each is a chain of small jobs that leaves most of a cluster idle."""
    with ThreadPoolExecutor(CONCURRENT) as pool:
        return list(pool.map(f, jobs))


def ridge_ablations(rows: DataFrame, cfg: Config, folds: list[Fold]) -> list[tuple[str, int, float]]:
    """(variant, fold, MAE) of every ridge variant on every fold; a variant's folds are fitted together."""
    train, val = assign(rows, folds, "train"), assign(rows, folds, "validation")

    def one(variant: str) -> list[tuple[str, int, float]]:
        model, config = RIDGE_VARIANTS[variant]
        own = replace(cfg, **config)
        oof = Ridge(**({"alpha": own.ridge_alpha} | model)).fit_folds(train, own).predict_folds(val).withColumn("model", F.lit(variant))
        check_scored(oof)
        return [(variant, r["fold"], r["mae_bps"]) for r in per_fold(oof).orderBy("fold").collect()]

    return [r for rs in at_once(one, list(RIDGE_VARIANTS)) for r in rs]


def run_cv(df: DataFrame, cfg: Config, models: list, builder=build_memory_features) -> CvResult:
    """Features are causal, so they are built once and cut by fold. Out-of-fold rows exist for validation dates alone.

    Refuses repeated keys, features that are not finite (as they are built), and a model that leaves
    a labelled validation row without a finite prediction. The out-of-fold table is cached until
    ``CvResult.release``; without its cache it is computed again, with the same rows.
    """
    check_keys(df)
    rows = prepare(df, cfg, builder).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        missing = rows.agg(F.avg(F.col("revealed_target").isNull().cast("double"))).first()[0]
        if missing is not None and missing > 0.25:
            warnings.warn(f"{missing:.0%} of rows have no revealed target; carry models say little", stacklevel=2)
        folds = make_folds(date_axis(rows), cfg)
        train, val = assign(rows, folds, "train"), assign(rows, folds, "validation")
        result = CvResult(folds, None)

        def one(model) -> DataFrame:
            m = copy.deepcopy(model).fit_folds(train, cfg)
            for f in folds:
                if hasattr(m, "coefficients"):
                    result.coefficients[m.name, f.index] = m.coefficients(f.index)
                if hasattr(m, "importance"):
                    result.importance[m.name, f.index] = m.importance(f.index)
            return m.predict_folds(val).select(*KEY, "fold", F.lit(m.name).alias("model"), "target", "prediction")

        result.oof = reduce(DataFrame.unionByName, at_once(one, models)).persist(StorageLevel.MEMORY_AND_DISK)
        check_scored(result.oof)
        return result
    finally:
        rows.unpersist()
