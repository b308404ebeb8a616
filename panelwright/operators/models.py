"""Models, fitted on all folds at once: ``fit_folds(train)`` is a few aggregates grouped by fold.

``train`` repeats a row for each fold that trains on it (``folds.assign``), so a model costs the
same number of passes whatever the number of folds; ``predict_folds`` adds a column named
prediction with each row's own fold's parameters. ``fit`` and ``predict`` are the same on one
unnamed fold. Frames carry the panel's key, target, revealed_target and features; no model relies
on row order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import Config
from panelwright.functions.columns import clip, or_zero
from panelwright.operators.features import ROW_FEATURES, UNBOUNDED
from panelwright.operators.grid import optimal_scales

#: The one fold of ``fit``.
WHOLE = 0
FOLD = "_model_fold"


def of_fold(by: str, values: dict[int, Column | float]) -> Column:
    """Every row's own fold's value: only that branch is computed."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(by) == k, v if isinstance(v, Column) else F.lit(float(v))).otherwise(out)
    return out


class Model:
    """What all models share: fitting one frame is fitting one fold."""

    name: str

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> Model:
        raise NotImplementedError

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame, cfg: Config) -> Model:
        return self.fit_folds(df.withColumn(FOLD, F.lit(WHOLE)), cfg, FOLD)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_folds(df.withColumn(FOLD, F.lit(WHOLE)), FOLD).drop(FOLD)


@dataclass
class Zero(Model):
    name: str = "zero"

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> Zero:
        return self

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        return val.withColumn("prediction", F.lit(0.0))


@dataclass
class ConstantMedian(Model):
    name: str = "constant_median"
    values: dict[int, float] = field(default_factory=dict)

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> ConstantMedian:
        median = F.percentile_approx("target", F.lit(0.5), 100_000) if cfg.approximate else F.median("target")
        self.values = {r[by]: r["m"] or 0.0 for r in train.groupBy(by).agg(median.alias("m")).collect()}
        return self

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        return val.withColumn("prediction", of_fold(by, self.values))


@dataclass
class Carry(Model):
    """The previous date's target times a factor; without a given one, the MAE-optimal factor of the training rows."""

    name: str = "carry_shrunk"
    shrink: float | None = None
    fitted: dict[int, float] = field(default_factory=dict)

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> Carry:
        if self.shrink is None:
            self.fitted = optimal_scales(train, F.col("target"), or_zero(F.col("revealed_target")), by)
        return self

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        factor = F.lit(float(self.shrink)) if self.shrink is not None else of_fold(by, self.fitted)
        return val.withColumn("prediction", factor * or_zero(F.col("revealed_target")))


Bounds = dict[str, tuple[float, float]]


def fold_bounds(df: DataFrame, columns: list[str], by: str, q: float = 0.001, skip: list[str] = UNBOUNDED, approximate: bool = False) -> dict[int, Bounds]:
    """(q, 1 - q) quantiles per fold by linear interpolation; ``approximate`` bounds memory on huge tables. One aggregate."""
    use = [c for c in columns if c not in skip]
    at = F.array(F.lit(q), F.lit(1 - q))
    of = (lambda c: F.percentile_approx(c, at, 20_000)) if approximate else (lambda c: F.percentile(c, at))
    if not use:
        return {}
    rows = df.groupBy(by).agg(*(of(c).alias(c) for c in use)).collect()
    return {r[by]: {c: (r[c][0], r[c][1]) for c in use if r[c] is not None} for r in rows}


def quantile_bounds(df: DataFrame, columns: list[str], q: float = 0.001, skip: list[str] = UNBOUNDED, approximate: bool = False) -> Bounds:
    return fold_bounds(df.withColumn(FOLD, F.lit(WHOLE)), columns, FOLD, q, skip, approximate).get(WHOLE, {})


def clipped(c: str, bounds: Bounds) -> Column:
    return clip(F.col(c), *bounds[c]) if c in bounds else F.col(c)


def sd_inflation(df: DataFrame, columns: list[str] = ROW_FEATURES, approximate: bool = False) -> dict[str, float]:
    """How many times larger a column's deviation is before clipping than after; two aggregates."""
    bounds = quantile_bounds(df, columns, approximate=approximate)
    sd = F.stddev_samp
    one = df.agg(*(F.when(sd(clipped(c, bounds)) > 0, sd(c) / sd(clipped(c, bounds))).otherwise(1.0).alias(c) for c in bounds)).first()
    return one.asDict()


def products(rows: DataFrame, columns: list[str], by: str, bounds: dict[int, Bounds]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per group: rows, means and summed products of differences from the means, of the clipped columns and ``_y``.

    Over a hundred sums are more than generated code takes in one aggregate, so a batch is one
    matrix product; a task returns one row per group, merged pairwise without loss of digits.
    """
    low = {f: np.array([b[c][0] if c in b else -np.inf for c in columns] + [-np.inf]) for f, b in bounds.items()}
    high = {f: np.array([b[c][1] if c in b else np.inf for c in columns] + [np.inf]) for f, b in bounds.items()}

    def merge(a, b):
        if a is None:
            return b
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for f in np.unique(fold).tolist():
                z = x[fold == f]
                if f in low:
                    z = np.clip(z, low[f], high[f])
                mean = z.mean(axis=0)
                z = z - mean
                held[f] = merge(held.get(f), (len(z), mean, z.T @ z))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64())), pa.array([v[2].ravel().tolist() for v in held.values()], pa.list_(pa.float64()))], ["fold", "n", "mean", "g"])

    out: dict[int, tuple] = {}
    kinds = rows.select(F.col(by).cast("int"), *(F.col(c).cast("double") for c in [*columns, "_y"]))
    for r in kinds.mapInArrow(run, "fold int, n long, mean array<double>, g array<double>").collect():  # a row for each task and fold
        out[r["fold"]] = merge(out.get(r["fold"]), (r["n"], np.array(r["mean"]), np.array(r["g"]).reshape(len(r["mean"]), -1)))
    return out


@dataclass
class RidgeFit:
    """One fold's parameters."""

    bounds: Bounds
    mean: np.ndarray
    sd: np.ndarray
    coef: np.ndarray
    intercept: float
    scale: float = 1.0

    def raw(self, columns: list[str], clip_it: bool) -> Column:
        p = F.lit(self.intercept)
        for i, c in enumerate(columns):
            p = p + (clipped(c, self.bounds if clip_it else {}) - float(self.mean[i])) / float(self.sd[i]) * float(self.coef[i])
        return p * float(self.scale)


@dataclass
class Ridge(Model):
    """Winsorised, standardised (population deviation) ridge: one aggregate of bounds and one pass of products for all folds, a small solve per fold on the driver.

    The target is clipped for the fit only; ``rescale`` multiplies predictions by their MAE-optimal factor.
    """

    name: str = "ridge"
    alpha: float = 1.0
    columns: list[str] = field(default_factory=lambda: list(ROW_FEATURES))
    rescale: bool = True
    clip_in_fit: bool = True
    clip_in_predict: bool = True
    skip: list[str] = field(default_factory=lambda: list(UNBOUNDED))
    fits: dict[int, RidgeFit] = field(default_factory=dict)

    @property
    def coef(self) -> np.ndarray:
        return self.fits[WHOLE].coef

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> Ridge:
        train = train.where("target is not null")
        k = len(self.columns)
        bounds = fold_bounds(train, self.columns, by, skip=self.skip, approximate=cfg.approximate) if self.clip_in_fit or self.clip_in_predict else {}
        y = clip(F.col("target"), -cfg.fit_clip_bps, cfg.fit_clip_bps) if cfg.fit_clip_bps is not None else F.col("target")
        fits = products(train.select(by, *self.columns, y.alias("_y")), self.columns, by, bounds if self.clip_in_fit else {})
        if not fits:
            raise ValueError("no labelled row to fit on")
        for f, (n, mean, g) in fits.items():
            sd = np.sqrt(np.diag(g)[:k] / n)
            sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean[:k])), sd, 1.0)
            coef = np.linalg.solve(g[:k, :k] / np.outer(sd, sd) + self.alpha * np.eye(k), g[:k, k] / sd)
            self.fits[f] = RidgeFit(bounds.get(f, {}), mean[:k], sd, coef, float(mean[k]))
        if self.rescale:
            raw = of_fold(by, {f: m.raw(self.columns, self.clip_in_fit) for f, m in self.fits.items()})
            for f, a in optimal_scales(train, F.col("target"), raw, by).items():
                self.fits[f].scale = a
        return self

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        return val.withColumn("prediction", of_fold(by, {f: m.raw(self.columns, self.clip_in_predict) for f, m in self.fits.items()}))

    def coefficients(self, fold: int = WHOLE) -> list[tuple[str, float]]:
        """By absolute size, largest first."""
        m = self.fits[fold]
        return sorted(((c, float(m.scale * w)) for c, w in zip(self.columns, m.coef)), key=lambda x: -abs(x[1]))


@dataclass
class BoostedTrees(Model):
    """Gradient-boosted trees under absolute loss (MLlib: level-wise trees, features sampled per node); one fit per fold."""

    name: str = "gbt"
    columns: list[str] = field(default_factory=lambda: list(ROW_FEATURES))
    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    min_rows: int = 200
    sample: float = 0.8
    models: dict[int, object] = field(default_factory=dict)

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.columns, outputCol="_x").transform(df)

    def fit_folds(self, train: DataFrame, cfg: Config, by: str = "fold") -> BoostedTrees:
        from pyspark.ml.regression import GBTRegressor

        from panelwright.operators.seeding import spark_seed

        rows = self._vectors(train.where("target is not null"))
        for r in rows.select(by).distinct().collect():
            gbt = GBTRegressor(featuresCol="_x", labelCol="target", predictionCol="prediction", lossType="absolute", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, minInstancesPerNode=self.min_rows, subsamplingRate=self.sample, featureSubsetStrategy=str(self.sample), seed=spark_seed("trees", self.name))
            self.models[r[by]] = gbt.fit(rows.where(F.col(by) == r[by]))
        return self

    def predict_folds(self, val: DataFrame, by: str = "fold") -> DataFrame:
        rows = self._vectors(val)
        parts = [m.transform(rows.where(F.col(by) == f)) for f, m in self.models.items()]
        return reduce(DataFrame.unionByName, parts).drop("_x")

    def importance(self, fold: int = WHOLE) -> list[tuple[str, float]]:
        """Gain shares, which sum to 1; largest first."""
        return sorted(zip(self.columns, self.models[fold].featureImportances.toArray().tolist()), key=lambda x: -x[1])
