"""Convex blends of two models' out-of-fold predictions, with weights fixed or fitted forward in time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.grid import best, grid_losses, optimal

COARSE = np.linspace(0, 1, 21)


def blended(w: float):
    return F.lit(float(w)) * F.col("a") + F.lit(1.0 - float(w)) * F.col("b")


def pair_up(oof: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """One row per key with both predictions as a and b."""
    one = lambda m, n: F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(n)
    return oof.where(F.col("model").isin(a, b)).groupBy(*keys, "fold").agg(F.max("target").alias("target"), one(a, "a"), one(b, "b"))


def labelled(pairs: DataFrame) -> DataFrame:
    return pairs.where("target is not null and a is not null and b is not null")


def optimal_weight(pairs: DataFrame) -> float:
    """Weight of a that minimises the mean absolute error of w a + (1 - w) b."""
    w = optimal(labelled(pairs), F.col("target"), blended, COARSE, low=0.0, high=1.0)
    if w is None:
        raise ValueError("no labelled row with both predictions")
    return w


def blend_fixed(pairs: DataFrame, w: float) -> DataFrame:
    if not 0 <= w <= 1:
        raise ValueError(f"weight {w} lies outside [0, 1]")
    return pairs.withColumn("prediction", blended(w))


def forward_weights(pairs: DataFrame, folds: list[int], prior: float = 0.5) -> dict[int, float]:
    """Fold k's weight from the rows of folds before k alone; the first has the prior.

    The coarse grid is one aggregate by fold: losses are additive, so earlier folds are a prefix
    sum. The refinements of all folds are one more pass over rows repeated once per later fold.
    """
    rows = labelled(pairs)
    folds = sorted(folds)
    n = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    losses = grid_losses(rows, F.col("target"), blended, COARSE, "fold")
    weights: dict[int, float] = {}
    total, first = np.zeros(len(COARSE)), {}
    for k in folds:
        first[k] = best(COARSE, total) if total.any() or any(j < k and n.get(j) for j in folds) else None
        if k in losses:
            total = total + losses[k] * n[k]
    fine = {k: np.unique(np.clip(np.linspace(w - 0.05, w + 0.05, 21), 0, 1)) for k, w in first.items() if w is not None}
    if fine:
        width = max(map(len, fine.values()))
        grid = {k: np.concatenate([g, np.repeat(g[-1:], width - len(g))]) for k, g in fine.items()}
        table = pairs.sparkSession.createDataFrame([(int(k), [float(x) for x in g]) for k, g in grid.items()], "fit_fold int, grid array<double>")
        later = rows.join(F.broadcast(table), F.col("fold") < F.col("fit_fold"))  # as many rows as folds
        at = lambda i: F.col("grid")[i] * F.col("a") + (1 - F.col("grid")[i]) * F.col("b")
        for r in later.groupBy("fit_fold").agg(*(F.avg(F.abs(F.col("target") - at(i))).alias(f"g{i}") for i in range(width))).collect():
            k = r["fit_fold"]
            weights[k] = best(fine[k], np.array([r[f"g{i}"] for i in range(len(fine[k]))]))
    return {k: weights.get(k, prior) for k in folds}


def blend_forward(pairs: DataFrame, folds: list[int], prior: float = 0.5) -> tuple[DataFrame, dict[int, float]]:
    weights = forward_weights(pairs, folds, prior)
    table = pairs.sparkSession.createDataFrame([(int(k), float(w)) for k, w in weights.items()], "fold int, weight double")
    out = pairs.join(F.broadcast(table), "fold").withColumn("prediction", F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"))
    return out, weights
