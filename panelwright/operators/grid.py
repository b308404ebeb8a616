"""One-dimensional MAE-optimal weights by a coarse grid and a refinement, each one aggregate over the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_losses(df: DataFrame, y: Column, p, grid, by: str | None = None) -> dict:
    """Mean absolute error for every grid value ({group: array} with ``by``, of few groups)."""
    losses = [F.avg(F.abs(y - p(float(a)))).alias(f"g{i}") for i, a in enumerate(grid)]
    rows = (df.groupBy(by) if by else df.groupBy()).agg(*losses).collect()
    return {r[by] if by else None: np.array([np.nan if r[f"g{i}"] is None else r[f"g{i}"] for i in range(len(grid))]) for r in rows}


def best(grid: np.ndarray, losses: np.ndarray) -> float | None:
    """The first minimum; None where nothing was measured."""
    return None if np.isnan(losses).all() else float(grid[int(np.nanargmin(losses))])


def optimal(df: DataFrame, y: Column, p, coarse: np.ndarray, half: float = 0.05, points: int = 21, low: float = 0.0, high: float = float("inf")) -> float | None:
    """Grid minimum refined within ``half`` of it."""
    first = best(coarse, grid_losses(df, y, p, coarse)[None])
    if first is None:
        return None
    fine = np.unique(np.clip(np.linspace(first - half, first + half, points), low, high))
    return best(fine, grid_losses(df, y, p, fine)[None])


def optimal_scales(df: DataFrame, y: Column, p: Column, by: str) -> dict[int, float]:
    """Per group, a >= 0 that minimises the mean of |y - a p|; 0 where p says nothing. Two aggregates for all groups."""
    rows = df.where(y.isNotNull() & p.isNotNull()).select(by, y.alias("_y"), p.alias("_p"))
    coarse = np.linspace(0, 2, 41)
    loss = lambda a: F.avg(F.abs(F.col("_y") - a * F.col("_p")))
    first, out = {}, {}
    for r in rows.groupBy(by).agg(F.count_if(F.col("_p") != 0).alias("says"), *(loss(F.lit(float(a))).alias(f"g{i}") for i, a in enumerate(coarse))).collect():
        out[r[by]] = 0.0
        if r["says"]:
            first[r[by]] = best(coarse, np.array([r[f"g{i}"] for i in range(len(coarse))]))
    if first:
        fine = {f: np.clip(np.linspace(a - 0.05, a + 0.05, 21), 0.0, None) for f, a in first.items()}
        at = lambda i: F.coalesce(*(F.when(F.col(by) == f, F.lit(float(g[i]))) for f, g in fine.items()))
        for r in rows.where(F.col(by).isin(list(fine))).groupBy(by).agg(*(loss(at(i)).alias(f"g{i}") for i in range(21))).collect():
            out[r[by]] = best(fine[r[by]], np.array([r[f"g{i}"] for i in range(21)]))
    return out


def optimal_scale(df: DataFrame, y: Column, p: Column) -> float:
    """The same for one whole frame."""
    return optimal_scales(df.withColumn("_all", F.lit(0)), y, p, "_all").get(0, 0.0)
