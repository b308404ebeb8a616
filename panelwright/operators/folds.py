"""Purged, embargoed forward-chaining folds over a date axis. Pure driver logic on at most as many ints as there are dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.config import Config


class LeakError(AssertionError):
    pass


@dataclass(frozen=True)
class Fold:
    index: int
    train_dates: tuple[int, ...]
    val_dates: tuple[int, ...]
    embargoed: tuple[int, ...]


def date_axis(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("date_id").distinct().orderBy("date_id").collect()]


def make_folds(dates, cfg: Config) -> list[Fold]:
    """Validation blocks end the axis; each trains on what lies before it, less the embargo by position."""
    axis = sorted(set(int(d) for d in dates))
    k, v, e = cfg.n_folds, cfg.val_dates_per_fold, cfg.embargo_dates
    need = k * v + e + 1
    if len(axis) < need:
        raise ValueError(f"{k} folds of {v} dates with an embargo of {e} need {need} dates, there are {len(axis)}")
    folds = []
    for i in range(k):
        at = len(axis) - (k - i) * v
        train = axis[: at - e]
        if cfg.max_train_dates is not None:
            train = train[-cfg.max_train_dates :]
        folds.append(Fold(i, tuple(train), tuple(axis[at : at + v]), tuple(axis[at - e : at])))
        check_fold(folds[-1], e)
    for a, b in zip(folds, folds[1:]):
        if set(a.val_dates) & set(b.val_dates):
            raise LeakError("validation blocks overlap")
    return folds


def check_fold(fold: Fold, embargo: int) -> None:
    train, val, gap = fold.train_dates, fold.val_dates, fold.embargoed
    rising = lambda x: all(a < b for a, b in zip(x, x[1:]))
    if not train or not val:
        raise LeakError(f"fold {fold.index} has an empty side")
    if not (rising(train) and rising(val) and rising(gap)):
        raise LeakError(f"fold {fold.index}: dates must rise strictly")
    if set(train) & set(val) or set(gap) & (set(train) | set(val)):
        raise LeakError(f"fold {fold.index}: sides overlap")
    if not train[-1] < val[0] - embargo:
        raise LeakError(f"fold {fold.index}: training reaches into the embargo")
    if len(gap) != embargo or any(not train[-1] < d < val[0] for d in gap):
        raise LeakError(f"fold {fold.index}: {len(gap)} dates lie in the gap, expected {embargo}")


def inner_split(train_dates, fraction: float, embargo: int) -> tuple[list[int], list[int]]:
    """The last ``fraction`` of the training dates are held out, after an embargo by position."""
    axis = sorted(train_dates)
    held = max(1, round(fraction * len(axis)))
    left = axis[: max(0, len(axis) - held - embargo)]
    if not left:
        raise ValueError("no training date is left before the inner hold-out")
    return left, axis[len(axis) - held :]


def fold_dates(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """(fold, role, date_id): as many rows as dates in all folds."""
    rows = [(f.index, role, d) for f in folds for role, dates in (("train", f.train_dates), ("embargo", f.embargoed), ("validation", f.val_dates)) for d in dates]
    return spark.createDataFrame(rows, "fold int, role string, date_id int")


def describe(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    rows = [(f.index, len(f.train_dates), f.train_dates[0], f.train_dates[-1], len(f.embargoed), len(f.val_dates), f.val_dates[0], f.val_dates[-1]) for f in folds]
    return spark.createDataFrame(rows, "fold int, n_train int, train_first int, train_last int, n_embargoed int, n_val int, val_first int, val_last int")


def assign(df: DataFrame, folds: list[Fold], role: str | None = None) -> DataFrame:
    """Rows with their fold and role; a training row repeats once per fold. The fold table is bounded by dates x folds."""
    table = fold_dates(df.sparkSession, folds)
    if role:
        table = table.where(F.col("role") == role)
    return df.join(F.broadcast(table), "date_id")
