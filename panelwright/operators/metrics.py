"""Mean absolute error in basis points, and tables of it. Predictions are in long form, keyed by the panel's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.columns import finite


class MetricError(ValueError):
    pass


def abs_error(y: str = "target", p: str = "prediction") -> Column:
    return F.abs(F.col(y) - F.col(p))


def mae(df: DataFrame, y: str = "target", p: str = "prediction") -> float:
    """Over labelled rows; refuses no labels, and a prediction that is not finite on a labelled row."""
    bad = ~F.coalesce(finite(F.col(p)), F.lit(False))
    r = df.where(F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.avg(F.when(~bad, abs_error(y, p))).alias("mae")).first()
    if not r["n"]:
        raise MetricError("no labelled row")
    if r["bad"]:
        raise MetricError(f"{r['bad']} labelled rows have no finite prediction")
    return r["mae"]


def improvement(zero: Column, model: Column) -> tuple[Column, Column]:
    """(bps, percent) over predicting zero; null where zero is unknown."""
    return zero - model, F.when(zero != 0, 100 * (zero - model) / zero)


def breakdown(df: DataFrame, by: str, y: str = "target", p: str = "prediction") -> DataFrame:
    """Per group: rows, MAE, MAE of zero, improvement. Rows without a finite prediction are left out (unlike ``mae``)."""
    rows = df.where(F.col(y).isNotNull() & F.coalesce(finite(F.col(p)), F.lit(False)))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(abs_error(y, p)).alias("mae"), F.avg(F.abs(y)).alias("mae_zero"))
    bps, pct = improvement(F.col("mae_zero"), F.col("mae"))
    return g.withColumns({"improvement_bps": bps, "improvement_pct": pct})


def consistency(groups: DataFrame) -> DataFrame:
    i = F.col("improvement_bps")
    return groups.agg(F.avg(i).alias("mean_improvement_bps"), F.avg(F.when(i > 0, 1.0).otherwise(0.0)).alias("share_better"), F.min(i).alias("worst_bps"), F.max(i).alias("best_bps"))


def scorecard(oof: DataFrame) -> DataFrame:
    """(model, mae_bps, vs zero, coverage) over the long out-of-fold table with target; best first when sorted by mae_bps."""
    labelled = F.col("target").isNotNull()
    ok = labelled & F.coalesce(finite(F.col("prediction")), F.lit(False))
    g = oof.groupBy("model").agg(F.avg(F.when(ok, abs_error())).alias("mae_bps"), F.avg(F.when(labelled, F.abs("target"))).alias("zero_bps"), (F.count_if(ok) / F.count_if(labelled)).alias("coverage"))
    bps, pct = improvement(F.col("zero_bps"), F.col("mae_bps"))
    return g.withColumns({"vs_zero_bps": bps, "vs_zero_pct": pct}).drop("zero_bps")


def per_fold(oof: DataFrame) -> DataFrame:
    return oof.where("target is not null").groupBy("model", "fold").agg(F.avg(abs_error()).alias("mae_bps"))


def fold_table(fold_mae: DataFrame, folds: list[int]) -> DataFrame:
    """Models by folds with mean, population standard deviation of the folds, and mean improvement on model zero.

    ``std_with_mean`` is the deviation that also counts the mean as one more value, sqrt(SS / (k + 1)).
    """
    wide = fold_mae.groupBy("model").pivot("fold", folds).agg(F.first("mae_bps"))
    names = [f"fold_{k}" for k in folds]
    wide = wide.select("model", *(F.col(f"`{k}`").alias(n) for k, n in zip(folds, names)))
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    wide = wide.withColumn("mean", mean)
    ss = sum(((F.col(n) - F.col("mean")) * (F.col(n) - F.col("mean")) for n in names), F.lit(0.0))
    zero = fold_mae.where("model = 'zero'").agg(F.avg("mae_bps").alias("zero_mean"))  # one row
    out = wide.withColumns({"std": F.sqrt(ss / len(names)), "std_with_mean": F.sqrt(ss / (len(names) + 1))})
    return out.crossJoin(zero).withColumn("mean_vs_zero", F.col("zero_mean") - F.col("mean")).drop("zero_mean")


def paired(fold_mae: DataFrame, headline: str) -> DataFrame:
    """Every other model's fold MAE less the headline's."""
    own = fold_mae.where(F.col("model") == headline).select("fold", F.col("mae_bps").alias("headline_bps"))
    return fold_mae.where(F.col("model") != headline).join(own, "fold").select("model", "fold", (F.col("mae_bps") - F.col("headline_bps")).alias("difference_bps"))


def scored_by_all(oof: DataFrame, keys: list[str], models: int) -> DataFrame:
    """Keys that every one of ``models`` models predicts."""
    ok = F.coalesce(finite(F.col("prediction")), F.lit(False))
    return oof.where(ok).groupBy(*keys).agg(F.countDistinct("model").alias("m")).where(F.col("m") == models).select(*keys)


def check_scored(oof: DataFrame) -> None:
    """Every model must predict every labelled row it was asked for: one aggregate over the long table."""
    bad = ~F.coalesce(finite(F.col("prediction")), F.lit(False))
    groups = oof.where("target is not null").groupBy("model", "fold").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    some = groups.where("bad > 0").orderBy("model", "fold").limit(10).collect()
    if some:
        raise MetricError("; ".join(f"{r['model']}, fold {r['fold']}: {r['bad']} of {r['n']} labelled rows have no finite prediction" for r in some))


def on_common_rows(oof: DataFrame, keys: list[str]) -> DataFrame:
    """The long table on the rows that all its models score, so that models are compared on the same ones."""
    n = oof.select("model").distinct().count()
    return oof.join(scored_by_all(oof, keys, n), keys, "left_semi")


def reconcile(a: DataFrame, b: DataFrame, columns: list[str]) -> dict[str, int]:
    """Rows of either side that the other lacks, duplicates included."""
    a, b = a.select(*columns), b.select(*columns)
    return {"only_left": a.exceptAll(b).count(), "only_right": b.exceptAll(a).count()}


def replica_check(now: DataFrame, before: DataFrame) -> DataFrame:
    """This run's MAE beside a saved report's, by model."""
    return now.select("model", F.col("mae_bps").alias("now_bps")).join(before.select("model", F.col("mae_bps").alias("before_bps")), "model").withColumn("difference_bps", F.col("now_bps") - F.col("before_bps"))
