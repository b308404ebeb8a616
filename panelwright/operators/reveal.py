"""What is known of the target: the previous date's value, and the leg that all stocks share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import BPS, Config
from panelwright.operators.frames import same_bucket, session


def add_revealed_target(df: DataFrame, name: str = "revealed_target") -> DataFrame:
    """The target of the same stock and bucket on date_id - 1, null across gaps: a range frame, one exchange, no join."""
    return df.withColumn(name, F.max("target").over(same_bucket().rangeBetween(-1, -1)))


def add_revealed_target_by_join(df: DataFrame, name: str = "revealed_target") -> DataFrame:
    """The same by a self-join on the shifted date."""
    keys = ["stock_id", "date_id", "seconds_in_bucket"]
    before = df.select("stock_id", (F.col("date_id") + 1).alias("date_id"), "seconds_in_bucket", F.col("target").alias(name))
    return df.join(before.groupBy(*keys).agg(F.max(name).alias(name)), keys, "left")


def index_leg(df: DataFrame, cfg: Config, lag: int | None = None) -> DataFrame:
    """Rows with ``ret`` (the stock's own forward return) and ``leg`` = ret - target, which the target's definition makes common to an instant.

    ``lag`` other than the configured horizon gives the deliberately wrong leg of the spread check.
    """
    k = cfg.horizon if lag is None else lag
    ret = (F.lead("wap", k).over(session()) / F.col("wap") - 1) * BPS
    out = df.withColumn("ret", ret).withColumn("leg", F.col("ret") - F.col("target"))
    return out.where((F.col("seconds_in_bucket") <= cfg.last_bucket - cfg.horizon * cfg.bucket_step) & F.col("leg").isNotNull())


def leg_spread(legs: DataFrame) -> DataFrame:
    """Sample standard deviation of the leg at every instant, with its simple mean and that of the returns."""
    return legs.groupBy("date_id", "seconds_in_bucket").agg(F.count("*").alias("n"), F.stddev_samp("leg").alias("leg_std"), F.avg("leg").alias("leg_mean"), F.avg("ret").alias("ret_mean"), F.avg("target").alias("target_mean"))


def leg_summary(df: DataFrame, cfg: Config, wrong: tuple[int, ...], dates: int = 40) -> DataFrame:
    """One row on the first ``dates`` dates: spread of the leg at the right lag, how many times larger it is at wrong ones, and what the leg is against the equal-weighted return."""
    from panelwright.sources.panel import first_dates  # not at import: sources build on operators

    few = first_dates(df, dates)
    spread = leg_spread(index_leg(few, cfg)).where("n > 1")
    out = spread.agg(
        F.count("*").alias("instants"),
        F.median("leg_std").alias("median_std"),
        F.max("leg_std").alias("max_std"),
        F.corr("leg_mean", "ret_mean").alias("corr_equal_weights"),
        F.avg(F.abs(F.col("leg_mean") - F.col("ret_mean"))).alias("mean_gap_equal_weights"),
    )
    for k in wrong:
        off = leg_spread(index_leg(few, cfg, k)).where("n > 1").agg(F.median("leg_std").alias("m"))
        out = out.crossJoin(off).withColumnRenamed("m", f"median_std_lag_{k}")  # one row each
        out = out.withColumn(f"ratio_lag_{k}", F.when(F.col("median_std") > 0, F.col(f"median_std_lag_{k}") / F.col("median_std")))
    return out
