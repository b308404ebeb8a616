"""A made panel of any size with the quirks of a real one, as column expressions: the same rows whatever the partitioning.

Prices are random walks around 1; the index is a weighted mean over all stocks with unequal weights,
and the target is the stock's forward return less the index's, simulated beyond the last bucket.
About one session in a hundred is missing whole, one stock enters late, two sessions have no price
book, crossing prices exist late in a session only and have outliers, and some sizes are zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.config import BPS, Config
from panelwright.operators.frames import instant, session
from panelwright.schema import PANEL


def uniform(*key: Column | str) -> Column:
    """In (0, 1), a function of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def normal(name: str, *key: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(F.lit(name + "/r"), *key))) * F.cos(2 * math.pi * uniform(F.lit(name + "/a"), *key))


def made_panel(spark: SparkSession, cfg: Config, stocks: int = 200, dates: int = 481, label: str = "panel") -> DataFrame:
    """Two exchanges (by session, by instant), like the features that are built on it."""
    c, key = F.col, [F.lit(label), "stock_id", "date_id", "seconds_in_bucket"]
    day = [F.lit(label), "stock_id", "date_id"]
    ids = spark.range(stocks * dates).select((c("id") % stocks).cast("short").alias("stock_id"), F.floor(c("id") / stocks).cast("short").alias("date_id"))
    late = min(dates - 1, dates // 5)
    ids = ids.where((uniform(F.lit("gone"), *day) > 0.01) & ((c("stock_id") != stocks - 1) | (c("date_id") >= late)))
    beyond = cfg.last_bucket + cfg.horizon * cfg.bucket_step
    df = ids.withColumn("seconds_in_bucket", F.explode(F.sequence(F.lit(0), F.lit(beyond), F.lit(cfg.bucket_step)).cast("array<smallint>")))
    level = F.exp(0.5 * normal("level", F.lit(label), "stock_id"))
    step = normal("step", *key) * 2e-4 * level
    df = df.withColumn("_log", F.sum(step).over(session().rowsBetween(-(1 << 63), 0)))
    df = df.withColumn("wap", F.round(F.exp("_log"), 6)).withColumn("_w", level * level)
    df = df.withColumn("_index", F.sum(c("_w") * c("wap")).over(instant()) / F.sum("_w").over(instant()))
    ahead = lambda x: F.lead(x, cfg.horizon).over(session()) / c(x) - 1
    df = df.withColumn("target", F.round(BPS * (ahead("wap") - ahead("_index")), 6)).where(c("seconds_in_bucket") <= cfg.last_bucket)
    size = lambda name, zero: F.when(uniform(F.lit(name + "/zero"), *key) < zero, 0.0).otherwise(F.round(F.exp(10 + 1.5 * normal(name, *key)), 2))
    half = F.round(1e-4 * (0.5 + uniform(F.lit("spread"), *key)), 6)
    crossing = c("seconds_in_bucket") >= cfg.cross_price_first
    far = F.when(uniform(F.lit("far/out"), *key) < 1e-4, 400 * uniform(F.lit("far/size"), *key)).otherwise(c("wap") * (1 + 5e-4 * normal("far", *key)))
    book = ~((c("date_id") == dates // 3) & c("stock_id").isin(1, 2))
    seen = lambda x: F.when(book, x)
    df = df.withColumns(
        {
            "imbalance_size": seen(size("imbalance", 0.02)),
            "imbalance_buy_sell_flag": F.when(book, F.floor(3 * uniform(F.lit("flag"), *key)) - 1).otherwise(0).cast("byte"),
            "reference_price": seen(F.round(c("wap") * (1 + 1e-4 * normal("reference", *key)), 6)),
            "matched_size": seen(size("matched", 0.0)),
            "far_price": seen(F.when(crossing & (uniform(F.lit("far/none"), *key) > 0.045), F.round(far, 6))),
            "near_price": seen(F.when(crossing, F.round(c("wap") * (1 + 2e-4 * normal("near", *key)), 6))),
            "bid_price": seen(F.round(c("wap") - half, 6)),
            "bid_size": size("bid", 0.001),
            "ask_price": seen(F.round(c("wap") + half, 6)),
            "ask_size": size("ask", 0.001),
            "target": F.when(book | (uniform(F.lit("target/none"), *key) > 0.5), c("target")),
            "time_id": (c("date_id").cast("int") * len(cfg.buckets) + F.floor(c("seconds_in_bucket") / cfg.bucket_step)).cast("int"),
        }
    ).withColumn("wap", seen(c("wap")))
    return df.select(*(c(f.name).cast(f.dataType).alias(f.name) if f.name != "target" else c("target") for f in PANEL))
