"""A panel derived from the lineitem table, with empty books, partial sessions and missing prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.config import PRESETS, Config
from panelwright.operators.frames import instant, session

CFG: Config = PRESETS["DERIVED"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per stock, date and bucket; discounts and taxes as integers, so that sums are exact."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    d = F.col("l_shipdate")
    keyed = li.select(
        (F.col("l_suppkey") % 10).alias("stock_id"),
        ((F.year(d) - 1995) * 12 + F.month(d) - 1).cast("long").alias("date_id"),
        (F.least(F.floor((F.dayofmonth(d) - 1) / 3.0), F.lit(9)) * 10).cast("long").alias("seconds_in_bucket"),
        "l_quantity",
        "l_returnflag",
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
    )
    size = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0))
    return keyed.groupBy("stock_id", "date_id", "seconds_in_bucket").agg(size("R").alias("bid_size"), size("A").alias("ask_size"), size("N").alias("matched_size"), (F.sum("disc") / F.count("*")).alias("disc"), (F.sum("tax") / F.count("*")).alias("tax"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its target: the forward return less its mean over the instant."""
    c = F.col
    df = cells(spark, sf_dir)
    depth = c("bid_size") + c("ask_size")
    df = df.withColumns({"bid_price": 1 - c("disc") / 1e4, "ask_price": 1 + c("tax") / 1e4})
    df = df.withColumn("wap", F.when(depth > 0, (c("bid_price") * c("ask_size") + c("ask_price") * c("bid_size")) / F.when(depth > 0, depth)))
    late, book = c("seconds_in_bucket") >= CFG.cross_price_first, c("wap").isNotNull()
    df = df.select(
        "stock_id",
        "date_id",
        "seconds_in_bucket",
        F.abs(c("bid_size") - c("ask_size")).alias("imbalance_size"),
        F.signum(c("bid_size") - c("ask_size")).cast("long").alias("imbalance_buy_sell_flag"),
        F.when(book, 1 + (c("tax") - 4) / 1e4).alias("reference_price"),
        "matched_size",
        F.when(book & late & (c("matched_size") > 0), 1 + (c("disc") - 5) / 5e3).alias("far_price"),
        F.when(book & late, (c("bid_price") + c("ask_price")) / 2).alias("near_price"),
        F.when(book, c("bid_price")).alias("bid_price"),
        "bid_size",
        F.when(book, c("ask_price")).alias("ask_price"),
        "ask_size",
        "wap",
    )
    df = df.withColumn("_ret", 1e4 * (F.lead("wap", CFG.horizon).over(session()) / c("wap") - 1))
    df = df.withColumn("target", c("_ret") - F.avg("_ret").over(instant())).drop("_ret")
    return df.withColumn("time_id", (c("date_id") * len(CFG.buckets) + F.floor(c("seconds_in_bucket") / CFG.bucket_step)).cast("long"))
