"""The panel's schema, its checks, and the one place where NaN becomes NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["stock_id", "date_id", "seconds_in_bucket"]
PRICES = ["reference_price", "far_price", "near_price", "bid_price", "ask_price", "wap"]
SIZES = ["imbalance_size", "matched_size", "bid_size", "ask_size"]
CROSS_PRICES = ["far_price", "near_price"]

PANEL = T.StructType(
    [
        *(T.StructField(k, T.ShortType(), False) for k in KEY),
        T.StructField("imbalance_size", T.FloatType()),
        T.StructField("imbalance_buy_sell_flag", T.ByteType(), False),
        T.StructField("reference_price", T.FloatType()),
        T.StructField("matched_size", T.FloatType()),
        T.StructField("far_price", T.FloatType()),
        T.StructField("near_price", T.FloatType()),
        T.StructField("bid_price", T.FloatType()),
        T.StructField("bid_size", T.FloatType(), False),
        T.StructField("ask_price", T.FloatType()),
        T.StructField("ask_size", T.FloatType(), False),
        T.StructField("wap", T.FloatType()),
        T.StructField("target", T.FloatType()),
        T.StructField("time_id", T.IntegerType(), False),
    ]
)


class SchemaError(ValueError):
    pass


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL differ in Spark; after this only NULL marks a missing value."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def widen(df: DataFrame) -> DataFrame:
    """Storage is float32, arithmetic is double."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.FloatType)})


def check_schema(df: DataFrame, columns: list[str] | None = None) -> None:
    """Types must be the panel's; the target may be any floating type."""
    wrong = []
    for f in PANEL:
        if columns is not None and f.name not in columns:
            continue
        if f.name not in df.columns:
            wrong.append(f"{f.name} is missing")
            continue
        have = df.schema[f.name].dataType
        ok = isinstance(have, (T.FloatType, T.DoubleType)) if f.name == "target" else have == f.dataType
        if not ok:
            wrong.append(f"{f.name} is {have.simpleString()}, expected {f.dataType.simpleString()}")
    if wrong:
        raise SchemaError("; ".join(wrong))


def check_buckets(df: DataFrame, buckets: list[int]) -> None:
    """The observed buckets must be exactly the grid: one aggregate of at most a grid's worth of rows beyond it."""
    seen = {r[0] for r in df.select("seconds_in_bucket").distinct().limit(len(buckets) + 1).collect()}
    if seen != set(buckets):
        raise SchemaError(f"buckets {sorted(seen)} are not the grid {buckets[0]}..{buckets[-1]}")


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_keys(df: DataFrame) -> None:
    """The key is unique: lags, ranks and the revealed target mean nothing otherwise."""
    some = duplicate_keys(df).limit(5).collect()
    if some:
        raise SchemaError("repeated keys, such as " + ", ".join(str(tuple(r)) for r in some))
