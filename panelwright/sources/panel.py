"""Panel sources and sinks: Parquet, CSV, JSON, and selection of dates and stocks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.config import Config
from panelwright.operators.seeding import stream
from panelwright.schema import KEY, PANEL, check_buckets, check_schema, nan_to_null, widen


class MissingSource(FileNotFoundError):
    pass


def every_kth_date(df: DataFrame, k: int) -> DataFrame:
    """Every k-th distinct date by position, not by value. The date table is small and semi-joined."""
    if k <= 1:
        return df
    nth = F.row_number().over(W.orderBy("date_id"))  # over distinct dates: a few hundred rows
    keep = df.select("date_id").distinct().withColumn("n", nth).where((F.col("n") - 1) % k == 0).select("date_id")
    return df.join(keep, "date_id", "left_semi")


def first_dates(df: DataFrame, n: int) -> DataFrame:
    return df.join(df.select("date_id").distinct().orderBy("date_id").limit(n), "date_id", "left_semi")


def read_panel(spark: SparkSession, path: str, cfg: Config, columns: list[str] | None = None, check: bool = True, double: bool = True) -> DataFrame:
    """Typed, pruned scan; NaN becomes NULL and floats become doubles here and nowhere else."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingSource(f"no panel at {path}: build it with `python -m panelwright.cli ingest --csv FILE --out {path}`") from e
    if columns is not None:
        df = df.select(*dict.fromkeys([*KEY, *columns]))
    if check:
        check_schema(df, df.columns)
        check_buckets(df, cfg.buckets)
    df = every_kth_date(df, cfg.date_stride)
    if cfg.stocks is not None:
        df = df.where(F.col("stock_id").isin(list(cfg.stocks)))
    df = nan_to_null(df)
    return widen(df) if double else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with all floats as doubles; row_id is a derived column and never parsed."""
    raw = T.StructType([T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.FloatType) else f.dataType) for f in PANEL] + [T.StructField("row_id", T.StringType())])
    return nan_to_null(spark.read.schema(raw).option("header", True).csv(path).drop("row_id"))


def downcast(df: DataFrame, target_type: str = "float") -> DataFrame:
    return df.select(*(F.col(f.name).cast(target_type if f.name == "target" else f.dataType).alias(f.name) for f in PANEL))


def write_panel(df: DataFrame, path: str) -> None:
    """Zstd Parquet, clustered by date so that date filters skip row groups."""
    df.repartitionByRange(F.col("date_id")).sortWithinPartitions(*["date_id", "seconds_in_bucket", "stock_id"]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def row_id():
    return F.concat_ws("_", "date_id", "seconds_in_bucket", "stock_id")


def time_id(cfg: Config):
    return (F.col("date_id").cast("int") * len(cfg.buckets) + F.floor(F.col("seconds_in_bucket") / cfg.bucket_step)).cast("int")


def block_sample(df: DataFrame, stocks: int = 40, blocks: int = 8, block: int = 8, label: str = "stocks") -> DataFrame:
    """A seeded sample of stocks, and evenly spaced blocks of consecutive dates. Ids are few; rows are semi-joined."""
    ids = sorted(r[0] for r in df.select("stock_id").distinct().collect())
    dates = sorted(r[0] for r in df.select("date_id").distinct().collect())
    pick = sorted(stream("sample", label).choice(ids, size=min(stocks, len(ids)), replace=False).tolist())
    last = max(0, len(dates) - block)
    starts = [round(i * last / max(1, blocks - 1)) for i in range(blocks)]
    days = sorted({d for s in starts for d in dates[s : s + block]})
    spark = df.sparkSession
    table = lambda n, x: F.broadcast(spark.createDataFrame([(int(v),) for v in x], f"{n} int"))
    return df.join(table("stock_id", pick), "stock_id", "left_semi").join(table("date_id", days), "date_id", "left_semi")


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_json(path: str, x: dict) -> None:
    Path(path).write_text(json.dumps(x, indent=2, sort_keys=True, default=str) + "\n")


def write_arm(oof: DataFrame, path: str) -> None:
    """Out-of-fold predictions of a run for another process: keyed rows, one folder for each model."""
    oof.write.mode("overwrite").partitionBy("model").option("compression", "zstd").parquet(path)


def read_arm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
