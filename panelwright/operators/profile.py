"""What a panel holds: coverage, missing values, precision, target statistics, dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import Config
from panelwright.functions.columns import float32_error, float32_relative_error, sample_excess_kurtosis, sample_skewness

#: The quantiles of the target's description.
QUANTILES = [0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
TARGET_ROW_TOLERANCE, TARGET_MEAN_TOLERANCE = 1e-3, 1e-6


def session_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("stock_id", "date_id").agg(F.count("*").alias("n_rows"))


def coverage(df: DataFrame, cfg: Config) -> DataFrame:
    """One row, from one scan: counts roll up from sessions."""
    s = session_counts(df)
    per_stock = s.groupBy("stock_id").agg(F.sum("n_rows").alias("n"))
    per_date = s.groupBy("date_id").agg(F.sum("n_rows").alias("n"))
    whole = s.agg(
        F.sum("n_rows").alias("rows"),
        F.countDistinct("stock_id").alias("stocks"),
        F.countDistinct("date_id").alias("dates"),
        F.min("date_id").alias("first_date"),
        F.max("date_id").alias("last_date"),
        F.count("*").alias("sessions"),
        F.count_if(F.col("n_rows") != len(cfg.buckets)).alias("partial_sessions"),
    )
    whole = whole.withColumn("possible_sessions", F.col("stocks") * F.col("dates")).withColumn("missing_sessions", F.col("possible_sessions") - F.col("sessions"))
    stats = lambda d, k: d.agg(F.min("n").alias(f"min_rows_{k}"), F.max("n").alias(f"max_rows_{k}"), F.median("n").alias(f"median_rows_{k}"))
    return whole.crossJoin(stats(per_stock, "stock")).crossJoin(stats(per_date, "date"))  # one row each


def thinnest_stocks(df: DataFrame, k: int = 5) -> DataFrame:
    return df.groupBy("stock_id").agg(F.count("*").alias("n_rows")).orderBy("n_rows", "stock_id").limit(k)


def partial_session_sizes(df: DataFrame, cfg: Config) -> DataFrame:
    return session_counts(df).where(F.col("n_rows") != len(cfg.buckets)).groupBy("n_rows").agg(F.count("*").alias("sessions"))


def date_gaps(df: DataFrame) -> DataFrame:
    """How many dates are missing between the first and the last."""
    d = df.agg(F.min("date_id").alias("first"), F.max("date_id").alias("last"), F.countDistinct("date_id").alias("n"))
    return d.select((F.col("last") - F.col("first") + 1 - F.col("n")).alias("missing_dates"))


def invariants(df: DataFrame, cfg: Config) -> DataFrame:
    """One row, one aggregate over sessions: rows off the grid, rows whose time_id is not the derived one, sessions whose time_id does not rise with the bucket, repeated keys."""
    derived = F.col("date_id") * len(cfg.buckets) + F.floor(F.col("seconds_in_bucket") / cfg.bucket_step)
    off = (F.col("seconds_in_bucket") % cfg.bucket_step != 0) | (F.col("seconds_in_bucket") < 0) | (F.col("seconds_in_bucket") > cfg.last_bucket)
    pair = F.struct("seconds_in_bucket", "time_id")
    by_bucket, by_time = F.array_sort(F.collect_list(pair)), F.array_sort(F.collect_list(F.struct("time_id", "seconds_in_bucket")))  # a session's few buckets
    s = df.groupBy("stock_id", "date_id").agg(
        F.count("*").alias("n"),
        F.count_if(off).alias("off_grid"),
        F.count_if(F.col("time_id") != derived).alias("wrong_time_id"),
        F.countDistinct("seconds_in_bucket").alias("buckets"),
        (F.transform(by_bucket, lambda x: x["time_id"]) != F.transform(by_time, lambda x: x["time_id"])).alias("unordered"),
    )
    return s.agg(F.sum("off_grid").alias("off_grid"), F.sum("wrong_time_id").alias("wrong_time_id"), F.count_if("unordered").alias("unordered_sessions"), F.sum(F.col("n") - F.col("buckets")).alias("repeated_keys"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: column, nulls; one aggregate."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns)))
    return one.select(pairs.alias("p")).select("p.*")


def null_rate_by_bucket(df: DataFrame) -> DataFrame:
    rate = lambda c: F.count_if(F.col(c).isNull()) / F.count("*")
    return df.groupBy("seconds_in_bucket").agg(F.count("*").alias("n_rows"), rate("far_price").alias("far_null_rate"), rate("near_price").alias("near_null_rate"))


def null_rate_before_after(df: DataFrame, cfg: Config) -> DataFrame:
    early = F.col("seconds_in_bucket") < cfg.cross_price_first
    return null_rate_by_bucket(df).groupBy(early.alias("before_crossing")).agg(*(f(f"{c}_null_rate").alias(f"{n}_{c}") for c in ("far", "near") for n, f in (("min", F.min), ("max", F.max))))


def precision_probe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Largest float32 round-trip error per column, absolute and relative; one aggregate."""
    one = df.agg(*(F.max(f(F.col(c).cast("double"))).alias(f"{n}_{c}") for c in columns for n, f in (("abs", float32_error), ("rel", float32_relative_error))))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"abs_{c}").alias("max_abs_error"), F.col(f"rel_{c}").alias("max_rel_error")) for c in columns))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def float32_gate(df: DataFrame) -> str:
    """Type the target may be stored in: float if neither a row nor the mean absolute target moves beyond tolerance."""
    t = F.col("target").cast("double")
    small = t.cast("float").cast("double")
    r = df.agg(F.max(F.abs(t - small)).alias("row"), F.abs(F.avg(F.abs(t)) - F.avg(F.abs(small))).alias("mean")).first()
    return "float" if (r["row"] or 0) <= TARGET_ROW_TOLERANCE and (r["mean"] or 0) <= TARGET_MEAN_TOLERANCE else "double"


def describe_target(df: DataFrame) -> DataFrame:
    t = F.col("target")
    return df.agg(
        F.count(t).alias("n"),
        F.avg(t).alias("mean"),
        F.median(t).alias("median"),
        F.stddev_pop(t).alias("std"),
        F.avg(F.abs(t)).alias("mean_abs"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        sample_skewness(t).alias("skew"),
        sample_excess_kurtosis(t).alias("excess_kurtosis"),
    )


def target_quantiles(df: DataFrame, quantiles: list[float] = QUANTILES, approximate: bool = False) -> DataFrame:
    """Exact with linear interpolation; the approximate form bounds memory on huge tables and gives data points."""
    q = F.array(*map(F.lit, quantiles))
    v = F.percentile_approx("target", q, 100_000) if approximate else F.percentile("target", q)
    return df.agg(v.alias("v")).select(F.explode(F.arrays_zip(q.alias("quantile"), F.col("v").alias("value"))).alias("p")).select("p.*")


def carry_autocorrelation(df: DataFrame) -> DataFrame:
    """Correlation of the target with the revealed one by bucket."""
    both = df.where("target is not null and revealed_target is not null")
    return both.groupBy("seconds_in_bucket").agg(F.count("*").alias("n"), F.corr("target", "revealed_target").alias("rho"))


def carry_autocorrelation_summary(df: DataFrame) -> DataFrame:
    both = df.where("target is not null and revealed_target is not null")
    whole = both.agg(F.count("*").alias("n"), F.corr("target", "revealed_target").alias("rho"))
    return whole.crossJoin(carry_autocorrelation(df).agg(F.min("rho").alias("min_rho"), F.median("rho").alias("median_rho"), F.max("rho").alias("max_rho")))


def stock_dispersion(df: DataFrame) -> DataFrame:
    return df.where("target is not null").groupBy("stock_id").agg(F.avg(F.abs("target")).alias("mean_abs"))


def stock_dispersion_summary(df: DataFrame) -> DataFrame:
    d = stock_dispersion(df)
    out = d.agg(F.min("mean_abs").alias("min_mean_abs"), F.min_by("stock_id", "mean_abs").alias("calmest"), F.max("mean_abs").alias("max_mean_abs"), F.max_by("stock_id", "mean_abs").alias("wildest"), F.median("mean_abs").alias("median_mean_abs"))
    return out.withColumn("ratio", F.col("max_mean_abs") / F.col("min_mean_abs"))


def empty_books(df: DataFrame) -> DataFrame:
    """Sessions with rows that lack a price book: such rows, and what else they lack."""
    e = df.where("wap is null")
    miss = lambda c: F.count_if(F.col(c).isNull()).cast("long")
    return e.groupBy("stock_id", "date_id").agg(
        F.count("*").alias("n_rows"),
        *(miss(c).alias(f"null_{c}") for c in ("reference_price", "bid_price", "ask_price", "near_price", "far_price", "target")),
        *(F.count_if(F.col("imbalance_buy_sell_flag") == v).alias(f"flag_{n}") for n, v in (("sell", -1), ("none", 0), ("buy", 1))),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, target sum, first and last key, and a hash sum that does not depend on order."""
    key = F.struct("date_id", "seconds_in_bucket", "stock_id")
    return df.agg(F.count("*").alias("n"), F.sum("target").alias("target_sum"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash_sum"))
