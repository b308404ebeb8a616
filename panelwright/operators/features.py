"""The 31 causal features: 14 of the row alone, 17 with memory.

Every feature is a column expression; columns that later ones reuse are staged so that Catalyst
computes them once. Missing inputs are NULL (``schema.nan_to_null``). A value that is not finite
although the row has a price book is an error, not a zero: the built columns raise where they meet
one, so no query can go on with it, and ``guard_counts`` says which features and how many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import BPS, Config
from panelwright.functions.columns import average_rank_pct, finite, or_zero, safe_ratio
from panelwright.operators.frames import days, instant, session

# The design matrix, in order.
ROW_FEATURES = [
    "imbalance_ratio",
    "imbalance_flag",
    "wap_minus_reference_bps",
    "spread_bps",
    "size_imbalance",
    "matched_share",
    "reference_minus_mid_bps",
    "near_minus_wap_bps",
    "far_minus_wap_bps",
    "near_is_missing",
    "far_is_missing",
    "book_is_missing",
    "seconds_frac",
    "seconds_frac_sq",
]
ROLLING = [
    "wap_ret_1b_bps",
    "wap_ret_6b_bps",
    "wap_vol_6b_bps",
    "imb_ratio_chg_1b",
    "size_imb_chg_1b",
    "matched_chg_1b",
    "spread_chg_1b_bps",
    "near_wap_chg_1b_bps",
]
CROSS_SECTIONAL = ["wap_ret_1b_cs", "wap_ret_6b_cs", "imb_ratio_cs_rank", "wap_ref_cs", "spread_cs_rank"]
STATE = ["stock_vol_20d_bps", "stock_vol_is_missing", "revealed_abs_bps", "revealed_is_missing"]
FAMILIES = {"rolling": ROLLING, "cross_sectional": CROSS_SECTIONAL, "state": STATE}
MEMORY_FEATURES = [*ROLLING, *CROSS_SECTIONAL, *STATE]
ALL_FEATURES = [*ROW_FEATURES, *MEMORY_FEATURES]
#: Columns that quantile bounds leave alone: flags (a bound on a rare flag deletes it) and bounded coordinates.
UNBOUNDED = ["imbalance_flag", "near_is_missing", "far_is_missing", "book_is_missing", "seconds_frac", "seconds_frac_sq"]
UNBOUNDED_MEMORY = ["stock_vol_is_missing", "revealed_is_missing", "imb_ratio_cs_rank", "spread_cs_rank"]

_RAW = "_raw_"


def _row_columns(cfg: Config) -> dict[str, Column]:
    c = F.col
    wap, bid, ask = c("wap"), c("bid_price"), c("ask_price")
    flag = lambda x: x.cast("double")
    second = c("seconds_in_bucket") / float(cfg.last_bucket)
    return {
        "imbalance_ratio": flag(c("imbalance_buy_sell_flag")) * safe_ratio(c("imbalance_size"), c("matched_size")),
        "imbalance_flag": flag(c("imbalance_buy_sell_flag")),
        "wap_minus_reference_bps": (wap - c("reference_price")) * BPS,
        "spread_bps": safe_ratio(ask - bid, wap) * BPS,
        "size_imbalance": safe_ratio(c("bid_size") - c("ask_size"), c("bid_size") + c("ask_size")),
        "matched_share": safe_ratio(c("imbalance_size"), c("imbalance_size") + c("matched_size")),
        "reference_minus_mid_bps": (c("reference_price") - 0.5 * (bid + ask)) * BPS,
        "near_minus_wap_bps": F.when(c("near_price").isNull(), 0.0).otherwise((c("near_price") - wap) * BPS),
        "far_minus_wap_bps": F.when(c("far_price").isNull(), 0.0).otherwise((c("far_price") - wap) * BPS),
        "near_is_missing": flag(c("near_price").isNull()),
        "far_is_missing": flag(c("far_price").isNull()),
        "book_is_missing": flag(wap.isNull()),
        "seconds_frac": second,
        "seconds_frac_sq": second * second,
    }


def _with_raw_rows(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumns({_RAW + k: v for k, v in _row_columns(cfg).items()})


def _day_scale(df: DataFrame, trailing: int = 20) -> DataFrame:
    """One row per stock and date: mean absolute target over the ``trailing`` observed dates before it."""
    daily = df.groupBy("stock_id", "date_id").agg(F.avg(F.abs("target")).alias("_scale"))
    return daily.select("stock_id", "date_id", F.avg("_scale").over(days().rowsBetween(-trailing, -1)).alias(_RAW + "stock_vol_20d_bps"))


def _with_raw_memory(df: DataFrame, fixed_lag: int = 6) -> DataFrame:
    if "revealed_target" not in df.columns:
        raise ValueError("revealed_target is missing: call reveal.add_revealed_target first")
    before = lambda x, k=1: F.lag(x, k).over(session())
    change = lambda x: F.col(x) - before(F.col(x))
    wap, matched = F.col("wap"), F.col("matched_size")
    r = _RAW
    df = df.join(_day_scale(df), ["stock_id", "date_id"], "left")
    df = df.withColumns(
        {
            "wap_ret_1b_bps": or_zero((wap / before(wap) - 1) * BPS),
            "wap_ret_6b_bps": or_zero((wap / before(wap, fixed_lag) - 1) * BPS),
            "_near_gap": (F.col("near_price") - wap) * BPS,
            "imb_ratio_chg_1b": or_zero(change(r + "imbalance_ratio")),
            "size_imb_chg_1b": or_zero(change(r + "size_imbalance")),
            "matched_chg_1b": or_zero(safe_ratio(matched - before(matched), before(matched))),
            "spread_chg_1b_bps": or_zero(change(r + "spread_bps")),
        }
    )
    df = df.withColumns(
        {
            "wap_vol_6b_bps": or_zero(F.stddev_samp("wap_ret_1b_bps").over(session().rowsBetween(-5, 0))),
            "near_wap_chg_1b_bps": or_zero(change("_near_gap")),
        }
    ).drop("_near_gap")
    df = df.withColumns(
        {
            # Returns are zero-filled before the cross-sectional mean, the reference gap only after it.
            "wap_ret_1b_cs": F.col("wap_ret_1b_bps") - F.avg("wap_ret_1b_bps").over(instant()),
            "wap_ret_6b_cs": F.col("wap_ret_6b_bps") - F.avg("wap_ret_6b_bps").over(instant()),
            "imb_ratio_cs_rank": or_zero(average_rank_pct(F.col(r + "imbalance_ratio"), instant()) - 0.5),
            "wap_ref_cs": or_zero(F.col(r + "wap_minus_reference_bps") - F.avg(r + "wap_minus_reference_bps").over(instant())),
            "spread_cs_rank": or_zero(average_rank_pct(F.col(r + "spread_bps"), instant()) - 0.5),
            "stock_vol_20d_bps": or_zero(F.col(r + "stock_vol_20d_bps")),
            "stock_vol_is_missing": F.col(r + "stock_vol_20d_bps").isNull().cast("double"),
            "revealed_abs_bps": or_zero(F.abs("revealed_target")),
            "revealed_is_missing": F.col("revealed_target").isNull().cast("double"),
        }
    )
    return df.drop(r + "stock_vol_20d_bps")


def _refused(name: str) -> Column:
    return F.raise_error(F.lit(f"feature {name} is not finite on a row with a price book")).cast("double")


def _finish(df: DataFrame, memory: list[str] = ()) -> DataFrame:
    """Zeros for the missing, on rows without a book only; an error for what is not finite on others. Part of the projection, no extra pass."""
    book = F.col("wap").isNotNull()
    bad = lambda c: ~F.coalesce(finite(F.col(c)), F.lit(False))
    made = {k: F.when(book & bad(_RAW + k), _refused(k)).otherwise(or_zero(F.col(_RAW + k))) for k in ROW_FEATURES}
    made |= {k: F.when(book & bad(k), _refused(k)).otherwise(F.col(k)) for k in memory}
    return df.withColumns(made).drop(*(_RAW + k for k in ROW_FEATURES))


def build_row_features(df: DataFrame, cfg: Config) -> DataFrame:
    """``df`` with the 14 row features: projections only."""
    return _finish(_with_raw_rows(df, cfg))


def build_memory_features(df: DataFrame, cfg: Config) -> DataFrame:
    """``df`` with all 31 features; needs revealed_target.

    Two exchanges serve the windows (by session, by instant). ``df.repartition("date_id")`` before
    serves both with one, at the price of no more tasks than dates; that pays only on small panels.
    """
    return _finish(_with_raw_memory(_with_raw_rows(df, cfg)), MEMORY_FEATURES)


def guard_counts(df: DataFrame, cfg: Config) -> DataFrame:
    """(feature, bad): rows with a price book whose row feature is not finite; one aggregate, nothing raised."""
    raw = _with_raw_rows(df, cfg)
    bad = raw.agg(*(F.count_if(F.col("wap").isNotNull() & ~F.coalesce(finite(F.col(_RAW + k)), F.lit(False))).alias(k) for k in ROW_FEATURES))
    return bad.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("bad")) for k in ROW_FEATURES))).alias("p")).select("p.*")


def check_features(df: DataFrame, cfg: Config) -> None:
    """Raise beforehand, with all counts, what the built columns would raise on the first such row."""
    bad = {r["feature"]: r["bad"] for r in guard_counts(df, cfg).where("bad > 0").collect()}
    if bad:
        raise ValueError(f"features that are not finite on rows with a price book: {bad}")
