"""Registered queries of the panel operators over the derived panel, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.columns import clip, or_zero
from panelwright.operators import blend, cv, features, folds, integrity, metrics, mlp, models, profile, reveal
from panelwright.operators.features import ALL_FEATURES, ROW_FEATURES, UNBOUNDED
from panelwright.plans import oracle as q
from panelwright.schema import KEY
from panelwright.schema import duplicate_keys as duplicate_keys_of
from panelwright.sources import panel as source
from panelwright.sources.derived import CFG, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def keyed(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return rounded(df.select(*KEY, *columns), columns, digits)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reveal.add_revealed_target(panel(spark, sf_dir).where("target is not null"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_row_features(labelled(spark, sf_dir), CFG)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_memory_features(labelled(spark, sf_dir), CFG)


K = ", ".join(KEY)
#: Prices are decimals by construction: twelve places keep clear of ties.
VALUES = ["imbalance_size", "reference_price", "matched_size", "far_price", "near_price", "bid_price", "bid_size", "ask_price", "ask_size", "wap", "target"]


@register("panel_scan", q.query(q.PANEL, f"SELECT {K}, imbalance_buy_sell_flag, time_id, {q.rounded(VALUES[:-1], 13)}, {q.rounded(VALUES[-1:])} FROM panel"))
def panel_scan(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select(*KEY, "imbalance_buy_sell_flag", "time_id", *VALUES).withColumn("target", F.round("target", 6)), VALUES[:-1], 13)


@register("panel_stride_filter", q.query(q.PANEL, f"SELECT {K}, round(wap, 12) AS wap FROM panel WHERE stock_id IN (1, 3, 5) AND date_id IN (SELECT date_id FROM (SELECT date_id, row_number() OVER (ORDER BY date_id) AS n FROM (SELECT DISTINCT date_id FROM panel)) WHERE (n - 1) % 4 = 0)"))
def panel_stride_filter(spark, sf_dir):
    return keyed(source.every_kth_date(panel(spark, sf_dir), 4).where(F.col("stock_id").isin(1, 3, 5)), ["wap"], 12)


@register("first_dates", q.query(q.PANEL, f"SELECT {K}, round(wap, 12) AS wap FROM panel WHERE date_id IN (SELECT DISTINCT date_id FROM panel ORDER BY date_id LIMIT 10)"))
def first_dates(spark, sf_dir):
    return keyed(source.first_dates(panel(spark, sf_dir), 10), ["wap"], 12)


@register("row_id", q.query(q.PANEL, "SELECT concat_ws('_', date_id, seconds_in_bucket, stock_id) AS row_id, time_id FROM panel"))
def row_id(spark, sf_dir):
    return panel(spark, sf_dir).select(source.row_id().alias("row_id"), "time_id")


_COVER = """, s AS (SELECT stock_id, date_id, count(*) AS n_rows FROM panel GROUP BY ALL), st AS (SELECT sum(n_rows) AS n FROM s GROUP BY stock_id), dt AS (SELECT sum(n_rows) AS n FROM s GROUP BY date_id)"""


@register(
    "coverage",
    q.query(
        q.PANEL + _COVER,
        """SELECT CAST(sum(n_rows) AS BIGINT) AS rows, count(DISTINCT stock_id) AS stocks, count(DISTINCT date_id) AS dates, min(date_id) AS first_date, max(date_id) AS last_date, count(*) AS sessions,
        count(*) FILTER (n_rows <> 10) AS partial_sessions, count(DISTINCT stock_id) * count(DISTINCT date_id) AS possible_sessions, count(DISTINCT stock_id) * count(DISTINCT date_id) - count(*) AS missing_sessions,
        (SELECT CAST(min(n) AS BIGINT) FROM st) AS min_rows_stock, (SELECT CAST(max(n) AS BIGINT) FROM st) AS max_rows_stock, (SELECT CAST(median(n) AS DOUBLE) FROM st) AS median_rows_stock,
        (SELECT CAST(min(n) AS BIGINT) FROM dt) AS min_rows_date, (SELECT CAST(max(n) AS BIGINT) FROM dt) AS max_rows_date, (SELECT CAST(median(n) AS DOUBLE) FROM dt) AS median_rows_date FROM s""",
    ),
)
def coverage(spark, sf_dir):
    return profile.coverage(panel(spark, sf_dir), CFG)


@register("thinnest_stocks", q.query(q.PANEL, "SELECT stock_id, count(*) AS n_rows FROM panel GROUP BY 1 ORDER BY 2, 1 LIMIT 5"))
def thinnest_stocks(spark, sf_dir):
    return profile.thinnest_stocks(panel(spark, sf_dir))


@register("partial_session_sizes", q.query(q.PANEL + _COVER, "SELECT n_rows, count(*) AS sessions FROM s WHERE n_rows <> 10 GROUP BY 1"))
def partial_session_sizes(spark, sf_dir):
    return profile.partial_session_sizes(panel(spark, sf_dir), CFG)


@register("date_gaps", q.query(q.PANEL, "SELECT max(date_id) - min(date_id) + 1 - count(DISTINCT date_id) AS missing_dates FROM panel"))
def date_gaps(spark, sf_dir):
    return profile.date_gaps(panel(spark, sf_dir))


@register("null_counts", q.query(q.PANEL, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM panel" for c in VALUES)))
def null_counts(spark, sf_dir):
    return profile.null_counts(panel(spark, sf_dir), VALUES)


_RATE = "SELECT seconds_in_bucket, count(*) AS n_rows, (count(*) - count(far_price)) / CAST(count(*) AS DOUBLE) AS far_null_rate, (count(*) - count(near_price)) / CAST(count(*) AS DOUBLE) AS near_null_rate FROM panel GROUP BY 1"
_RATES = ["far_null_rate", "near_null_rate"]


@register("null_rate_by_bucket", q.query(q.PANEL, f"SELECT seconds_in_bucket, n_rows, {q.rounded(_RATES)} FROM ({_RATE})"))
def null_rate_by_bucket(spark, sf_dir):
    return rounded(profile.null_rate_by_bucket(panel(spark, sf_dir)), _RATES)


@register("null_rate_before_after", q.query(q.PANEL, f"SELECT seconds_in_bucket < 50 AS before_crossing, {', '.join(f'round({n}({c}_null_rate), 6) AS {n}_{c}' for c in ('far', 'near') for n in ('min', 'max'))} FROM ({_RATE}) GROUP BY 1"))
def null_rate_before_after(spark, sf_dir):
    return rounded(profile.null_rate_before_after(panel(spark, sf_dir), CFG), ["min_far", "max_far", "min_near", "max_near"])


_PROBED = ["wap", "bid_price", "ask_price", "matched_size", "target"]


@register("precision_probe", q.query(q.PANEL, " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))), 9) AS max_abs_error, round(max(CASE WHEN {c} <> 0 THEN abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)) / abs({c}) ELSE 0 END), 9) AS max_rel_error FROM panel" for c in _PROBED)))
def precision_probe(spark, sf_dir):
    return rounded(profile.precision_probe(panel(spark, sf_dir), _PROBED), ["max_abs_error", "max_rel_error"], 9)


_DESCRIBED = ["mean", "median", "std", "mean_abs", "min", "max", "skew", "excess_kurtosis"]


@register("describe_target", q.query(q.PANEL, f"SELECT n, {q.rounded(_DESCRIBED)} FROM (SELECT count(target) AS n, avg(target) AS mean, median(target) AS median, stddev_pop(target) AS std, avg(abs(target)) AS mean_abs, min(target) AS min, max(target) AS max, skewness(target) AS skew, kurtosis(target) AS excess_kurtosis FROM panel)"))
def describe_target(spark, sf_dir):
    return rounded(profile.describe_target(panel(spark, sf_dir)), _DESCRIBED)


@register("target_quantiles", q.query(q.PANEL, " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS quantile, round(quantile_cont(target, {x}), 6) AS value FROM panel" for x in profile.QUANTILES)))
def target_quantiles(spark, sf_dir):
    return rounded(profile.target_quantiles(panel(spark, sf_dir)), ["value"])


@register("row_features", q.query(q.ROWS, f"SELECT {K}, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in ROW_FEATURES)} FROM raw"))
def row_features(spark, sf_dir):
    return keyed(rows(spark, sf_dir), ROW_FEATURES)


@register("revealed_target_range", q.query(q.LABELLED, f"SELECT {K}, round(revealed_target, 6) AS revealed_target FROM labelled"))
def revealed_target_range(spark, sf_dir):
    return keyed(labelled(spark, sf_dir), ["revealed_target"])


@register("revealed_target_join", q.query(q.LABELLED, "SELECT a.stock_id, a.date_id, a.seconds_in_bucket, round(b.target, 6) AS revealed_target FROM labelled a LEFT JOIN labelled b ON a.stock_id = b.stock_id AND a.seconds_in_bucket = b.seconds_in_bucket AND b.date_id = a.date_id - 1"))
def revealed_target_join(spark, sf_dir):
    return keyed(reveal.add_revealed_target_by_join(panel(spark, sf_dir).where("target is not null")), ["revealed_target"])


def _family(name: str, columns: list[str]) -> None:
    @register(name, q.query(q.MEMORY, f"SELECT {K}, {q.rounded(columns)} FROM features"))
    def family(spark, sf_dir):
        return keyed(memory(spark, sf_dir), columns)


_family("momentum_1b_6b", ["wap_ret_1b_bps", "wap_ret_6b_bps"])
_family("rolling_vol", ["wap_vol_6b_bps"])
_family("book_changes", ["imb_ratio_chg_1b", "size_imb_chg_1b", "matched_chg_1b", "spread_chg_1b_bps"])
_family("near_change_gated", ["near_wap_chg_1b_bps"])
_family("cs_demean", ["wap_ret_1b_cs", "wap_ret_6b_cs", "wap_ref_cs"])
_family("cs_rank", ["imb_ratio_cs_rank", "spread_cs_rank"])
_family("trailing_state", ["stock_vol_20d_bps", "stock_vol_is_missing", "revealed_abs_bps", "revealed_is_missing"])


@register("all_features", q.query(q.MEMORY, f"SELECT {K}, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in ALL_FEATURES)} FROM features"))
def all_features(spark, sf_dir):
    return keyed(memory(spark, sf_dir), ALL_FEATURES)


_LEG = ", legs AS (SELECT * FROM (SELECT *, (lead(wap, {k}) OVER (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket) / wap - 1) * 1e4 AS ret, (lead(wap, {k}) OVER (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket) / wap - 1) * 1e4 - target AS leg FROM panel) WHERE seconds_in_bucket <= 80 AND leg IS NOT NULL)"


@register("index_leg", q.query(q.PANEL + _LEG.format(k=1), f"SELECT {K}, round(ret, 6) AS ret, round(leg, 6) AS leg FROM legs"))
def index_leg(spark, sf_dir):
    return keyed(reveal.index_leg(panel(spark, sf_dir), CFG), ["ret", "leg"])


def _spread(name: str, lag: int) -> None:
    @register(name, q.query(q.PANEL + _LEG.format(k=lag), "SELECT date_id, seconds_in_bucket, count(*) AS n, round(stddev_samp(leg), 6) AS leg_std, round(avg(leg), 6) AS leg_mean FROM legs GROUP BY 1, 2"))
    def spread(spark, sf_dir):
        d = reveal.leg_spread(reveal.index_leg(panel(spark, sf_dir), CFG, lag)).select("date_id", "seconds_in_bucket", "n", "leg_std", "leg_mean")
        return rounded(d, ["leg_std", "leg_mean"])


_spread("index_leg_spread", 1)
_spread("index_leg_wrong_lag", 2)


@register("carry_autocorr", q.query(q.LABELLED, "SELECT seconds_in_bucket, count(*) AS n, round(corr(target, revealed_target), 6) AS rho FROM labelled WHERE revealed_target IS NOT NULL GROUP BY 1"))
def carry_autocorr(spark, sf_dir):
    return rounded(profile.carry_autocorrelation(labelled(spark, sf_dir)), ["rho"])


@register("carry_autocorr_summary", q.query(q.LABELLED, "SELECT (SELECT count(*) FROM labelled WHERE revealed_target IS NOT NULL) AS n, (SELECT round(corr(target, revealed_target), 6) FROM labelled) AS rho, round(min(r), 6) AS min_rho, round(median(r), 6) AS median_rho, round(max(r), 6) AS max_rho FROM (SELECT corr(target, revealed_target) AS r FROM labelled WHERE revealed_target IS NOT NULL GROUP BY seconds_in_bucket)"))
def carry_autocorr_summary(spark, sf_dir):
    return rounded(profile.carry_autocorrelation_summary(labelled(spark, sf_dir)), ["rho", "min_rho", "median_rho", "max_rho"])


@register("per_stock_dispersion", q.query(q.LABELLED, "SELECT stock_id, round(avg(abs(target)), 6) AS mean_abs FROM labelled GROUP BY 1"))
def per_stock_dispersion(spark, sf_dir):
    return rounded(profile.stock_dispersion(panel(spark, sf_dir)), ["mean_abs"])


@register("stock_dispersion_summary", q.query(q.LABELLED, "SELECT round(min(m), 6) AS min_mean_abs, arg_min(stock_id, m) AS calmest, round(max(m), 6) AS max_mean_abs, arg_max(stock_id, m) AS wildest, round(median(m), 6) AS median_mean_abs, round(max(m) / min(m), 6) AS ratio FROM (SELECT stock_id, avg(abs(target)) AS m FROM labelled GROUP BY 1)"))
def stock_dispersion_summary(spark, sf_dir):
    return rounded(profile.stock_dispersion_summary(panel(spark, sf_dir)), ["min_mean_abs", "max_mean_abs", "median_mean_abs", "ratio"])


@register("empty_book_profile", q.query(q.PANEL, f"SELECT stock_id, date_id, count(*) AS n_rows, {', '.join(f'count(*) - count({c}) AS null_{c}' for c in ('reference_price', 'bid_price', 'ask_price', 'near_price', 'far_price', 'target'))}, {', '.join(f'count(*) FILTER (imbalance_buy_sell_flag = {v}) AS flag_{n}' for n, v in (('sell', -1), ('none', 0), ('buy', 1)))} FROM panel WHERE wap IS NULL GROUP BY 1, 2"))
def empty_book_profile(spark, sf_dir):
    return profile.empty_books(panel(spark, sf_dir))


@register("fingerprint", q.query(q.LABELLED, "SELECT count(*) AS n, round(sum(target), 4) AS target_sum, min(date_id) AS first_date, max(date_id) AS last_date FROM labelled"))
def fingerprint(spark, sf_dir):
    p = profile.fingerprint(labelled(spark, sf_dir))
    return p.select("n", F.round("target_sum", 4).alias("target_sum"), F.col("first_key.date_id").alias("first_date"), F.col("last_key.date_id").alias("last_date"))


def made_folds(df: DataFrame) -> list[folds.Fold]:
    return folds.make_folds(folds.date_axis(df), CFG)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema if f.dataType.simpleString() == "int"})


@register("fold_table_dates", q.query(q.FOLDS, "SELECT fold, count(*) FILTER (role = 'train') AS n_train, min(date_id) FILTER (role = 'train') AS train_first, max(date_id) FILTER (role = 'train') AS train_last, count(*) FILTER (role = 'embargo') AS n_embargoed, count(*) FILTER (role = 'validation') AS n_val, min(date_id) FILTER (role = 'validation') AS val_first, max(date_id) FILTER (role = 'validation') AS val_last FROM folds GROUP BY 1"))
def fold_table_dates(spark, sf_dir):
    return _long(folds.describe(spark, made_folds(panel(spark, sf_dir).where("target is not null"))))


@register("fold_assignment", q.query(q.FOLDS, f"SELECT {K}, fold, role FROM dealt"))
def fold_assignment(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return _long(folds.assign(df, made_folds(df)).select(*KEY, "fold", "role"))


def predicted(spark: SparkSession, sf_dir: str, prediction) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("prediction", prediction)


_BREAK = ["mae", "mae_zero", "improvement_bps", "improvement_pct"]


@register("zero_breakdown_by_bucket", q.query(q.LABELLED, q.breakdown("seconds_in_bucket", "labelled", "0")))
def zero_breakdown_by_bucket(spark, sf_dir):
    return rounded(metrics.breakdown(predicted(spark, sf_dir, F.lit(0.0)), "seconds_in_bucket"), _BREAK)


_HALF = "0.25 * coalesce(revealed_target, 0)"


def half_carry():
    return 0.25 * or_zero(F.col("revealed_target"))


@register("breakdown_by_stock", q.query(q.LABELLED, q.breakdown("stock_id", "labelled", _HALF)))
def breakdown_by_stock(spark, sf_dir):
    return rounded(metrics.breakdown(predicted(spark, sf_dir, half_carry()), "stock_id"), _BREAK)


_ROLL = ["mean_improvement_bps", "share_better", "worst_bps", "best_bps"]


@register("consistency_rollup", q.query(q.LABELLED, f"SELECT round(avg(i), 6) AS mean_improvement_bps, round(avg(CASE WHEN i > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_better, round(min(i), 6) AS worst_bps, round(max(i), 6) AS best_bps FROM (SELECT avg(abs(target)) - avg(abs(target - {_HALF})) AS i FROM labelled GROUP BY date_id)"))
def consistency_rollup(spark, sf_dir):
    return rounded(metrics.consistency(metrics.breakdown(predicted(spark, sf_dir, half_carry()), "date_id")), _ROLL)


def simple_models() -> list:
    return [models.Zero(), models.ConstantMedian(), models.Carry("carry_raw", 1.0), models.Carry()]


def evaluated(spark: SparkSession, sf_dir: str, arms: list, builder=lambda df, cfg: df) -> cv.CvResult:
    return cv.run_cv(panel(spark, sf_dir), CFG, arms, builder)


def summed_up(result: cv.CvResult, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A small table of a run, computed while the run is cached; then the cache goes."""
    df = table(result.oof)
    out = df.sparkSession.createDataFrame(df.collect(), df.schema)
    result.release()
    return out


def _arm(name: str, model: str, make: Callable) -> None:
    @register(name, q.query(q.FOLDS, f"SELECT fold, round(mae_bps, 6) AS mae_bps FROM fold_mae WHERE model = '{model}'"))
    def arm(spark, sf_dir):
        per = summed_up(evaluated(spark, sf_dir, [make()]), metrics.per_fold)
        return per.select(F.col("fold").cast("long").alias("fold"), F.round("mae_bps", 6).alias("mae_bps"))


_arm("constant_median_cv", "constant_median", models.ConstantMedian)
_arm("carry_raw_cv", "carry_raw", lambda: models.Carry("carry_raw", 1.0))
_arm("carry_shrunk_grid", "carry_shrunk", models.Carry)


@register("scorecard", q.query(q.FOLDS, "SELECT model, round(avg(abs(target - prediction)), 6) AS mae_bps, round(CAST(count(prediction) AS DOUBLE) / count(target), 6) AS coverage, round(avg(abs(target)) - avg(abs(target - prediction)), 6) AS vs_zero_bps, round(100 * (avg(abs(target)) - avg(abs(target - prediction))) / avg(abs(target)), 6) AS vs_zero_pct FROM oof GROUP BY 1"))
def scorecard(spark, sf_dir):
    return rounded(summed_up(evaluated(spark, sf_dir, simple_models()), metrics.scorecard), ["mae_bps", "coverage", "vs_zero_bps", "vs_zero_pct"])


_PIVOT = ["fold_0", "fold_1", "fold_2", "mean", "std", "std_with_mean", "mean_vs_zero"]


@register(
    "fold_mae_pivot",
    q.query(
        q.FOLDS,
        f"""SELECT model, {q.rounded(_PIVOT)} FROM (SELECT model, max(mae_bps) FILTER (fold = 0) AS fold_0, max(mae_bps) FILTER (fold = 1) AS fold_1, max(mae_bps) FILTER (fold = 2) AS fold_2, avg(mae_bps) AS mean,
        stddev_pop(mae_bps) AS std, stddev_pop(mae_bps) * sqrt(3.0 / 4) AS std_with_mean, (SELECT avg(mae_bps) FROM fold_mae WHERE model = 'zero') - avg(mae_bps) AS mean_vs_zero FROM fold_mae GROUP BY 1)""",
    ),
)
def fold_mae_pivot(spark, sf_dir):
    return rounded(metrics.fold_table(summed_up(evaluated(spark, sf_dir, simple_models()), metrics.per_fold), [0, 1, 2]), _PIVOT)


@register("paired_vs_zero", q.query(q.FOLDS, "SELECT m.model, m.fold, round(m.mae_bps - z.mae_bps, 6) AS difference_bps FROM fold_mae m JOIN fold_mae z ON z.fold = m.fold AND z.model = 'zero' WHERE m.model <> 'zero'"))
def paired_vs_zero(spark, sf_dir):
    d = metrics.paired(summed_up(evaluated(spark, sf_dir, simple_models()), metrics.per_fold), "zero")
    return d.select("model", F.col("fold").cast("long").alias("fold"), F.round("difference_bps", 6).alias("difference_bps"))


@register("quantile_bounds", q.query(q.ROWS, " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(quantile_cont(coalesce({c}, 0), 0.001), 6) AS low, round(quantile_cont(coalesce({c}, 0), 0.999), 6) AS high FROM raw" for c in ROW_FEATURES if c not in UNBOUNDED)))
def quantile_bounds(spark, sf_dir):
    b = models.quantile_bounds(rows(spark, sf_dir), ROW_FEATURES)
    return rounded(spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in b.items()], "column_name string, low double, high double"), ["low", "high"])


_CLIPPED = ["spread_bps", "wap_minus_reference_bps"]


@register("clip_standardize", q.query(q.ROWS, f"""SELECT {K}, {', '.join(f'round((c_{c} - avg(c_{c}) OVER ()) / CASE WHEN stddev_pop(c_{c}) OVER () > 0 THEN stddev_pop(c_{c}) OVER () ELSE 1 END, 6) AS {c}' for c in _CLIPPED)}
FROM (SELECT {K}, {', '.join(f'least(greatest(coalesce({c}, 0), (SELECT quantile_cont(coalesce({c}, 0), 0.001) FROM raw)), (SELECT quantile_cont(coalesce({c}, 0), 0.999) FROM raw)) AS c_{c}' for c in _CLIPPED)} FROM raw)"""))
def clip_standardize(spark, sf_dir):
    df = rows(spark, sf_dir).select(*KEY, *_CLIPPED)
    bounds = models.quantile_bounds(df, _CLIPPED)
    df = df.withColumns({c: clip(F.col(c), *bounds[c]) for c in _CLIPPED})
    m = df.agg(*(f(c).alias(f"{n}_{c}") for c in _CLIPPED for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return keyed(df.withColumns({c: (F.col(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0) for c in _CLIPPED}), _CLIPPED)


_INFLATED = [c for c in ROW_FEATURES if c not in UNBOUNDED]


@register("sd_inflation", q.query(q.ROWS, " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(CASE WHEN stddev_samp(k) > 0 THEN stddev_samp(x) / stddev_samp(k) ELSE 1 END, 6) AS inflation FROM (SELECT coalesce({c}, 0) AS x, least(greatest(coalesce({c}, 0), (SELECT quantile_cont(coalesce({c}, 0), 0.001) FROM raw)), (SELECT quantile_cont(coalesce({c}, 0), 0.999) FROM raw)) AS k FROM raw)" for c in _INFLATED)))
def sd_inflation(spark, sf_dir):
    d = models.sd_inflation(rows(spark, sf_dir), _INFLATED)
    return spark.createDataFrame([(c, round(x, 6)) for c, x in d.items()], "column_name string, inflation double")


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluated(spark, sf_dir, [models.ConstantMedian(), models.Carry("carry_raw", 1.0)]).release()
    return blend.pair_up(run.oof, "constant_median", "carry_raw", KEY)


_PAIRS = ", pairs AS (SELECT stock_id, date_id, seconds_in_bucket, fold, max(target) AS target, max(prediction) FILTER (model = 'constant_median') AS a, max(prediction) FILTER (model = 'carry_raw') AS b FROM oof GROUP BY ALL)"


@register("blend_fixed", q.query(q.FOLDS + _PAIRS, f"SELECT {K}, fold, round(0.5 * a + 0.5 * b, 6) AS prediction FROM pairs"))
def blend_fixed(spark, sf_dir):
    d = blend.blend_fixed(pairs_of(spark, sf_dir), 0.5)
    return d.select(*KEY, F.col("fold").cast("long").alias("fold"), F.round("prediction", 6).alias("prediction"))


@register(
    "blend_forward_weights",
    q.query(
        q.FOLDS + _PAIRS + """, w1 AS (
  SELECT f AS fold, arg_min(w, (round(loss, 12), w)) AS w FROM (SELECT f, g / 20.0 AS w, avg(abs(target - (g / 20.0 * a + (1 - g / 20.0) * b))) AS loss FROM pairs, range(1, 3) t(f), range(21) u(g) WHERE fold < f GROUP BY ALL) GROUP BY f
), w2 AS (
  SELECT fold, arg_min(v, (round(loss, 12), v)) AS weight FROM (
    SELECT w1.fold, least(greatest(w - 0.05 + g * 0.005, 0), 1) AS v, avg(abs(target - (least(greatest(w - 0.05 + g * 0.005, 0), 1) * a + (1 - least(greatest(w - 0.05 + g * 0.005, 0), 1)) * b))) AS loss
    FROM pairs JOIN w1 ON pairs.fold < w1.fold, range(21) t(g) GROUP BY ALL) GROUP BY fold)""",
        "SELECT CAST(0 AS BIGINT) AS fold, CAST(0.5 AS DOUBLE) AS weight UNION ALL SELECT fold, round(weight, 6) FROM w2",
    ),
)
def blend_forward_weights(spark, sf_dir):
    w = blend.forward_weights(pairs_of(spark, sf_dir), [0, 1, 2])
    return spark.createDataFrame([(int(k), round(float(v), 6)) for k, v in w.items()], "fold long, weight double")


# Guards and invariants.


@register("guard_counts", q.query(q.ROWS, " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (wap IS NOT NULL AND ({c} IS NULL OR NOT isfinite({c}))) AS bad FROM raw" for c in ROW_FEATURES)))
def guard_counts(spark, sf_dir):
    return features.guard_counts(labelled(spark, sf_dir), CFG)


@register("duplicate_keys", q.query(q.PANEL, f"SELECT {K}, count(*) AS n_rows FROM panel GROUP BY ALL HAVING count(*) > 1"))
def duplicate_keys(spark, sf_dir):
    return duplicate_keys_of(panel(spark, sf_dir))


@register(
    "invariants",
    q.query(
        q.PANEL,
        """SELECT CAST(coalesce(sum(CASE WHEN seconds_in_bucket % 10 <> 0 OR seconds_in_bucket < 0 OR seconds_in_bucket > 90 THEN 1 ELSE 0 END), 0) AS BIGINT) AS off_grid,
        CAST(coalesce(sum(CASE WHEN time_id <> date_id * 10 + floor(seconds_in_bucket / 10) THEN 1 ELSE 0 END), 0) AS BIGINT) AS wrong_time_id,
        (SELECT count(DISTINCT (stock_id, date_id)) FROM (SELECT stock_id, date_id, time_id < lag(time_id) OVER (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket) AS falls FROM panel) WHERE falls) AS unordered_sessions,
        CAST(count(*) - count(DISTINCT (stock_id, date_id, seconds_in_bucket)) AS BIGINT) AS repeated_keys FROM panel""",
    ),
)
def invariants(spark, sf_dir):
    return profile.invariants(panel(spark, sf_dir), CFG)


_SPREADS = _LEG.format(k=1) + ", l1 AS (SELECT stddev_samp(leg) AS s, avg(leg) AS m, avg(ret) AS r FROM legs WHERE date_id IN (SELECT DISTINCT date_id FROM panel ORDER BY 1 LIMIT 40) GROUP BY date_id, seconds_in_bucket HAVING count(*) > 1)"
_WRONG = _LEG.format(k=2).replace("legs AS", "legs2 AS") + ", l2 AS (SELECT stddev_samp(leg) AS s FROM legs2 WHERE date_id IN (SELECT DISTINCT date_id FROM panel ORDER BY 1 LIMIT 40) GROUP BY date_id, seconds_in_bucket HAVING count(*) > 1)"


@register("index_leg_summary", q.query(q.PANEL + _SPREADS + _WRONG, "SELECT count(*) AS instants, round(median(s), 6) AS median_std, round(max(s), 6) AS max_std, round(corr(m, r), 6) AS corr_equal_weights, round(avg(abs(m - r)), 6) AS mean_gap_equal_weights, round((SELECT median(s) FROM l2), 6) AS median_std_lag_2 FROM l1"))
def index_leg_summary(spark, sf_dir):
    d = reveal.leg_summary(panel(spark, sf_dir), CFG, (2,)).drop("ratio_lag_2")  # the made target is exact here, so the ratio divides by rounding errors
    return rounded(d, ["median_std", "max_std", "corr_equal_weights", "mean_gap_equal_weights", "median_std_lag_2"])


@register("scored_by_all", q.query(q.FOLDS, f"SELECT {K} FROM oof WHERE prediction IS NOT NULL GROUP BY ALL HAVING count(DISTINCT model) = 4"))
def scored_by_all(spark, sf_dir):
    return metrics.scored_by_all(evaluated(spark, sf_dir, simple_models()).release().oof, KEY, 4)


_GRAM = [c for c in ROW_FEATURES if c not in UNBOUNDED][:4]


@register(
    "ridge_gram",
    q.query(
        q.ROWS
        + f", bounds AS (SELECT {', '.join(f'quantile_cont(coalesce({c}, 0), 0.001) AS lo_{c}, quantile_cont(coalesce({c}, 0), 0.999) AS hi_{c}' for c in _GRAM)} FROM raw), kept AS (SELECT {', '.join(f'least(greatest(coalesce({c}, 0), lo_{c}), hi_{c}) AS {c}' for c in _GRAM)}, least(greatest(target, -60), 60) AS y FROM raw, bounds)",
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS correlation, round(covar_pop({a}, y) / stddev_pop({a}), 6) AS with_target FROM kept" for i, a in enumerate(_GRAM) for b in _GRAM[i:]),
    ),
)
def ridge_gram(spark, sf_dir):
    """What a ridge fit solves, on four columns: products of clipped, standardised columns per row."""
    df = rows(spark, sf_dir)
    bounds = models.quantile_bounds(df, _GRAM)
    y = clip(F.col("target"), -CFG.fit_clip_bps, CFG.fit_clip_bps)
    x = {c: models.clipped(c, bounds) for c in _GRAM}
    pairs = [(a, b) for i, a in enumerate(_GRAM) for b in _GRAM[i:]]
    one = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.covar_pop(x[a], x[b]) / (F.stddev_pop(x[a]) * F.stddev_pop(x[b])), 6).alias("correlation"), F.round(F.covar_pop(x[a], y) / F.stddev_pop(x[a]), 6).alias("with_target")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(f"p{i}" for i in range(len(pairs))))).alias("p")).select("p.*")


# Ridge in SQL: the normal equations are eliminated step by step in a recursive query (no pivoting: the matrix is positive definite).

_N = len(ROW_FEATURES)


def _ridge_sql(source: str) -> str:
    """CTEs after ``source`` (fold, role and raw feature columns): w(fold, scaled coefficients' list), and what predictions need."""
    use = [c for c in ROW_FEATURES if c not in UNBOUNDED]
    lo = ", ".join(f"quantile_cont(coalesce({c}, 0), 0.001) AS lo_{c}, quantile_cont(coalesce({c}, 0), 0.999) AS hi_{c}" for c in use)
    x = ", ".join(f"least(greatest(coalesce({c}, 0), lo_{c}), hi_{c}) AS x{i}" if c in use else f"coalesce({c}, 0) AS x{i}" for i, c in enumerate(ROW_FEATURES))
    sd = lambda i: f"(CASE WHEN max(x{i}) > min(x{i}) THEN stddev_pop(x{i}) ELSE 1 END)"
    row = lambda i: "[" + ", ".join(f"count(*) * covar_pop(x{i}, x{j}) / {sd(i)} / {sd(j)}" + (" + 1.0" if i == j else "") for j in range(_N)) + f", count(*) * covar_pop(x{i}, y) / {sd(i)}]"
    return f""", bnd AS (SELECT fold, {lo} FROM {source} WHERE role = 'train' GROUP BY fold
), xs AS (SELECT s.fold, role, stock_id, date_id, seconds_in_bucket, target, least(greatest(target, -60), 60) AS y, {x} FROM {source} s JOIN bnd USING (fold)
), sys AS (SELECT fold, avg(y) AS intercept, [{', '.join(f'avg(x{i})' for i in range(_N))}] AS mu, [{', '.join(sd(i) for i in range(_N))}] AS sd, [{', '.join(row(i) for i in range(_N))}] AS m FROM xs WHERE role = 'train' GROUP BY fold
), solve(fold, k, m) AS (
  SELECT fold, 1, m FROM sys UNION ALL
  SELECT fold, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM solve WHERE k <= {_N}
), w AS (SELECT sys.fold, intercept, mu, sd, list_transform(solve.m, lambda r: r[{_N + 1}]) AS w FROM solve JOIN sys USING (fold) WHERE k = {_N + 1}
), raws AS (SELECT xs.fold, role, stock_id, date_id, seconds_in_bucket, target, intercept + {' + '.join(f'(x{i} - mu[{i + 1}]) / sd[{i + 1}] * w[{i + 1}]' for i in range(_N))} AS p FROM xs JOIN w USING (fold)
), coarse_r AS (SELECT fold, arg_min(a, (round(loss, 12), a)) AS a FROM (SELECT fold, g / 20.0 AS a, avg(abs(target - g / 20.0 * p)) AS loss FROM raws, range(41) t(g) WHERE role = 'train' GROUP BY ALL) GROUP BY fold
), scaled AS (SELECT fold, arg_min(s, (round(loss, 12), s)) AS s FROM (SELECT fold, greatest(a - 0.05 + g * 0.005, 0) AS s, avg(abs(target - greatest(a - 0.05 + g * 0.005, 0) * p)) AS loss FROM raws JOIN coarse_r USING (fold), range(21) t(g) WHERE role = 'train' GROUP BY ALL) GROUP BY fold)"""


@register("ridge_coefficients", q.query("RECURSIVE " + q.ROWS + ", one AS (SELECT 0 AS fold, 'train' AS role, * FROM raw)" + _ridge_sql("one"), "SELECT column_name, round(s * w[i], 6) AS coefficient FROM w JOIN scaled USING (fold), (VALUES " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(ROW_FEATURES)) + ") n(i, column_name)"))
def ridge_coefficients(spark, sf_dir):
    m = models.Ridge().fit(rows(spark, sf_dir), CFG)
    return spark.createDataFrame([(c, round(x, 6)) for c, x in m.coefficients()], "column_name string, coefficient double")


@register("ridge_cv", q.query("RECURSIVE " + q.FOLDS + ", " + q.ROWS[len(q.LABELLED) + 2 :] + ", cut AS (SELECT fold, role, raw.* FROM raw JOIN folds USING (date_id) WHERE role <> 'embargo')" + _ridge_sql("cut"), "SELECT 'ridge' AS model, raws.fold, round(avg(abs(target - s * p)), 6) AS mae_bps FROM raws JOIN scaled USING (fold) WHERE role = 'validation' GROUP BY 2 UNION ALL SELECT 'ridge_noscale', fold, round(avg(abs(target - p)), 6) FROM raws WHERE role = 'validation' GROUP BY 2 UNION ALL SELECT 'zero', fold, round(avg(abs(target)), 6) FROM raws WHERE role = 'validation' GROUP BY 2"))
def ridge_cv(spark, sf_dir):
    r = evaluated(spark, sf_dir, [models.Zero(), models.Ridge(), models.Ridge("ridge_noscale", rescale=False)], features.build_row_features)
    per = summed_up(r, metrics.per_fold)
    return per.select("model", F.col("fold").cast("long").alias("fold"), F.round("mae_bps", 6).alias("mae_bps"))


@register("manifest_compare", "SELECT * FROM (VALUES ('same rows, other plan', true), ('one row less', false), ('one value moved', false)) t(other, ok)")
def manifest_compare(spark, sf_dir):
    """A panel's manifest against that of the same rows in another order and partitioning, of a row less, and of a moved value."""
    df = labelled(spark, sf_dir)

    def manifest(d: DataFrame) -> dict:
        return {"fingerprint": profile.fingerprint(d).first().asDict(True), "target": profile.describe_target(d).first().asDict(), "nulls": [r.asDict() for r in profile.null_counts(d, VALUES).collect()], "build_seconds": id(d)}

    def number(x):
        return {k: number(v) for k, v in x.items()} if isinstance(x, dict) else [number(v) for v in x] if isinstance(x, list) else int(x) if type(x).__name__ == "Decimal" else x

    base = number(manifest(df))
    last = df.agg(F.max(F.struct("date_id", "seconds_in_bucket", "stock_id")).alias("k")).first()["k"]
    at = (F.col("date_id") == last["date_id"]) & (F.col("seconds_in_bucket") == last["seconds_in_bucket"]) & (F.col("stock_id") == last["stock_id"])
    others = {"same rows, other plan": df.repartition(7, "seconds_in_bucket"), "one row less": df.where(~at), "one value moved": df.withColumn("target", F.when(at, F.col("target") + 1e-3).otherwise(F.col("target")))}
    return spark.createDataFrame([(k, integrity.compare_manifests(base, number(manifest(d))).ok) for k, d in others.items()], "other string, ok boolean")


# What SQL cannot say: boosted trees, nets, and variants of the ridge. Tests hold these against direct computations.


@register("ridge_ablations")
def ridge_ablations(spark, sf_dir):
    df = rows(spark, sf_dir).persist()
    out = cv.ridge_ablations(df, CFG, made_folds(df))
    df.unpersist()
    return spark.createDataFrame(out, "variant string, fold int, mae_bps double")


@register("gbt_cv")
def gbt_cv(spark, sf_dir):
    r = evaluated(spark, sf_dir, [models.Zero(), models.BoostedTrees(columns=list(ALL_FEATURES), trees=5, depth=4)], features.build_memory_features)
    return summed_up(r, metrics.scorecard)


@register("gbt_importance")
def gbt_importance(spark, sf_dir):
    m = models.BoostedTrees(columns=list(ALL_FEATURES), trees=5, depth=4).fit(memory(spark, sf_dir), CFG)
    return spark.createDataFrame(m.importance(), "column_name string, share double")


@register("mlp_cv")
def mlp_cv(spark, sf_dir):
    df = memory(spark, sf_dir).persist()
    fs = made_folds(df)
    m = mlp.Mlp(stocks=10, options={"epochs": 4, "hidden": (32, 16), "batch": 512}).fit_folds(folds.assign(df, fs, "train"), CFG)
    val = folds.assign(df, fs, "validation")
    parts = [m.predict(val.where(F.col("fold") == f.index), f.index) for f in fs]
    df.unpersist()
    oof = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("model", F.lit(m.name))
    return metrics.scorecard(oof)
