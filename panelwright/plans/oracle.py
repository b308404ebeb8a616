"""SQL of the derived panel and of everything that is built on it, as common table expressions for DuckDB."""

from __future__ import annotations

CELLS = """
keyed AS (
  SELECT l_suppkey % 10 AS stock_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS date_id,
         CAST(least(floor((day(l_shipdate) - 1) / 3.0), 9) * 10 AS BIGINT) AS seconds_in_bucket, l_quantity, l_returnflag,
         CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem
), cells AS (
  SELECT stock_id, date_id, seconds_in_bucket,
         coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS bid_size, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS ask_size,
         coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS matched_size,
         CAST(sum(disc) AS DOUBLE) / count(*) AS disc, CAST(sum(tax) AS DOUBLE) / count(*) AS tax
  FROM keyed GROUP BY ALL
)"""

PANEL = (
    CELLS
    + """, priced AS (
  SELECT *, 1 - disc / 1e4 AS bp, 1 + tax / 1e4 AS ap,
         CASE WHEN bid_size + ask_size > 0 THEN ((1 - disc / 1e4) * ask_size + (1 + tax / 1e4) * bid_size) / (bid_size + ask_size) END AS wap
  FROM cells
), book AS (
  SELECT stock_id, date_id, seconds_in_bucket, abs(bid_size - ask_size) AS imbalance_size, CAST(sign(bid_size - ask_size) AS BIGINT) AS imbalance_buy_sell_flag,
         CASE WHEN wap IS NOT NULL THEN 1 + (tax - 4) / 1e4 END AS reference_price, matched_size,
         CASE WHEN wap IS NOT NULL AND seconds_in_bucket >= 50 AND matched_size > 0 THEN 1 + (disc - 5) / 5e3 END AS far_price,
         CASE WHEN wap IS NOT NULL AND seconds_in_bucket >= 50 THEN (bp + ap) / 2 END AS near_price,
         CASE WHEN wap IS NOT NULL THEN bp END AS bid_price, bid_size, CASE WHEN wap IS NOT NULL THEN ap END AS ask_price, ask_size, wap
  FROM priced
), fwd AS (
  SELECT *, 1e4 * (lead(wap, 1) OVER (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket) / wap - 1) AS _ret FROM book
), panel AS (
  SELECT * EXCLUDE (_ret), _ret - avg(_ret) OVER (PARTITION BY date_id, seconds_in_bucket) AS target,
         CAST(date_id * 10 + floor(seconds_in_bucket / 10) AS BIGINT) AS time_id
  FROM fwd
)"""
)

LABELLED = (
    PANEL
    + """, labelled AS (
  SELECT *, max(target) OVER (PARTITION BY stock_id, seconds_in_bucket ORDER BY date_id RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS revealed_target
  FROM panel WHERE target IS NOT NULL
)"""
)

ROWS = (
    LABELLED
    + """, raw AS (
  SELECT *, CAST(imbalance_buy_sell_flag AS DOUBLE) * CASE WHEN matched_size > 0 THEN imbalance_size / matched_size ELSE 0 END AS imbalance_ratio,
    CAST(imbalance_buy_sell_flag AS DOUBLE) AS imbalance_flag, (wap - reference_price) * 1e4 AS wap_minus_reference_bps,
    CASE WHEN wap > 0 THEN (ask_price - bid_price) / wap ELSE 0 END * 1e4 AS spread_bps,
    CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0 END AS size_imbalance,
    CASE WHEN imbalance_size + matched_size > 0 THEN imbalance_size / (imbalance_size + matched_size) ELSE 0 END AS matched_share,
    (reference_price - 0.5 * (bid_price + ask_price)) * 1e4 AS reference_minus_mid_bps,
    CASE WHEN near_price IS NULL THEN 0 ELSE (near_price - wap) * 1e4 END AS near_minus_wap_bps,
    CASE WHEN far_price IS NULL THEN 0 ELSE (far_price - wap) * 1e4 END AS far_minus_wap_bps,
    CAST(near_price IS NULL AS DOUBLE) AS near_is_missing, CAST(far_price IS NULL AS DOUBLE) AS far_is_missing, CAST(wap IS NULL AS DOUBLE) AS book_is_missing,
    seconds_in_bucket / 90.0 AS seconds_frac, CAST(seconds_in_bucket AS DOUBLE) / 90 * (CAST(seconds_in_bucket AS DOUBLE) / 90) AS seconds_frac_sq
  FROM labelled
)"""
)

MEMORY = (
    ROWS
    + """, daily AS (SELECT stock_id, date_id, avg(abs(target)) AS scale FROM labelled GROUP BY ALL
), trail AS (
  SELECT stock_id, date_id, avg(scale) OVER (PARTITION BY stock_id ORDER BY date_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol FROM daily
), lagged AS (
  SELECT r.*, vol, coalesce((wap / lag(wap, 1) OVER a - 1) * 1e4, 0) AS wap_ret_1b_bps, coalesce((wap / lag(wap, 6) OVER a - 1) * 1e4, 0) AS wap_ret_6b_bps,
    coalesce(imbalance_ratio - lag(imbalance_ratio) OVER a, 0) AS imb_ratio_chg_1b, coalesce(size_imbalance - lag(size_imbalance) OVER a, 0) AS size_imb_chg_1b,
    coalesce(CASE WHEN lag(matched_size) OVER a > 0 THEN (matched_size - lag(matched_size) OVER a) / lag(matched_size) OVER a ELSE 0 END, 0) AS matched_chg_1b,
    coalesce(spread_bps - lag(spread_bps) OVER a, 0) AS spread_chg_1b_bps,
    coalesce((near_price - wap) * 1e4 - lag((near_price - wap) * 1e4) OVER a, 0) AS near_wap_chg_1b_bps
  FROM raw r LEFT JOIN trail USING (stock_id, date_id)
  WINDOW a AS (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket)
), features AS (
  SELECT *, coalesce(stddev_samp(wap_ret_1b_bps) OVER (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS wap_vol_6b_bps,
    wap_ret_1b_bps - avg(wap_ret_1b_bps) OVER i AS wap_ret_1b_cs, wap_ret_6b_bps - avg(wap_ret_6b_bps) OVER i AS wap_ret_6b_cs,
    coalesce((rank() OVER (PARTITION BY date_id, seconds_in_bucket ORDER BY imbalance_ratio NULLS LAST)
      + count(imbalance_ratio) OVER (PARTITION BY date_id, seconds_in_bucket ORDER BY imbalance_ratio NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(imbalance_ratio) OVER i - 0.5, 0) AS imb_ratio_cs_rank,
    coalesce(wap_minus_reference_bps - avg(wap_minus_reference_bps) OVER i, 0) AS wap_ref_cs,
    coalesce((rank() OVER (PARTITION BY date_id, seconds_in_bucket ORDER BY spread_bps NULLS LAST)
      + count(spread_bps) OVER (PARTITION BY date_id, seconds_in_bucket ORDER BY spread_bps NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(spread_bps) OVER i - 0.5, 0) AS spread_cs_rank,
    coalesce(vol, 0) AS stock_vol_20d_bps, CAST(vol IS NULL AS DOUBLE) AS stock_vol_is_missing,
    coalesce(abs(revealed_target), 0) AS revealed_abs_bps, CAST(revealed_target IS NULL AS DOUBLE) AS revealed_is_missing
  FROM lagged WINDOW i AS (PARTITION BY date_id, seconds_in_bucket)
)"""
)

FOLDS = (
    LABELLED
    + """, axis AS (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date_id FROM labelled)
), folds AS (
  SELECT CAST(f AS BIGINT) AS fold, CASE WHEN pos < n - (3 - f) * 15 - 2 THEN 'train' WHEN pos < n - (3 - f) * 15 THEN 'embargo' ELSE 'validation' END AS role, date_id
  FROM axis, range(3) t(f) WHERE pos < n - (3 - f) * 15 + 15
), dealt AS (SELECT fold, role, l.* FROM labelled l JOIN folds USING (date_id)
), train AS (SELECT * FROM dealt WHERE role = 'train'
), val AS (SELECT * FROM dealt WHERE role = 'validation'
), medians AS (SELECT fold, median(target) AS med FROM train GROUP BY fold
), coarse AS (
  SELECT fold, arg_min(a, (loss, a)) AS a FROM (SELECT fold, g / 20.0 AS a, avg(abs(target - g / 20.0 * coalesce(revealed_target, 0))) AS loss FROM train, range(41) t(g) GROUP BY ALL) GROUP BY fold
), shrink AS (
  SELECT fold, arg_min(s, (round(loss, 12), s)) AS s FROM (
    SELECT fold, greatest(a - 0.05 + g * 0.005, 0) AS s, avg(abs(target - greatest(a - 0.05 + g * 0.005, 0) * coalesce(revealed_target, 0))) AS loss
    FROM train JOIN coarse USING (fold), range(21) t(g) GROUP BY ALL) GROUP BY fold
), oof AS (
  SELECT stock_id, date_id, seconds_in_bucket, fold, target, 'zero' AS model, 0.0 AS prediction FROM val
  UNION ALL SELECT stock_id, date_id, seconds_in_bucket, fold, target, 'constant_median', med FROM val JOIN medians USING (fold)
  UNION ALL SELECT stock_id, date_id, seconds_in_bucket, fold, target, 'carry_raw', coalesce(revealed_target, 0) FROM val
  UNION ALL SELECT stock_id, date_id, seconds_in_bucket, fold, target, 'carry_shrunk', s * coalesce(revealed_target, 0) FROM val JOIN shrink USING (fold)
), fold_mae AS (SELECT model, fold, avg(abs(target - prediction)) AS mae_bps FROM oof GROUP BY ALL
)"""
)


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def breakdown(by: str, source: str, prediction: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg(abs(target - {prediction})), 6) AS mae, round(avg(abs(target)), 6) AS mae_zero,
  round(avg(abs(target)) - avg(abs(target - {prediction})), 6) AS improvement_bps,
  round(100 * (avg(abs(target)) - avg(abs(target - {prediction}))) / avg(abs(target)), 6) AS improvement_pct
FROM {source} GROUP BY {by}"""
