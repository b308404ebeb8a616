"""Features, metrics, folds, models and blends against hand-computed values and their invariants."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.config import PRESETS, ConfigError, configured
from panelwright.operators import blend, cv, features, folds, integrity, metrics, mlp, models, profile, reveal, seeding
from panelwright.schema import KEY, SchemaError, check_buckets, check_schema, nan_to_null
from panelwright.sources import panel as source
from panelwright.sources.derived import CFG, panel

BASE = {"stock_id": 1, "date_id": 0, "seconds_in_bucket": 0, "imbalance_size": 1000.0, "imbalance_buy_sell_flag": 1, "reference_price": 1.0, "matched_size": 10000.0, "far_price": None, "near_price": None, "bid_price": 0.9999, "bid_size": 100.0, "ask_price": 1.0001, "ask_size": 300.0, "wap": 1.0, "target": 0.0}
SCHEMA = "stock_id long, date_id long, seconds_in_bucket long, imbalance_size double, imbalance_buy_sell_flag long, reference_price double, matched_size double, far_price double, near_price double, bid_price double, bid_size double, ask_price double, ask_size double, wap double, target double"
FULL = PRESETS["FULL"]


def frame(spark, *rows):
    return spark.createDataFrame([tuple((BASE | r)[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "change, feature, value",
    [
        ({"wap": 1.0005}, "wap_minus_reference_bps", 5),
        ({"bid_price": 0.999, "ask_price": 1.001}, "spread_bps", 20),
        ({}, "imbalance_ratio", 0.1),
        ({"imbalance_buy_sell_flag": -1}, "imbalance_ratio", -0.1),
        ({"imbalance_buy_sell_flag": 0}, "imbalance_ratio", 0),
        ({}, "size_imbalance", -0.5),
        ({"near_price": 1.0002}, "near_minus_wap_bps", 2),
        ({"far_price": 0.9997}, "far_minus_wap_bps", -3),
        ({}, "near_minus_wap_bps", 0),
        ({}, "near_is_missing", 1),
        ({"bid_size": 0.0, "ask_size": 0.0}, "size_imbalance", 0),
        ({"matched_size": 0.0}, "imbalance_ratio", 0),
        ({"seconds_in_bucket": 270}, "seconds_frac_sq", 0.25),
        ({"wap": None, "reference_price": None, "bid_price": None, "ask_price": None}, "book_is_missing", 1),
        ({"wap": None, "reference_price": None, "bid_price": None, "ask_price": None}, "wap_minus_reference_bps", 0),
    ],
)
def test_row_feature(spark, change, feature, value):
    assert features.build_row_features(frame(spark, change), FULL).first()[feature] == pytest.approx(value, abs=1e-9)


def test_missing_value_on_a_row_with_a_book_is_refused(spark):
    features.check_features(frame(spark, {}), FULL)
    with pytest.raises(ValueError, match="reference"):
        features.check_features(frame(spark, {"reference_price": None}), FULL)
    with pytest.raises(ValueError):
        features.check_features(nan_to_null(frame(spark, {"wap": float("inf")})), FULL)


def test_families_cover_the_memory_features():
    assert {c for f in features.FAMILIES.values() for c in f} == set(features.MEMORY_FEATURES)
    assert len(features.ALL_FEATURES) == 31 == len(set(features.ALL_FEATURES))


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return panel(spark, sf_dir).where("date_id < 30").persist()


def built(df):
    return features.build_memory_features(reveal.add_revealed_target(df), CFG).select(*KEY, *features.ALL_FEATURES)


def same(a, b):
    a, b = (x.toPandas().set_index(KEY).sort_index() for x in (a, b))
    b = b.loc[a.index]
    assert np.allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9)


@pytest.mark.parametrize("second", [0, 50, 80])
def test_features_do_not_see_later_buckets(spark, small, second):
    last = small.agg(F.max("date_id")).first()[0]
    cut = (F.col("date_id") < last) | (F.col("seconds_in_bucket") <= second)
    # The target is given with the row, so only its own date's later rows are cut.
    same(built(small.where(cut)), built(small))


def test_features_do_not_see_later_dates(spark, small):
    same(built(small.where("date_id <= 15")), built(small))


def test_own_date_target_moves_only_later_state(spark, small):
    moved = small.withColumn("target", F.when(F.col("date_id") == 10, F.col("target") * 10).otherwise(F.col("target")))
    a, b = (built(x).toPandas().set_index(KEY).sort_index() for x in (small, moved))
    date = a.index.get_level_values("date_id")
    diff = (a - b).abs().sum(axis=1)
    assert diff[date <= 10].max() == 0
    assert diff[date == 11].sum() > 0


def test_window_feature_invariants(spark, small):
    d = built(small).toPandas()
    assert d[d.seconds_in_bucket == 0][["wap_ret_1b_bps", "wap_vol_6b_bps"]].abs().to_numpy().max() == 0
    assert d.groupby(["date_id", "seconds_in_bucket"]).wap_ret_1b_cs.mean().abs().max() < 1e-9
    assert d.imb_ratio_cs_rank.between(-0.5, 0.5).all()
    assert (d[d.seconds_in_bucket <= 50].near_wap_chg_1b_bps == 0).all()


def test_average_rank_matches_pandas(spark):
    from panelwright.functions.columns import average_rank_pct
    from panelwright.operators.frames import instant

    v = [3.0, 1.0, 1.0, None, 2.0, 2.0, 2.0, -0.0, 0.0]
    df = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(v)], "date_id int, seconds_in_bucket int, i int, v double")
    got = [r[0] for r in df.withColumn("r", average_rank_pct(F.col("v"), instant())).orderBy("i").select("r").collect()]
    want = pd.Series(v).rank(pct=True)
    assert all((g is None and math.isnan(w)) or g == pytest.approx(w) for g, w in zip(got, want))


def test_revealed_is_the_previous_date_or_nothing(spark):
    df = frame(spark, *({"date_id": d, "target": float(d)} for d in (0, 1, 3, 4)))
    for f in (reveal.add_revealed_target, reveal.add_revealed_target_by_join):
        assert [r.revealed_target for r in f(df).orderBy("date_id").collect()] == [None, 0.0, None, 3.0]


def test_index_leg_is_common_at_the_right_lag_only(spark):
    rng = np.random.default_rng(1)
    steps, stocks = 55 + 6, 20
    wap = 1 + rng.normal(0, 1e-4, (stocks, steps)).cumsum(axis=1)
    index = np.average(wap, axis=0, weights=rng.random(stocks))
    rows = [{"stock_id": s, "seconds_in_bucket": 10 * t, "wap": float(wap[s, t]), "target": float(1e4 * ((wap[s, t + 6] / wap[s, t]) - index[t + 6] / index[t]))} for s in range(stocks) for t in range(55)]
    df = frame(spark, *rows).persist()
    spread = {k: reveal.leg_spread(reveal.index_leg(df, FULL, k)).agg(F.median("leg_std")).first()[0] for k in (5, 6, 7)}
    assert spread[6] < 1e-8 and min(spread[5], spread[7]) > 50 * spread[6]


def vectors(spark, y, p, by=None):
    return spark.createDataFrame([(float("nan") if a is None and False else a, b, g) for a, b, g in zip(y, p, by or [0] * len(y))], "target double, prediction double, g int")


def test_mae_contract(spark):
    assert metrics.mae(vectors(spark, [1.0, -2.0, 3.5, 0.0], [0.0, 0.0, 0.0, 1.0])) == 1.875
    assert metrics.mae(vectors(spark, [1.0, None, 3.0], [0.0, 0.0, 0.0])) == 2.0
    for y, p in (([1.0, 2.0, 3.0], [0.0, None, 0.0]), ([1.0], [float("nan")]), ([None], [0.0])):
        with pytest.raises(metrics.MetricError):
            metrics.mae(vectors(spark, y, p))
    d = metrics.breakdown(vectors(spark, [1.0, 3.0, -10.0, 10.0], [0.0] * 4, [0, 0, 1, 1]), "g").orderBy("g").collect()
    assert [r.mae for r in d] == [2.0, 10.0]


def test_fold_table(spark):
    f = spark.createDataFrame([("zero", 0, 7.0), ("zero", 1, 5.0), ("m", 0, 6.9), ("m", 1, 4.9)], "model string, fold int, mae_bps double")
    r = {x.model: x for x in metrics.fold_table(f, [0, 1]).collect()}
    assert r["m"].mean_vs_zero == pytest.approx(0.1) and r["m"].std == pytest.approx(1.0) and r["m"].std_with_mean == pytest.approx(math.sqrt(2 / 3))


def test_describe_matches_pandas(spark):
    v = pd.Series(np.random.default_rng(0).gamma(2, 3, 500))
    r = profile.describe_target(spark.createDataFrame(pd.DataFrame({"target": v}))).first()
    assert r.skew == pytest.approx(v.skew()) and r.excess_kurtosis == pytest.approx(v.kurt()) and r["std"] == pytest.approx(v.std(ddof=0))
    q = {x.quantile: x.value for x in profile.target_quantiles(spark.createDataFrame(pd.DataFrame({"target": v}))).collect()}
    assert all(q[k] == pytest.approx(np.quantile(v, k)) for k in q)


def config(k, v, e, m=None):
    return configured("FULL", n_folds=k, val_dates_per_fold=v, embargo_dates=e, max_train_dates=m)


@pytest.mark.parametrize("axis, cfg", [(range(100), config(5, 10, 3)), (range(0, 350, 7), config(4, 8, 3)), ([*range(8), *range(20, 40), *range(60, 90)], config(3, 8, 2))])
def test_fold_invariants(axis, cfg):
    made = folds.make_folds(axis, cfg)
    axis = sorted(axis)
    assert len(made) == cfg.n_folds
    assert [d for f in made for d in f.val_dates] == axis[-cfg.n_folds * cfg.val_dates_per_fold :]
    for f in made:
        at = axis.index(f.val_dates[0])
        assert list(f.train_dates) == axis[: at - cfg.embargo_dates] and list(f.embargoed) == axis[at - cfg.embargo_dates : at]
    assert all(set(a.train_dates) <= set(b.train_dates) for a, b in zip(made, made[1:]))


def test_fold_edges():
    with pytest.raises(ValueError):
        folds.make_folds(range(32), config(3, 10, 2))
    assert folds.make_folds(range(33), config(3, 10, 2))[0].train_dates == (0,)
    assert all(len(f.train_dates) == 5 for f in folds.make_folds(range(100), config(3, 10, 2, 5)))
    with pytest.raises(ValueError):
        configured("FULL", n_folds=0)
    for leaky in (folds.Fold(0, (1, 2, 3), (4, 5), ()), folds.Fold(0, (1, 2), (2, 9), (3, 4)), folds.Fold(0, (2, 1), (8, 9), (3, 4)), folds.Fold(0, (), (8,), (3, 4))):
        with pytest.raises(folds.LeakError):
            folds.check_fold(leaky, 2)
    left, held = folds.inner_split(range(20), 0.1, 3)
    assert held == [18, 19] and left == list(range(15))
    with pytest.raises(ValueError):
        folds.inner_split(range(3), 0.5, 2)


@pytest.mark.filterwarnings("ignore")
def test_cv_predicts_validation_rows_once(spark, sf_dir):
    r = cv.run_cv(panel(spark, sf_dir), CFG, [models.Zero(), models.Carry("carry_raw", 1.0)], lambda d, c: d)
    val = {d for f in r.folds for d in f.val_dates}
    oof = r.oof.toPandas()
    assert set(oof.date_id) <= val and not oof.duplicated([*KEY, "model"]).any()
    card = {x.model: x for x in metrics.scorecard(r.oof).collect()}
    assert card["zero"].mae_bps == pytest.approx(oof[oof.model == "zero"].target.abs().mean()) and card["zero"].vs_zero_bps == 0


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 100, 0]
    y = x @ [1.0, -0.3, 4.0] + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "target"]))
    m = models.Ridge(columns=["a", "b", "c"], alpha=7.0, rescale=False, skip=[]).fit(df, configured("FULL", fit_clip_bps=30.0))
    lo, hi = np.quantile(x, 0.001, axis=0), np.quantile(x, 0.999, axis=0)
    z = np.clip(x, lo, hi)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    t = np.clip(y, -30, 30)
    assert np.allclose(m.coef, np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (t - t.mean())), atol=1e-10)
    p = m.predict(df).toPandas()
    assert np.allclose(p.prediction, z @ m.coef + t.mean(), atol=1e-9)


def test_bounds_keep_rare_flags(spark):
    df = spark.range(2000).select((F.col("id") < 2).cast("double").alias("book_is_missing"), F.col("id").cast("double").alias("spread_bps"))
    b = models.quantile_bounds(df, ["book_is_missing", "spread_bps"])
    assert set(b) == {"spread_bps"}
    assert df.select(models.clipped("book_is_missing", b).alias("x")).agg(F.sum("x")).first()[0] == 2


def test_scale_is_recovered(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "target": 0.35 * p}))
    from panelwright.operators.grid import optimal_scale

    assert optimal_scale(df, F.col("target"), F.col("p")) == pytest.approx(0.35, abs=1e-9)
    assert optimal_scale(df, F.col("target"), F.lit(0.0)) == 0.0


def test_blends(spark):
    rows = []
    rng = np.random.default_rng(4)
    for fold in (0, 1, 2):
        for i in range(60):
            y = float(rng.normal())
            noise = y + float(rng.normal())
            # a is exact on folds before the last and noisy there; b the reverse.
            rows.append((i, fold, y, noise if fold == 2 else y, y if fold == 2 else noise))
    pairs = spark.createDataFrame(rows, "i int, fold int, target double, a double, b double")
    w = blend.forward_weights(pairs, [0, 1, 2])
    assert w == {0: 0.5, 1: 1.0, 2: 1.0}
    assert blend.optimal_weight(pairs.where("fold = 2")) == 0.0
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            blend.blend_fixed(pairs, bad)
    with pytest.raises(ValueError):
        blend.optimal_weight(pairs.where("fold = 9"))
    out, _ = blend.blend_forward(pairs.withColumn("b", F.col("a")), [0, 1, 2])
    assert out.where("abs(prediction - a) > 1e-12").count() == 0


def test_manifest_comparison():
    m = {"rows": 10, "kurtosis": 3.0, "ok": True, "list": [1, 2.5], "build_seconds": 4}
    assert integrity.compare_manifests(m, json.loads(json.dumps(m))).ok
    assert integrity.compare_manifests(m, m | {"kurtosis": 3.0 * (1 + 2e-15)}).ok
    assert integrity.compare_manifests(m, m | {"build_seconds": 99}).ok
    assert integrity.compare_manifests(m, m | {"rows": 10.0}).ok
    for change in ({"kurtosis": 3.0 * (1 + 1e-6)}, {"rows": 9}, {"ok": 1}, {"list": [1]}, {"list": [1, "2.5"]}, {"more": 1}):
        assert not integrity.compare_manifests(m, m | change).ok


def test_published_results(spark):
    bench = {"zero_baseline": {"public": {"mae_bps": 5.4}, "private": None}, "entries": [{"name": "x", "mae_bps": 5.3, "leaderboard": "public", "source_url": "https://e", "source_type": "post"}, {"name": "y", "mae_bps": 5.2, "leaderboard": "private", "source_url": "https://e", "source_type": "post"}]}
    smoke = {"preset": "SMOKE", "scorecard": [{"model": "zero", "mae_bps": 1.0}]}
    full = {"preset": "FULL", "scorecard": [{"model": "zero", "mae_bps": 6.0}, {"model": "m", "mae_bps": 5.7}]}
    t = integrity.published_table(spark, bench, [(smoke, [("zero", "z")], "s"), (full, [("m", "own")], "f")])
    r = t.collect()
    assert [x.entry for x in r] == ["own", "x", "y"] and r[2].improvement_pct is None and r[0].improvement_pct == pytest.approx(5.0)
    assert "—" in integrity.render_markdown(t)


def test_streams_depend_on_their_path_alone():
    draw = lambda *path: seeding.stream(*path).random()
    assert draw("a") == draw("a") != draw("b") and draw("a", "x") != draw("a", "y") != draw("a", 1)
    assert seeding.spark_seed("trees", "m") == seeding.spark_seed("trees", "m") >= 0


def test_configurations_are_checked_whole():
    with pytest.raises(ConfigError, match="n_folds.*embargo_dates|embargo_dates.*n_folds"):
        configured("FULL", n_folds=0, embargo_dates=-1)
    with pytest.raises(ConfigError, match="did you mean 'n_folds'"):
        configured("FULL", n_fold=3)
    with pytest.raises(ConfigError, match="no preset"):
        configured("NONE")
    assert configured().name == "SMOKE" == configured(panel="/no/such/panel").name and configured(panel=__file__).name == "FULL"
    assert len(configured("FULL").buckets) == 55


def test_made_panel_and_guards(spark):
    from panelwright.operators.reveal import add_revealed_target, leg_summary
    from panelwright.schema import SchemaError, check_schema, nan_to_null, widen
    from panelwright.sources.synthetic import made_panel

    cfg = configured("FULL", n_folds=2, val_dates_per_fold=3, embargo_dates=1)
    made = made_panel(spark, cfg, 6, 12)
    check_schema(made)
    df = widen(nan_to_null(made)).persist()
    assert df.count() == made.repartition(5).count() and profile.invariants(df, cfg).first().asDict() == {"off_grid": 0, "wrong_time_id": 0, "unordered_sessions": 0, "repeated_keys": 0}
    assert df.where("wap is null").count() == 110 and df.where("seconds_in_bucket < 300 and far_price is not null").count() == 0
    leg = leg_summary(df, cfg, (5, 7)).first()
    assert leg.median_std < 0.05 and leg.ratio_lag_5 > 20 and leg.ratio_lag_7 > 20
    r = cv.run_cv(df, cfg, [models.Zero(), models.ConstantMedian(), models.Carry(), models.Ridge()], features.build_row_features)
    card = {x.model: x for x in metrics.scorecard(metrics.on_common_rows(r.oof, KEY)).collect()}
    assert set(card) == {"zero", "constant_median", "carry_shrunk", "ridge"} and all(x.coverage == 1 for x in card.values())
    # One fold at a time gives the same ridge as all folds at once.
    data = cv.prepare(df, cfg, features.build_row_features)
    f = r.folds[1]
    one = models.Ridge().fit(data.where(F.col("date_id").isin(list(f.train_dates))), cfg)
    assert dict(one.coefficients()) == pytest.approx(dict(r.coefficients["ridge", 1]), rel=1e-6, abs=1e-9)
    r.release()
    with pytest.raises(SchemaError, match="repeated keys"):
        cv.run_cv(df.union(df.limit(1)), cfg, [models.Zero()], features.build_row_features)
    broken = df.withColumn("reference_price", F.when(F.col("stock_id") != 3, F.col("reference_price")))
    with pytest.raises(Exception, match="wap_minus_reference_bps is not finite|reference_minus_mid_bps is not finite"):
        features.build_row_features(broken, cfg).agg(F.sum("wap_minus_reference_bps"), F.sum("reference_minus_mid_bps")).collect()
    with pytest.raises(Exception, match="is not finite|DIVIDE_BY_ZERO"):
        features.build_memory_features(add_revealed_target(df.withColumn("wap", F.when(F.col("stock_id") == 3, 0.0).otherwise(F.col("wap")))), cfg).agg(F.sum("wap_ret_1b_bps"), F.sum("wap_ret_6b_bps"), F.sum("wap_vol_6b_bps")).collect()
    with pytest.raises(metrics.MetricError, match="m, fold 0"):
        metrics.check_scored(spark.createDataFrame([(0, "m", 1.0, None), (0, "z", 1.0, 2.0)], "fold int, model string, target double, prediction double"))
    df.unpersist()


def test_arms_pass_between_processes(spark, tmp_path):
    oof = spark.createDataFrame([(1, 2, 0, 0, "zero", 1.0, 0.0), (1, 2, 0, 0, "m", 1.0, 0.5)], "stock_id int, date_id int, seconds_in_bucket int, fold int, model string, target double, prediction double")
    source.write_arm(oof, str(tmp_path / "arm"))
    assert metrics.reconcile(source.read_arm(spark, str(tmp_path / "arm")), oof, oof.columns) == {"only_left": 0, "only_right": 0}


def test_network_gradient():
    rng = np.random.default_rng(5)
    net = mlp.Net.new(rng, 3, 4, 2, (5, 4), np.zeros(3), np.ones(3))
    x, s, y = rng.normal(size=(9, 3)), rng.integers(0, 4, 9), rng.normal(size=9)
    g = net.gradient(x, s, y, None, 0.0)
    loss = lambda: np.abs(net.forward(x, s)[0] - y).mean()
    for k in net.p:
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        keep = net.p[k][i]
        net.p[k][i] = keep + 1e-6
        up = loss()
        net.p[k][i] = keep - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[k][i], abs=1e-5)
        net.p[k][i] = keep


def test_nets_learn_on_one_partition_and_on_many(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 3))
    df = spark.createDataFrame([(k % 2, int(k % 4), k // 40, float(2 * v[0] - v[1]), *map(float, v)) for k, v in enumerate(x)], "fold int, stock_id int, date_id int, target double, a double, b double, c double")
    cfg = configured("SMOKE")

    def fit(rows_per_task):
        return mlp.Mlp("t", ["a", "b", "c"], 4, rows_per_task, {"hidden": (16,), "batch": 32, "epochs": 12, "rate": 3e-2, "dropout": 0.0}).fit_folds(df, cfg)

    one, again, many = fit(10_000), fit(10_000), fit(200)
    assert set(one.nets) == {0, 1} and one.summary == again.summary
    for m in (one, many):
        for f in (0, 1):
            h = m.summary[f]["history"]
            assert min(h) < h[0] and h[m.summary[f]["best_epoch"]] == min(h) and m.summary[f]["epochs"] == len(h) <= 12
        got = m.predict(df.where("fold = 1"), 1).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
        assert got < 0.6 * float(np.abs(2 * x[:, 0] - x[:, 1]).mean())


def test_sources(spark, sf_dir, tmp_path, small):
    with pytest.raises(source.MissingSource, match="ingest"):
        source.read_panel(spark, str(tmp_path / "none"), CFG)
    out = source.downcast(small)
    source.write_panel(out, str(tmp_path / "p"))
    back = source.read_panel(spark, str(tmp_path / "p"), CFG, columns=["wap", "target"])
    assert back.columns == [*KEY, "wap", "target"] and dict(back.dtypes)["wap"] == "double"
    assert back.count() == small.count()
    with pytest.raises(SchemaError):
        check_schema(small)
    with pytest.raises(SchemaError):
        check_buckets(small, [0, 10])
    assert profile.float32_gate(small.withColumn("target", F.col("target").cast("float").cast("double"))) == "float"
    assert profile.float32_gate(small.withColumn("target", F.col("target") * 1e6 + 0.1)) == "double"
    picked = source.block_sample(small, 4, 2, 3)
    assert picked.select("stock_id").distinct().count() == 4 and picked.select("date_id").distinct().count() == 6
    csv = tmp_path / "raw.csv"
    cols = ["stock_id", "date_id", "seconds_in_bucket", "imbalance_size", "imbalance_buy_sell_flag", "reference_price", "matched_size", "far_price", "near_price", "bid_price", "bid_size", "ask_price", "ask_size", "wap", "target", "time_id", "row_id"]
    csv.write_text(",".join(cols) + "\n" + "1,2,0,5.0,1,1.0,7.0,,,0.9,1,1.1,2,1.0,0.5,110,2_0_1\n")
    r = source.read_csv(spark, str(csv)).first()
    assert r.far_price is None and r.wap == 1.0 and "row_id" not in r.asDict()
    a = small.select(*KEY, "wap")
    assert metrics.reconcile(a, a, a.columns) == {"only_left": 0, "only_right": 0}


def test_one_exchange_serves_both_windows_after_repartition(spark, small):
    df = reveal.add_revealed_target(small).select(*KEY, "imbalance_size", "matched_size", "imbalance_buy_sell_flag", "wap", "revealed_target")
    from pyspark.sql import functions as G

    from panelwright.operators.frames import instant, session

    plan = lambda d: d.withColumn("x", G.lag("wap").over(session())).withColumn("y", G.avg("x").over(instant()))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(df.repartition("date_id")) < plan(df) + 1
