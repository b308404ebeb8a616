"""Command line: ingest, baselines, ablations, features, ensemble, check-manifest, compare."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelwright import config
from panelwright.operators import blend, cv, features, folds, integrity, metrics, mlp, models, profile, reveal
from panelwright.schema import KEY, PANEL
from panelwright.sources import panel as source


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def session() -> SparkSession:
    return SparkSession.builder.appName("panelwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(a) -> int:
    spark, began = session(), time.time()
    cfg = config.configured("FULL")
    staging = f"{a.out.rstrip('/')}.staging"
    source.read_csv(spark, a.csv).withColumn("time_id", source.time_id(cfg)).write.mode("overwrite").parquet(staging)  # the text is parsed once
    raw = spark.read.parquet(staging)
    kind = profile.float32_gate(raw)
    out = source.downcast(raw, kind)
    if not a.smoke_only:
        source.write_panel(out, a.out)
    if a.smoke:
        source.write_panel(source.block_sample(out), a.smoke)
    numeric = [f.name for f in PANEL if f.name not in KEY]
    parts = {
        "coverage": lambda: rows(profile.coverage(raw, cfg))[0],
        "invariants": lambda: rows(profile.invariants(raw, cfg))[0],
        "partial_sessions": lambda: rows(profile.partial_session_sizes(raw, cfg)),
        "thinnest_stocks": lambda: rows(profile.thinnest_stocks(raw, 10)),
        "missing_dates": lambda: rows(profile.date_gaps(raw))[0],
        "nulls": lambda: rows(profile.null_counts(raw, numeric)),
        "null_rate_by_bucket": lambda: rows(profile.null_rate_by_bucket(raw).orderBy("seconds_in_bucket")),
        "precision": lambda: rows(profile.precision_probe(raw, [c for c in numeric if c not in ("imbalance_buy_sell_flag", "time_id")])),
        "target": lambda: rows(profile.describe_target(raw))[0],
        "quantiles": lambda: rows(profile.target_quantiles(raw)),
    }
    made = dict(zip(parts, cv.at_once(lambda f: f(), list(parts.values()))))  # column-pruned scans, side by side
    source.write_json(a.manifest, {"target_type": kind, "dtypes": dict(out.dtypes), **made, "build_seconds": time.time() - began})
    source.remove(spark, staging)
    return 0


def loaded(a):
    spark = session()
    cfg = config.configured(a.preset or "FULL", date_stride=getattr(a, "date_stride", 1))
    return spark, cfg, source.read_panel(spark, a.panel, cfg)


def evaluation(spark, cfg, result: cv.CvResult, headline: str) -> dict:
    # Models are compared on the rows that all of them score.
    oof = metrics.on_common_rows(result.oof, KEY).persist()
    per = metrics.per_fold(oof)
    own = oof.where(F.col("model") == headline)
    by = {k: rows(metrics.consistency(metrics.breakdown(own, k)))[0] for k in ("date_id", "seconds_in_bucket", "stock_id")}
    return {
        "preset": cfg.name,
        "folds": rows(folds.describe(spark, result.folds)),
        "fold_table": rows(metrics.fold_table(per, [f.index for f in result.folds]).orderBy("mean")),
        "scorecard": rows(metrics.scorecard(oof).orderBy("mae_bps")),
        "consistency": by,
        "by_bucket": rows(metrics.breakdown(own, "seconds_in_bucket").orderBy("seconds_in_bucket")),
        "coefficients": {f"{m}/{f}": c for (m, f), c in result.coefficients.items()},
        "importance": {f"{m}/{f}": c for (m, f), c in result.importance.items()},
    }


def baselines(a) -> int:
    spark, cfg, df = loaded(a)
    result = cv.run_cv(df, cfg, cv.default_models(cfg), features.build_row_features)
    source.write_json(a.out, evaluation(spark, cfg, result, "ridge") | {"coverage": rows(profile.coverage(df, cfg))[0], "target": rows(profile.describe_target(df))[0]})
    return 0


def ablations(a) -> int:
    spark, cfg, df = loaded(a)
    data = cv.prepare(df, cfg, features.build_row_features).persist()
    made = folds.make_folds(folds.date_axis(data), cfg)
    out = {
        "preset": cfg.name,
        "ridge": cv.ridge_ablations(data, cfg, made),
        "sd_inflation": models.sd_inflation(data),
        "index_leg": rows(reveal.leg_summary(df, cfg, (cfg.horizon - 1, cfg.horizon + 1)))[0],
        "autocorrelation": rows(profile.carry_autocorrelation_summary(data))[0],
        "dispersion": rows(profile.stock_dispersion_summary(data))[0],
        "empty_books": rows(profile.empty_books(df)),
    }
    source.write_json(a.out, out)
    return 0


def memory(a) -> int:
    spark, cfg, df = loaded(a)
    result = cv.run_cv(df, cfg, cv.memory_models(cfg, a.ablate, trees=a.trees))
    out = evaluation(spark, cfg, result, "gbt_mem")
    if a.arm:
        source.write_arm(result.oof, a.arm)
    if a.before:
        before = spark.createDataFrame([(r["model"], float(r["mae_bps"])) for r in source.read_json(a.before)["scorecard"]], "model string, mae_bps double")
        out["replica"] = rows(metrics.replica_check(metrics.scorecard(result.oof), before))
    source.write_json(a.out, out)
    return 0


def ensemble(a) -> int:
    spark, cfg, df = loaded(a)
    if a.arm:  # another process has run the trees: its rows must be this panel's
        made = folds.make_folds(folds.date_axis(cv.prepare(df, cfg, lambda d, c: d)), cfg)
        trees = cv.CvResult(made, source.read_arm(spark, a.arm).where(F.col("model").isin("zero", "gbt_mem")))
        mine = folds.assign(df.where("target is not null"), made, "validation").select(*KEY, "fold")
        differ = metrics.reconcile(trees.oof.where("model = 'zero'"), mine, [*KEY, "fold"])
        if any(differ.values()):
            raise ValueError(f"the arm at {a.arm} was run on other rows: {differ}")
    else:
        trees = cv.run_cv(df, cfg, [m for m in cv.memory_models(cfg, trees=a.trees) if m.name in ("zero", "gbt_mem")])
    data = cv.prepare(df, cfg).persist()
    net = mlp.Mlp().fit_folds(folds.assign(data, trees.folds, "train"), cfg)
    oof = trees.oof
    for f in trees.folds:
        val = data.where(F.col("date_id").isin(list(f.val_dates)))
        oof = oof.unionByName(net.predict(val, f.index).select(*KEY, F.lit(f.index).alias("fold"), F.lit(net.name).alias("model"), "target", "prediction"))
    pairs = blend.pair_up(oof, "gbt_mem", net.name, KEY)
    forward, weights = blend.blend_forward(pairs, [f.index for f in trees.folds])
    for name, p in (("blend_fixed", blend.blend_fixed(pairs, 0.5)), ("blend_forward", forward)):
        oof = oof.unionByName(p.select(*KEY, "fold", F.lit(name).alias("model"), "target", "prediction"))
    result = cv.CvResult(trees.folds, oof)
    out = evaluation(spark, cfg, result, "blend_forward") | {"weights": weights, "training": net.summary}
    out["paired"] = rows(metrics.paired(metrics.per_fold(oof), "blend_forward"))
    source.write_json(a.out, out)
    return 0


def check_manifest(a) -> int:
    d = integrity.compare_manifests(integrity.committed_manifest(a.repo, a.ref, a.path), source.read_json(a.rebuilt))
    print(f"{d.compared} values compared; worst float deviation {d.worst_relative:.1e}" if d.ok else "\n".join(d.mismatches))
    return 0 if d.ok else 1


def compare(a) -> int:
    reports = [(source.read_json(p), [(m, f"own: {m}") for m in a.models], p) for p in a.reports]
    with open(a.out, "w") as f:
        f.write(integrity.render_markdown(integrity.published_table(session(), source.read_json(a.benchmarks), reports)))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="panelwright")
    sub = p.add_subparsers(required=True)

    def command(name, f, *options):
        c = sub.add_parser(name)
        for flag, kw in options:
            c.add_argument(flag, **kw)
        c.set_defaults(run=f)

    need, data, out = {"required": True}, ("--panel", {"required": True}), ("--out", {"required": True})
    preset, trees = ("--preset", {"choices": sorted(config.PRESETS)}), ("--trees", {"type": int, "default": 500})
    command("ingest", ingest, ("--csv", need), out, ("--manifest", need), ("--smoke", {}), ("--smoke-only", {"action": "store_true"}))
    command("baselines", baselines, data, preset, out, ("--date-stride", {"type": int, "default": 1}))
    command("ablations", ablations, data, preset, out)
    command("features", memory, data, preset, out, trees, ("--ablate", {"action": "store_true"}), ("--arm", {}), ("--before", {}))
    command("ensemble", ensemble, data, preset, out, trees, ("--arm", {}))
    command("check-manifest", check_manifest, ("--repo", {"default": "."}), ("--ref", {"default": "HEAD"}), ("--path", need), ("--rebuilt", need))
    command("compare", compare, ("--benchmarks", need), ("--reports", {"nargs": "*", "default": []}), ("--models", {"nargs": "*", "default": []}), out)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    raise SystemExit(main())
