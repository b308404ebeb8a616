"""The command line from raw text to a blended report, on a small made panel."""

import json

import pytest
from pyspark.sql import functions as F

from panelwright import cli
from panelwright.config import configured
from panelwright.operators import mlp
from panelwright.sources.synthetic import made_panel


@pytest.mark.filterwarnings("ignore")
def test_from_text_to_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setitem(mlp.DEFAULTS, "epochs", 2)
    at = lambda name: str(tmp_path / name)
    report = lambda name: json.loads((tmp_path / name).read_text())
    made = made_panel(spark, configured("FULL"), 4, 30)
    made.withColumn("row_id", F.lit("x")).write.option("header", True).csv(at("raw.csv"))
    assert cli.main(["ingest", "--csv", at("raw.csv"), "--out", at("panel"), "--manifest", at("manifest.json")]) == 0
    m = report("manifest.json")
    assert m["coverage"]["rows"] == made.count() and m["invariants"] == {"off_grid": 0, "wrong_time_id": 0, "unordered_sessions": 0, "repeated_keys": 0}
    assert not (tmp_path / "panel.staging").exists()
    data = ["--panel", at("panel"), "--preset", "SMOKE"]
    assert cli.main(["baselines", *data, "--out", at("base.json")]) == 0
    base = report("base.json")
    assert {r["model"] for r in base["scorecard"]} == {"zero", "constant_median", "carry_raw", "carry_shrunk", "ridge", "ridge_noscale"} and len(base["folds"]) == 3
    few = ["--trees", "2"]
    assert cli.main(["features", *data, *few, "--out", at("features.json"), "--arm", at("arm"), "--before", at("base.json")]) == 0
    assert all(abs(r["difference_bps"]) < 1e-9 for r in report("features.json")["replica"] if r["model"] in ("zero", "ridge"))
    assert cli.main(["ensemble", *data, *few, "--arm", at("arm"), "--out", at("ensemble.json")]) == 0
    both = report("ensemble.json")
    assert {"zero", "gbt_mem", "mlp_mem", "blend_fixed", "blend_forward"} == {r["model"] for r in both["scorecard"]} and both["weights"]["0"] == 0.5
    spark.read.parquet(at("arm")).where("date_id <> 29").write.partitionBy("model").parquet(at("arm2"))
    with pytest.raises(ValueError, match="other rows"):
        cli.main(["ensemble", *data, *few, "--arm", at("arm2"), "--out", at("x.json")])
