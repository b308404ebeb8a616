"""Reproduction checks: structural comparison of manifests, file digests, the table of published results."""

from __future__ import annotations

import hashlib
import json
import math
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that say when and by what a manifest was built, not what is in the data.
NOISE_KEYS = {"built_at_utc", "build_seconds", "mtime_utc", "smoke_rebuilt_at_utc", "versions", "sha256", "bytes"}
REL_TOL, ABS_TOL = 1e-9, 1e-12


@dataclass
class Difference:
    mismatches: list[str] = field(default_factory=list)
    compared: int = 0
    worst_relative: float = 0.0

    @property
    def ok(self) -> bool:
        return not self.mismatches


def flatten(x, path: str = "") -> dict[str, object]:
    """Leaves by path; containers leave a marker of their kind and size."""
    if isinstance(x, dict):
        out: dict[str, object] = {f"{path}/": "dict"}
        for k in x:
            if k not in NOISE_KEYS:
                out |= flatten(x[k], f"{path}/{k}")
        return out
    if isinstance(x, (list, tuple)):
        out = {f"{path}[]": f"list of {len(x)}"}
        for i, v in enumerate(x):
            out |= flatten(v, f"{path}[{i}]")
        return out
    return {path: x}


def compare_manifests(a: dict, b: dict) -> Difference:
    """Floats within tolerance (an int may stand for an equal float); everything else equal in type and value."""
    left, right, out = flatten(a), flatten(b), Difference()
    for path in sorted(left.keys() | right.keys()):
        if path not in left or path not in right:
            out.mismatches.append(f"{path}: on one side only")
            continue
        x, y = left[path], right[path]
        out.compared += 1
        number = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y))
        if number and (isinstance(x, float) or isinstance(y, float)):
            if x == y or (math.isnan(x) and math.isnan(y)):
                continue
            if not math.isclose(x, y, rel_tol=REL_TOL, abs_tol=ABS_TOL):
                out.mismatches.append(f"{path}: {x!r} and {y!r}")
            else:
                out.worst_relative = max(out.worst_relative, abs(x - y) / max(abs(x), abs(y)))
        elif type(x) is not type(y) or x != y:
            out.mismatches.append(f"{path}: {x!r} and {y!r}")
    return out


def committed_manifest(repo: str, ref: str, path: str) -> dict:
    return json.loads(subprocess.run(["git", "-C", repo, "show", f"{ref}:{path}"], check=True, capture_output=True, text=True).stdout)


def file_digest(path: str, block: int = 4 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            h.update(chunk)
    return h.hexdigest()


def published_table(spark: SparkSession, bench: dict, reports: list[tuple[dict, list[tuple[str, str]], str]]) -> DataFrame:
    """Published and own results with the improvement over zero on the same rows, null where no zero is known.

    ``reports``: (report, [(model, label)], source); reports of a preset other than FULL give no rows.
    """
    zeros = [(k, float(v["mae_bps"])) for k, v in bench["zero_baseline"].items() if v and v.get("mae_bps") is not None]
    zero = spark.createDataFrame(zeros, "leaderboard string, zero_mae_bps double")
    rows = [(e["name"], e["leaderboard"], float(e["mae_bps"]), f"{e['source_url']} ({e['source_type']})") for e in bench["entries"]]
    schema = "entry string, leaderboard string, mae_bps double, source string"
    out = spark.createDataFrame(rows, schema).join(F.broadcast(zero), "leaderboard", "left")
    own = []
    for report, arms, source in reports:
        if report.get("preset") == "FULL":
            card = {r["model"]: float(r["mae_bps"]) for r in report["scorecard"]}
            own += [(label, "cv", card[m], f"{source} ({m})", card["zero"]) for m, label in arms if m in card]
    if own:
        out = out.unionByName(spark.createDataFrame(own, schema + ", zero_mae_bps double"))
    gain = F.col("zero_mae_bps") - F.col("mae_bps")
    out = out.withColumns({"improvement_bps": gain, "improvement_pct": 100 * gain / F.col("zero_mae_bps")})
    return out.orderBy(F.col("improvement_pct").desc_nulls_last(), "mae_bps")


def render_markdown(table: DataFrame) -> str:
    names = ["entry", "leaderboard", "mae_bps", "zero_mae_bps", "improvement_bps", "improvement_pct", "source"]
    show = lambda x: "—" if x is None or isinstance(x, float) and not math.isfinite(x) else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in table.collect())]) + "\n"
