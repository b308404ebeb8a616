"""A multi-layer perceptron with a stock embedding under absolute loss, trained on the executors.

MLlib has no such regressor. Training is data-parallel, all folds at once: rows are dealt to
partitions once and cached; an epoch is one job in which every partition takes Adam steps over its
own rows from the folds' current parameters, and the driver averages what comes back, weighted by
rows (a net's parameters per partition and fold, whatever the number of rows). The same job measures
the parameters it starts from on the held-out dates, which decides when a fold stops. On a single
partition this is ordinary mini-batch Adam. Prediction is a vectorised UDF over partitions of any size.
"""

from __future__ import annotations

import copy
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import Config
from panelwright.operators.features import ALL_FEATURES
from panelwright.operators.folds import inner_split
from panelwright.operators.seeding import stream


@dataclass
class Net:
    """Parameters and the forward and backward passes; float64 throughout."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    sd: np.ndarray
    layers: int

    @classmethod
    def new(cls, rng: np.random.Generator, features: int, stocks: int, embed: int, hidden: tuple[int, ...], mean, sd) -> Net:
        p = {"e": rng.normal(0, 0.05, (stocks + 1, embed))}
        sizes = [features + embed, *hidden, 1]
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            p[f"w{k}"], p[f"b{k}"] = rng.normal(0, np.sqrt(2 / a), (a, b)) * (0.1 if b == 1 else 1), np.zeros(b)
        return cls(p, mean, sd, len(sizes) - 1)

    def forward(self, x: np.ndarray, stock: np.ndarray, rng: np.random.Generator | None = None, dropout: float = 0.0):
        h = np.concatenate([(x - self.mean) / self.sd, self.p["e"][stock]], axis=1)
        kept = [(h, None)]
        for k in range(self.layers):
            h = h @ self.p[f"w{k}"] + self.p[f"b{k}"]
            if k < self.layers - 1:
                keep = h > 0
                if rng is not None and dropout:
                    keep = keep * (rng.random(h.shape) >= dropout) / (1 - dropout)
                h = h * keep
                kept.append((h, keep))
        return h[:, 0], kept

    def gradient(self, x, stock, y, rng, dropout):
        out, kept = self.forward(x, stock, rng, dropout)
        d = (np.sign(out - y) / len(y))[:, None]
        g = {}
        for k in range(self.layers - 1, -1, -1):
            h, _ = kept[k]
            g[f"w{k}"], g[f"b{k}"] = h.T @ d, d.sum(axis=0)
            d = d @ self.p[f"w{k}"].T
            if k:
                d = d * kept[k][1]
        e = np.zeros_like(self.p["e"])
        np.add.at(e, stock, d[:, len(self.mean) :])
        g["e"] = e
        return g


@dataclass
class Training:
    """A net under way with Adam's moments; what travels between driver and tasks."""

    net: Net
    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)
    step: int = 0

    def __post_init__(self) -> None:
        for moments in (self.m, self.v):
            for k, x in self.net.p.items():
                moments.setdefault(k, np.zeros_like(x))

    def epoch(self, x, stock, y, order: np.random.Generator, drop: np.random.Generator, rate: float, decay: float, batch: int, dropout: float) -> Training:
        perm = order.permutation(len(y))
        p = self.net.p
        for a in range(0, len(perm), batch):
            i = perm[a : a + batch]
            g = self.net.gradient(x[i], stock[i], y[i], drop, dropout)
            self.step += 1
            for k in p:
                gk = g[k] + decay * p[k]
                self.m[k] = 0.9 * self.m[k] + 0.1 * gk
                self.v[k] = 0.999 * self.v[k] + 0.001 * gk * gk
                p[k] = p[k] - rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)
        return self

    @staticmethod
    def average(parts: list[tuple[int, Training]]) -> Training:
        """Weighted by rows; the longest run of steps corrects the moments' bias."""
        total = sum(n for n, _ in parts)
        mean = lambda pick: {k: sum(n * pick(t)[k] for n, t in parts) / total for k in parts[0][1].net.p}
        first = parts[0][1].net
        return Training(Net(mean(lambda t: t.net.p), first.mean, first.sd, first.layers), mean(lambda t: t.m), mean(lambda t: t.v), max(t.step for _, t in parts))


@dataclass
class Progress:
    """Early stopping of one fold."""

    state: Training
    history: list[float] = field(default_factory=list)
    best: float = np.inf
    best_at: int = 0
    kept: dict[str, np.ndarray] | None = None
    done: bool = False

    def measured(self, loss: float, patience: int) -> None:
        """``loss`` of the current parameters, after one more epoch."""
        self.history.append(loss)
        if loss < self.best:
            self.best, self.best_at, self.kept = loss, len(self.history) - 1, {k: x.copy() for k, x in self.state.net.p.items()}
        self.done = len(self.history) - 1 - self.best_at >= patience


#: The shape and the schedule.
DEFAULTS = {"embed": 8, "hidden": (256, 128, 64), "dropout": 0.1, "rate": 1e-3, "decay": 1e-5, "batch": 4096, "epochs": 20, "patience": 3, "holdout": 0.1, "embargo": 2}


@dataclass
class Mlp:
    name: str = "mlp_mem"
    columns: list[str] = field(default_factory=lambda: list(ALL_FEATURES))
    stocks: int = 200
    #: Rows that a task holds as a matrix, about.
    rows_per_task: int = 1_000_000
    options: dict = field(default_factory=dict)
    nets: dict[int, Net] = field(default_factory=dict)
    summary: dict[int, dict] = field(default_factory=dict)

    def fit_folds(self, df: DataFrame, cfg: Config, by: str = "fold") -> Mlp:
        """One net per fold from training rows with a column ``by``."""
        o = DEFAULTS | {"embargo": cfg.embargo_dates} | self.options
        columns, stocks, label = self.columns, self.stocks, self.name
        rows = df.where("target is not null").select(F.col(by).cast("int").alias("fold"), F.col("stock_id").cast("int"), F.col("date_id").cast("int"), F.col("target").cast("double"), *(F.col(c).cast("double") for c in columns))
        axes: dict[int, list[int]] = {}
        for r in rows.select("fold", "date_id").distinct().collect():  # dates x folds
            axes.setdefault(r["fold"], []).append(r["date_id"])
        split = [(f, d, side) for f, dates in axes.items() for side, part in zip((False, True), inner_split(dates, o["holdout"], o["embargo"])) for d in part]
        roles = F.broadcast(df.sparkSession.createDataFrame(split, "fold int, date_id int, held boolean"))
        rows = rows.join(roles, ["fold", "date_id"]).drop("date_id")
        size = rows.count()
        tasks = -(-size // self.rows_per_task)
        rows = rows.repartition(tasks, F.xxhash64(*rows.columns)).sortWithinPartitions("fold", *rows.columns[1:]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sides = rows.where("not held").groupBy("fold").agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()
            under_way: dict[int, Progress] = {}
            for r in sides:
                mean, sd = (np.array([r[f"{n}{i}"] for i in range(len(columns))]) for n in "ms")
                net = Net.new(stream(label, "init"), len(columns), stocks, o["embed"], o["hidden"], mean, np.where(sd > 0, sd, 1.0))
                under_way[r["fold"]] = Progress(Training(net))
            for epoch in range(o["epochs"] + 1):
                live = {f: p.state for f, p in under_way.items() if not p.done}
                if not live:
                    break
                parts = self._job(rows, live, epoch, o)
                for f in live:
                    mine = [r for r in parts if r["fold"] == f]
                    if epoch:
                        under_way[f].measured(sum(r["error"] for r in mine) / max(1, sum(r["held"] for r in mine)), o["patience"])
                    if not under_way[f].done and epoch < o["epochs"]:
                        under_way[f].state = Training.average([(r["n"], pickle.loads(r["state"])) for r in mine if r["n"]])
        finally:
            rows.unpersist()
        for f, p in under_way.items():
            p.state.net.p = p.kept if p.kept is not None else p.state.net.p
            self.nets[f], self.summary[f] = p.state.net, {"epochs": len(p.history), "best_epoch": p.best_at, "history": p.history}
        return self

    def _job(self, rows: DataFrame, live: dict[int, Training], epoch: int, o: dict) -> list:
        """Held-out error of the current parameters, and each partition's training from them (none in the last round)."""
        shared = rows.sparkSession.sparkContext.broadcast(live)
        columns, stocks, label = self.columns, self.stocks, self.name

        def run(batches):
            got = list(batches)  # a partition's rows: ``rows_per_task`` of them, about
            for f, part in pd.concat(got).groupby("fold") if got else ():
                if f not in shared.value:
                    continue
                state, held = copy.deepcopy(shared.value[f]), part["held"].to_numpy(bool)
                x, y = part[columns].to_numpy(float), part["target"].to_numpy(float)
                stock = np.clip(part["stock_id"].to_numpy(int), 0, stocks)
                error = float(np.abs(state.net.forward(x[held], stock[held])[0] - y[held]).sum()) if held.any() else 0.0
                fit, at = ~held, TaskContext.get().partitionId()
                if epoch < o["epochs"] and fit.any():
                    state.epoch(x[fit], stock[fit], y[fit], stream(label, "batches", int(f), epoch, at), stream(label, "dropout", int(f), epoch, at), o["rate"], o["decay"], o["batch"], o["dropout"])
                yield pd.DataFrame({"fold": [int(f)], "n": [int(fit.sum())], "held": [int(held.sum())], "error": [error], "state": [pickle.dumps(state) if epoch < o["epochs"] else b""]})

        out = rows.mapInPandas(run, "fold int, n long, held long, error double, state binary").collect()  # a net per partition and fold
        shared.destroy()
        return out

    def fit(self, df: DataFrame, cfg: Config) -> Mlp:
        return self.fit_folds(df.withColumn("fold", F.lit(0)), cfg)

    def predict(self, df: DataFrame, fold: int = 0) -> DataFrame:
        net, stocks = self.nets[fold], self.stocks

        @F.pandas_udf("double")
        def run(stock: pd.Series, *x: pd.Series) -> pd.Series:
            return pd.Series(net.forward(np.column_stack(x).astype(float), np.clip(stock.to_numpy(), 0, stocks))[0])

        return df.withColumn("prediction", run("stock_id", *self.columns))
