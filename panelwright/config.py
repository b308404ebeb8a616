"""Run configuration: one table of presets, and changes to them that are checked together."""

from __future__ import annotations

import difflib
import os
from dataclasses import asdict, dataclass, fields

BPS = 1e4

#: What each preset sets; what it leaves out is as in FULL. SMOKE is FULL with small folds, DERIVED fits the panel made of lineitem.
TABLE: dict[str, dict[str, dict]] = {
    "session": {
        "FULL": {"bucket_step": 10, "last_bucket": 540, "horizon": 6, "cross_price_first": 300},
        "DERIVED": {"last_bucket": 90, "horizon": 1, "cross_price_first": 50},
    },
    "rows": {"FULL": {"date_stride": 1, "stocks": None}},
    "folds": {
        "FULL": {"n_folds": 5, "val_dates_per_fold": 60, "embargo_dates": 5, "max_train_dates": None},
        "SMOKE": {"n_folds": 3, "val_dates_per_fold": 8, "embargo_dates": 2},
        "DERIVED": {"n_folds": 3, "val_dates_per_fold": 15, "embargo_dates": 2},
    },
    "fit": {"FULL": {"ridge_alpha": 1.0, "fit_clip_bps": 60.0, "approximate": False}},
}
NAMES = ("SMOKE", "FULL", "DERIVED")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    """``stocks`` and ``max_train_dates`` may be None: all of them. ``fit_clip_bps`` bounds the target in fits, never in scores; ``approximate`` makes fits take quantiles in bounded memory."""

    name: str
    ridge_alpha: float
    fit_clip_bps: float | None
    approximate: bool
    date_stride: int
    stocks: tuple[int, ...] | None
    bucket_step: int
    last_bucket: int
    horizon: int
    cross_price_first: int
    n_folds: int
    val_dates_per_fold: int
    embargo_dates: int
    max_train_dates: int | None

    @property
    def buckets(self) -> list[int]:
        return list(range(0, self.last_bucket + 1, self.bucket_step))

    def problems(self) -> list[str]:
        """All that is wrong, not just the first."""
        least = {"bucket_step": 1, "horizon": 1, "date_stride": 1, "n_folds": 1, "val_dates_per_fold": 1, "embargo_dates": 0, "max_train_dates": 1, "ridge_alpha": 0, "fit_clip_bps": 0}
        values = asdict(self)
        out = [f"{k} is {values[k]}, the least is {v}" for k, v in least.items() if values[k] is not None and values[k] < v]
        if self.bucket_step > 0 and self.last_bucket % self.bucket_step:
            out.append(f"last_bucket {self.last_bucket} is off the grid of step {self.bucket_step}")
        if self.stocks is not None and not self.stocks:
            out.append("stocks selects none")
        return out


def configured(preset: str | None = None, panel: str | None = None, **changes) -> Config:
    """A preset with changes. Without a name: FULL if there is a panel at the path ``panel``, else SMOKE."""
    name = (preset or ("FULL" if panel and os.path.exists(panel) else "SMOKE")).upper()
    if name not in NAMES:
        raise ConfigError(f"no preset {preset!r}; there are {', '.join(NAMES)}")
    values: dict = {"name": name}
    for group in TABLE.values():
        values |= group["FULL"] | group.get(name, {})
    known = {f.name for f in fields(Config)} - {"name"}
    for field in changes.keys() - known:
        near = difflib.get_close_matches(field, known, 1)
        raise ConfigError(f"no field {field!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    made = Config(**values | changes)
    if wrong := made.problems():
        raise ConfigError("; ".join(wrong))
    return made


PRESETS = {name: configured(name) for name in NAMES}
