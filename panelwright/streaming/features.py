"""The features' causality contract as a stream: buckets arrive in order, features use only what has arrived.

``stream_session_features`` keeps, per stock and date, the last rows of a session as state and gives
each arriving bucket its within-session features. State of a session expires by event time once
the watermark has passed its end. ``stream_bucket_errors`` is a windowed aggregate with late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEPTH = 6
OUTPUT = "stock_id long, date_id long, seconds_in_bucket long, wap_ret_1b_bps double, wap_ret_6b_bps double, wap_vol_6b_bps double"
STATE = "waps array<double>, returns array<double>, last long"


def advance(rows: pd.DataFrame, waps: list[float], returns: list[float]) -> tuple[pd.DataFrame, list[float], list[float]]:
    """Features of new buckets, in order, given the last waps and returns of the session."""
    out = []
    for r in rows.sort_values("seconds_in_bucket").itertuples():
        wap = np.nan if r.wap is None else float(r.wap)
        change = lambda k: (wap / waps[-k] - 1) * 1e4 if len(waps) >= k else np.nan  # noqa: B023, E731
        one, six = (0.0 if np.isnan(x) else x for x in (change(1), change(DEPTH)))
        waps, returns = [*waps, wap][-DEPTH:], [*returns, one][-DEPTH:]
        vol = float(np.std(returns, ddof=1)) if len(returns) > 1 else 0.0
        out.append((r.stock_id, r.date_id, r.seconds_in_bucket, one, six, vol))
    return pd.DataFrame(out, columns=["stock_id", "date_id", "seconds_in_bucket", "wap_ret_1b_bps", "wap_ret_6b_bps", "wap_vol_6b_bps"]), waps, returns


def stream_session_features(stream: DataFrame, lateness: str = "10 minutes", session: str = "10 minutes") -> DataFrame:
    """``stream`` has event_time, stock_id, date_id, seconds_in_bucket, wap. A bucket at or before the last one seen is late and dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waps, returns, last = state.get if state.exists else ([], [], -1)
        rows = pd.concat(list(batches))
        rows = rows[rows["seconds_in_bucket"] > last]
        if len(rows):
            out, waps, returns = advance(rows, list(waps), list(returns))
            state.update((waps, returns, int(rows["seconds_in_bucket"].max())))
            ends = rows["event_time"].max() + pd.Timedelta(session)
            state.setTimeoutTimestamp(max(int(ends.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            yield out

    keyed = stream.withWatermark("event_time", lateness).groupBy("stock_id", "date_id")
    return keyed.applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_bucket_errors(stream: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Mean absolute target per tumbling window; rows later than the watermark are dropped."""
    timed = stream.withWatermark("event_time", lateness).where("target is not null")
    return timed.groupBy(F.window("event_time", width)).agg(F.count("*").alias("n"), F.avg(F.abs("target")).alias("mae_zero"))
