"""The window specifications of the panel, named in one place (functions, as a specification needs a session)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import WindowSpec


def session() -> WindowSpec:
    """A stock's session in bucket order."""
    return W.partitionBy("stock_id", "date_id").orderBy("seconds_in_bucket")


def instant() -> WindowSpec:
    """The cross-section of stocks at one date and bucket."""
    return W.partitionBy("date_id", "seconds_in_bucket")


def days() -> WindowSpec:
    """A stock's observed dates, over a table of one row for each."""
    return W.partitionBy("stock_id").orderBy("date_id")


def same_bucket() -> WindowSpec:
    """One bucket of a stock by date."""
    return W.partitionBy("stock_id", "seconds_in_bucket").orderBy("date_id")
