"""Windows over event streams: tumbling sums with late data, and sessions, the streaming form of gap chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value by window and keys; rows more than `late` behind the latest one are dropped."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, time: str, keys: list[str], gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of rows whose neighbours are less than `gap` apart."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
