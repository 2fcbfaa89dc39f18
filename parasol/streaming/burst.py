"""Zone bursts and time-limited lookups on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.operators.signals import BURST_CLAIMS
from parasol.sources.store import BatchTable

WINDOWS = "pincode string, window_start timestamp, claims bigint"


def burst_windows(claims: DataFrame, at: str, key: str = "pincode", length: str = "1 hour",
                  slide: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """Claims per zone and sliding window. Works on a table and on a stream alike."""
    return (claims.withWatermark(at, late).groupBy(F.col(key), F.window(at, length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("claims"))
            .select(key, F.col("w.start").alias("window_start"), "claims"))


def keep_latest(table: BatchTable):
    """Sink of an update-mode stream: each batch stores the windows it changed."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)
    return handle


def current_windows(table: BatchTable) -> DataFrame:
    """Newest count per window. Counts only grow, so the newest is the largest."""
    return table.read().groupBy("pincode", "window_start").agg(F.max("claims").alias("claims"))


def bursts(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("claims") > BURST_CLAIMS)
