"""Running streams to the end of what has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                output_mode: str = "append") -> None:
    """Process everything that has landed in micro-batches, then stop.

    Offsets are committed only after ``handle`` returns, so a failed batch is
    handed over again under the same batch id.
    """
    (stream.writeStream.foreachBatch(handle).outputMode(output_mode)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def append_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
