"""Duplicate suppression and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.operators.matching import unprocessed
from parasol.sources.store import BatchTable

PROCESSED = "event_id bigint, consumer_name string"


def within_horizon(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """One row per key while redelivery stays within the horizon; state is bounded by it."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def on_time(stream: DataFrame, keys: list[str], at: str, grace: str) -> DataFrame:
    """Rows no later than the grace behind the newest event seen; later ones are dropped."""
    return stream.withWatermark(at, grace).dropDuplicates([*keys, at])


def handle_once(batch: DataFrame, batch_id: int, processed: BatchTable, consumer: str) -> DataFrame:
    """Rows of the batch this consumer never handled, without any horizon.

    Only the history of ids the batch mentions is matched, so the small batch
    side can be broadcast and the history is read without a shuffle.
    """
    first = batch.dropDuplicates(["event_id"])
    ids = first.select("event_id")
    history = processed.read(before=batch_id).join(ids, "event_id", "left_semi")
    return unprocessed(first, history, consumer)


def mark_processed(rows: DataFrame, batch_id: int, processed: BatchTable, consumer: str) -> None:
    processed.write(rows.select("event_id", F.lit(consumer).alias("consumer_name")), batch_id)
