"""Outbox rows, their publication cycle, and retries with a dead-letter end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.constants import CLAIM_CREATED, MAX_RETRIES, OUTBOX_MAX_RETRIES
from parasol.operators.documents import pending_outbox
from parasol.sources.store import BatchTable
from parasol.streaming.envelope import envelope, event_id


def outbox_rows(claims: DataFrame) -> DataFrame:
    """One pending claim.created event per committed claim, with an id derived from it."""
    payload = F.struct("claim_id", "worker_name", "pincode", "amount", "reason", "trigger_type",
                       "photo_submitted", "device_id")
    eid = event_id("claim_id", F.lit(CLAIM_CREATED))
    return claims.select(
        eid.alias("event_id"), F.col("claim_id").alias("aggregate_id"), F.lit(CLAIM_CREATED).alias("event_type"),
        F.lit(CLAIM_CREATED).alias("topic"), F.col("claim_id").alias("correlation_id"),
        envelope(CLAIM_CREATED, payload, "created_at", eid, "claim_id").alias("payload"),
        F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), "created_at")


def drain(outbox: DataFrame, delivered: Column, limit: int | None = None) -> DataFrame:
    """The outbox after one publication cycle.

    Pending events, oldest first up to ``limit`` (all without one), become
    published when delivered, get one more retry otherwise, and fail for good
    once their retries are used up.
    """
    if limit is None:
        taken = F.col("status") == "pending"
        marked = outbox.withColumn("_taken", taken)
    else:
        picked = pending_outbox(outbox, limit).select("event_id", F.lit(True).alias("_hit"))
        marked = outbox.join(picked, "event_id", "left").withColumn(
            "_taken", F.coalesce("_hit", F.lit(False))).drop("_hit")
    exhausted = F.col("retry_count") >= OUTBOX_MAX_RETRIES
    status = (F.when(~F.col("_taken"), F.col("status")).when(exhausted, "failed")
              .when(delivered, "published").otherwise("pending"))
    retries = F.col("retry_count") + F.when(F.col("_taken") & ~exhausted & ~delivered, 1).otherwise(0)
    return marked.withColumns({"status": status, "retry_count": retries}).drop("_taken")


RETRY_FIELDS = "attempt int, outcome string, error string"


def process_attempts(events: DataFrame, attempt_once: Callable[[DataFrame], DataFrame], table: BatchTable,
                     max_retries: int = MAX_RETRIES) -> DataFrame:
    """Run events through ``attempt_once`` until done, dead or out of retries.

    ``attempt_once`` adds ``error_class`` (null, 'permanent' or 'transient') and
    ``error``. Each round is one folder of the retry table, read by the next, so
    the number of rounds bounds the work and a lost executor redoes one round.
    """
    waiting = events.withColumn("attempt", F.lit(0))
    for attempt in range(max_retries + 1):
        tried = attempt_once(waiting)
        last = attempt == max_retries
        outcome = (F.when(F.col("error_class").isNull(), "done").when(F.col("error_class") == "permanent", "dead")
                   .otherwise(F.lit("dead" if last else "retry")))
        table.write(tried.withColumn("outcome", outcome).select(*events.columns, "attempt", "outcome", "error"), attempt)
        waiting = table.read_batch(attempt).where("outcome = 'retry'").select(
            *events.columns, (F.col("attempt") + 1).alias("attempt"))
    return table.read().where("outcome <> 'retry'")
