"""Approved claims in, at most one payout per claim out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.constants import PAYOUT_COMPLETED, PAYOUT_DLQ
from parasol.functions.numeric import paise
from parasol.functions.text import idempotency_key, upi_handle
from parasol.operators.change import earliest_per_key
from parasol.sources.store import BatchTable
from parasol.streaming.envelope import envelope, event_id

CONSUMER = "payout-processor"
PAYOUTS = (
    "claim_sk bigint, claim_id string, worker_name string, amount double, amount_paise bigint, upi string, "
    "idempotency_key string, mode string, processed_at timestamp_ntz, status string"
)
EVENTS = "key string, value string, topic string"


class PayoutJob:
    """Pays each approved claim once, however often it is delivered.

    Requests carry claim_sk, claim_id, worker_name, status, amount, attempt, mode and
    requested_at. Within a batch the earliest request wins; a claim paid by an
    earlier batch is skipped; redoing a batch rewrites the same folder. A request
    of a claim nobody knows (no claim_id) is a dead letter, once per claim; should
    the claim turn up, a later request is paid.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.payouts = BatchTable(spark, f"{root}/payouts", PAYOUTS)
        self.events = BatchTable(spark, f"{root}/events", EVENTS)
        self.dead = BatchTable(spark, f"{root}/dead", EVENTS)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        lost = earliest_per_key(batch.where("claim_id is null"), ["claim_sk"], ["requested_at", "attempt", "amount", "mode"])
        letters = dead_payouts(lost)
        known = self.dead.read(before=batch_id).select("key").join(letters.select("key"), "key", "left_semi")
        self.dead.write(letters.join(known, "key", "left_anti"), batch_id)
        due = batch.where((F.col("status") == "approved") & F.col("claim_id").isNotNull())
        first = earliest_per_key(due, ["claim_sk"], ["requested_at", "attempt", "amount", "mode"])
        paid = self.payouts.read(before=batch_id).select("claim_sk").join(
            first.select("claim_sk"), "claim_sk", "left_semi")
        self.payouts.write(payout_rows(first.join(paid, "claim_sk", "left_anti")), batch_id)
        self.events.write(payout_events(self.payouts.read_batch(batch_id)), batch_id)


def payout_rows(requests: DataFrame) -> DataFrame:
    return requests.select(
        "claim_sk", "claim_id", "worker_name", "amount", paise("amount").alias("amount_paise"),
        F.coalesce(upi_handle("worker_name"), F.lit("worker@upi")).alias("upi"),
        idempotency_key("claim_id").alias("idempotency_key"), "mode",
        F.col("requested_at").alias("processed_at"), F.lit("completed").alias("status"))


def payout_events(payouts: DataFrame) -> DataFrame:
    payload = F.struct("claim_id", "worker_name", "amount", "upi", "mode", "idempotency_key")
    value = envelope(PAYOUT_COMPLETED, payload, "processed_at", event_id("idempotency_key"), "claim_id", CONSUMER)
    return payouts.select(F.col("claim_id").alias("key"), value.alias("value"), F.lit(PAYOUT_COMPLETED).alias("topic"))


def dead_payouts(requests: DataFrame) -> DataFrame:
    """Dead letters of requests whose claim is unknown, keyed by the claim's number."""
    key = F.col("claim_sk").cast("string")
    payload = F.struct("claim_sk", "amount", "mode", F.lit("unknown claim").alias("reason"))
    value = envelope(PAYOUT_DLQ, payload, "requested_at", event_id("claim_sk", F.lit(PAYOUT_DLQ)), "claim_sk", CONSUMER)
    return requests.select(key.alias("key"), value.alias("value"), F.lit(PAYOUT_DLQ).alias("topic"))


def mark_paid(claims: DataFrame, payouts: DataFrame) -> DataFrame:
    done = payouts.select("claim_sk", F.struct("idempotency_key", "upi", "processed_at").alias("_p"))
    return claims.join(done, "claim_sk", "left").withColumns({
        "payout_processed": F.col("payout_processed") | F.col("_p").isNotNull(),
        "payout_id": F.col("_p.idempotency_key"), "payout_upi": F.col("_p.upi"),
        "payout_at": F.col("_p.processed_at")}).drop("_p")
