"""Claim history kept between micro-batches for the network signals.

Three batch tables: filed claims by time, first (device, worker) pairs and
first (worker, zone) pairs. A batch reads the last hour of the first and, of
the pair tables, only the keys it mentions. The signals equal those of one
pass over all claims whenever batches arrive in order of time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.constants import HONEYPOT_PINCODES
from parasol.functions.temporal import at_literal, micros
from parasol.operators import scans, signals
from parasol.sources.store import BatchTable

FILED = "claim_sk bigint, worker_id bigint, pincode string, device_id string, created_at timestamp_ntz, period string"
DEVICE_PAIRS = "device_id string, worker_id bigint, at bigint, claim_sk bigint"
ZONE_PAIRS = "worker_id bigint, pincode string, at bigint, claim_sk bigint"


class ClaimHistory:
    """``period`` is the date pattern filed claims are split by: a day where a batch spans minutes."""

    def __init__(self, spark: SparkSession, root: str, period: str = "yyyy-MM-dd"):
        self.period = period
        self.filed = BatchTable(spark, f"{root}/filed", FILED, by=("period",))
        self.devices = BatchTable(spark, f"{root}/device_pairs", DEVICE_PAIRS)
        self.zones = BatchTable(spark, f"{root}/zone_pairs", ZONE_PAIRS)

    def file(self, located: DataFrame, batch_id: int) -> None:
        """Record a batch's claims; the signals and pairs are read from what is written."""
        self.filed.write(_counted_claims(located).withColumn(
            "period", F.date_format("created_at", self.period)), batch_id)

    def append_pairs(self, batch_id: int) -> None:
        """Record the pairs the filed batch shows for the first time."""
        stamped = self.filed.read_batch(batch_id).withColumn("at", micros("created_at"))
        for table, keys in ((self.devices, ["device_id", "worker_id"]), (self.zones, ["worker_id", "pincode"])):
            first = stamped.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
                F.min(F.struct("at", "claim_sk")).alias("f")).select(*keys, "f.*")
            seen = table.read(before=batch_id).join(first.select(*keys), keys, "left_semi")
            table.write(first.join(seen.select(*keys), keys, "left_anti"), batch_id)

    def signals(self, batch_id: int) -> DataFrame:
        """(claim_sk, prior_hour, zones_before, others_on_device) of a filed batch against all earlier ones."""
        known = self.filed.read_batch(batch_id)
        burst = self._burst(known, batch_id)
        zones = self._prior(known, self.zones, "worker_id", "pincode", batch_id).select(
            "claim_sk", F.col("seen").alias("zones_before"))
        device = self._prior(known.where("device_id is not null"), self.devices, "device_id", "worker_id", batch_id).select(
            "claim_sk", (F.col("seen") - F.col("own_seen").cast("int")).alias("others_on_device"))
        return burst.join(zones, "claim_sk").join(device, "claim_sk", "left")

    def _burst(self, known: DataFrame, batch_id: int) -> DataFrame:
        earliest = known.agg(F.min("created_at")).first()[0]  # one timestamp
        if earliest is None:
            return known.select("claim_sk", F.lit(0).cast("bigint").alias("prior_hour"))
        since = at_literal(earliest - timedelta(hours=1))
        recent = self.filed.read(before=batch_id).where(
            (F.col("period") >= F.date_format(since, self.period)) & (F.col("created_at") > since))
        both = known.unionByName(recent)
        counts = signals.zone_burst(both, "pincode", "created_at", "claim_sk")
        return counts.join(known.select("claim_sk"), "claim_sk", "left_semi")

    def _prior(self, known: DataFrame, table: BatchTable, key: str, member: str, batch_id: int) -> DataFrame:
        slim = known.select(key, member, "claim_sk", micros("created_at").alias("at"))
        old = table.read(before=batch_id).select(key, member).join(slim.select(key).distinct(), key, "left_semi")
        sizes = old.groupBy(key).agg(F.count(F.lit(1)).alias("old_members"))
        in_old = old.withColumn("in_old", F.lit(True))
        marked = scans.first_seen(slim, [key, member], "at", "claim_sk").join(in_old, [key, member], "left")
        marked = marked.withColumn("in_old", F.coalesce("in_old", F.lit(False)))
        marked = marked.withColumn("new", (F.col("is_first") & ~F.col("in_old")).cast("int"))
        counted = scans.prior_sum(marked, [key], "at", "claim_sk", "new", "in_batch")
        return counted.join(sizes, key, "left").select(
            "claim_sk", (F.coalesce("old_members", F.lit(0)) + F.col("in_batch")).alias("seen"),
            (F.col("in_old") | ~F.col("is_first")).alias("own_seen"))


def _counted_claims(located: DataFrame) -> DataFrame:
    return located.where(~F.col("pincode").isin(HONEYPOT_PINCODES)).select(
        "claim_sk", "worker_id", "pincode", "device_id", "created_at")
