"""Two streams matched within an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.streaming import keyed


def disruptions_of_claims(claims: DataFrame, fired: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """(claim_sk, claimed_at, disrupted_at): a row per claim with the newest disruption of its pincode in the hours before it, none if there is none.

    Both sides carry a watermark and wait until it has passed, then claims and disruptions are matched in order of
    time: no pairs are made, and what is held is what waits and a disruption per pincode. ``claims``
    have claim_sk, pincode and claimed_at, ``fired`` pincode and fired_at, both timestamps.
    """
    found = keyed.latest_before(claims, fired, hours * 60 * keyed.MINUTE, late)
    return found.select("claim_sk", *[F.timestamp_micros(c).alias(c) for c in ("claimed_at", "disrupted_at")])


def latest_disruption(pairs: DataFrame) -> DataFrame:
    """The newest disruption of each claim, also if it was filed more than once."""
    return pairs.groupBy("claim_sk").agg(F.max("disrupted_at").alias("disrupted_at"))
