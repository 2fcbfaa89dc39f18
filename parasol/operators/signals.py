"""Fraud signals over history: bursts, shared devices, movement, repeat claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.geo import haversine_km
from parasol.functions.numeric import as_col, round_to
from parasol.functions.temporal import micros
from parasol.operators import scans
from parasol.operators.scoring import grade

BURST_CLAIMS = 8
MULTI_ZONES = 3
JUMP_KM, JUMP_MINUTES, MAX_KMH = 50, 10, 80


def zone_burst(claims: DataFrame, key: str, ts: str, claim: str) -> DataFrame:
    """(claim, prior_hour): claims of the same zone in the hour before, peers included, self not.

    Claims of one zone and instant are counted once before the scan, so it runs
    over distinct instants, not over claims.
    """
    stamped = claims.select(key, claim, micros(ts).alias("at"))
    per_instant = stamped.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    trailing = scans.trailing_sum(per_instant, [key], "at", "n", "hour_count",
                                  span=scans.HOUR, include_edge=False, width=60_000_000)
    return stamped.join(trailing, [key, "at"], "left").select(
        claim, (F.col("hour_count") - 1).alias("prior_hour"))


def prior_distinct(df: DataFrame, key: str, member: str, ts: str, row_id: str,
                   width: int = scans.HOUR) -> DataFrame:
    """(row_id, seen, own_seen): distinct members of the key in earlier rows.

    A running distinct count is a running count of first appearances.
    """
    slim = df.select(key, member, row_id, micros(ts).alias("at"))
    marked = scans.first_seen(slim, [key, member], "at", row_id).withColumn(
        "_first", F.col("is_first").cast("int"))
    counted = scans.prior_sum(marked, [key], "at", row_id, "_first", "seen", width)
    return counted.select(row_id, "seen", (~F.col("is_first")).alias("own_seen"))


def zones_before(claims: DataFrame, worker: str, zone: str, ts: str, claim: str) -> DataFrame:
    """(claim, zones_before): zones the worker has claimed in before."""
    return prior_distinct(claims, worker, zone, ts, claim).select(claim, F.col("seen").alias("zones_before"))


def others_on_device(claims: DataFrame, device: str, worker: str, ts: str, claim: str) -> DataFrame:
    """(claim, others): other workers seen on the claim's device before."""
    used = claims.where(F.col(device).isNotNull())
    seen = prior_distinct(used, device, worker, ts, claim)
    return seen.select(claim, (F.col("seen") - F.col("own_seen").cast("int")).alias("others"))


def gps_hops(pings: DataFrame) -> DataFrame:
    """Distance, minutes and speed from the ping before, with jump and velocity flags."""
    stamped = pings.withColumn("at", micros("ts"))
    hops = scans.with_previous(stamped, ["trace_id"], "at", "ping_id", ["at", "lat", "lon"])
    km = haversine_km("prev_lat", "prev_lon", "lat", "lon")
    minutes = F.greatest((F.col("at") - F.col("prev_at")) / F.lit(60e6), F.lit(0.1))
    first = F.col("prev_at").isNull()
    hops = hops.withColumn("km", F.when(~first, km)).withColumn("minutes", F.when(~first, minutes))
    hops = hops.withColumn("kmh", F.col("km") / (F.col("minutes") / 60.0))
    return hops.withColumns({
        "jump": F.coalesce((F.col("km") > JUMP_KM) & (F.col("minutes") < JUMP_MINUTES), F.lit(False)),
        "too_fast": F.coalesce(F.col("kmh") > MAX_KMH, F.lit(False)),
    })


def trace_verdict(hops: DataFrame) -> DataFrame:
    """One verdict per trace: number of flags, confidence, whether it looks spoofed.

    All latitudes equal to four places is min = max, which aggregates map-side.
    """
    lat4 = F.round("lat", 4)
    per = hops.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.col("jump").cast("int")).alias("jumps"),
        F.sum(F.col("too_fast").cast("int")).alias("speedings"),
        (F.min(lat4) == F.max(lat4)).alias("static"),
    )
    enough = F.col("points") >= 2
    flags = F.when(enough, F.col("jumps") + F.col("speedings") + F.col("static").cast("int")).otherwise(F.lit(0))
    return per.select(
        "trace_id", "points", (enough & F.col("static")).alias("static"), flags.alias("n_flags"),
        round_to(F.least(flags * 0.35, F.lit(1.0)), 2).alias("confidence"),
        (flags > 0).alias("spoofed"), (~enough).alias("insufficient"),
    )


def earlier_rejections(claims: DataFrame) -> DataFrame:
    """Add ``false_before``: the worker's rejected claims before this one."""
    marked = claims.withColumn("_at", micros("created_at")).withColumn(
        "_bad", F.col("status").startswith("rejected").cast("int"))
    return scans.prior_sum(marked, ["worker_id"], "_at", "claim_sk", "_bad", "false_before",
                           scans.DAY).drop("_at", "_bad")


def escalation(rejected: DataFrame, start_score) -> DataFrame:
    """Penalty and score after each false claim: 8, then 10, then 15 points each, floor 10.

    ``rejected`` carries ``false_before``. The sum of the penalties has a closed
    form, so no second running sum is needed; the floor commutes with it.
    """
    nth = F.col("false_before") + 1
    penalty = F.when(nth >= 3, 15).when(nth == 2, 10).otherwise(8)
    total = F.when(nth == 1, F.lit(8)).otherwise(F.lit(18) + (nth - 2) * 15)
    score = F.greatest(F.lit(10.0), as_col(start_score) - total)
    return rejected.withColumns({
        "nth": nth, "penalty": penalty, "score_after": score, "grade_after": grade(score)})


def repeat_payout_factor(false_before) -> Column:
    n = as_col(false_before)
    return F.when(n >= 3, 0.50).when(n == 2, 0.70).when(n == 1, 0.85).otherwise(1.0)


def rolling_approved(claims: DataFrame, days: int = 7) -> DataFrame:
    """(worker_id, claim_sk, approved_7d): approved rupees of the trailing days, edges included."""
    stamped = claims.select(
        "worker_id", "claim_sk", micros("created_at").alias("at"),
        F.when(F.col("status") == "approved", F.col("amount")).otherwise(0.0).cast("decimal(18,2)").alias("v"))
    per_instant = stamped.groupBy("worker_id", "at").agg(F.sum("v").alias("v"))
    sums = scans.trailing_sum(per_instant, ["worker_id"], "at", "v", "approved_7d", days * scans.DAY, True,
                              width=scans.HOUR)
    return stamped.join(sums, ["worker_id", "at"], "left").select(
        "worker_id", "claim_sk", F.col("approved_7d").cast("double").alias("approved_7d"))


def recent_claims(claims: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("worker_id").orderBy(F.desc("created_at"), F.desc("claim_sk"))
    return claims.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
