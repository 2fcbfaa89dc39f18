"""Joins of claims, workers, readings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.functions.geo import haversine_km
from parasol.functions.temporal import day_text, micros
from parasol.operators import scans
from parasol.operators.change import latest_per_key

RAIN_SEEN_MM = 2.0
PHOTO_MAX_KM = 25


def enrich_with_worker(claims: DataFrame, workers: DataFrame) -> DataFrame:
    """Left join of worker attributes with defaults. No hint: the optimizer broadcasts
    the worker side only when its measured size allows."""
    side = workers.select("worker_id", "plan", "trust_score", "avg_daily_earning")
    return claims.join(side, "worker_id", "left").withColumns({
        "plan": F.coalesce("plan", F.lit("plus")),
        "avg_daily_earning": F.coalesce("avg_daily_earning", F.lit(600.0)),
    })


def split_known(events: DataFrame, workers: DataFrame) -> DataFrame:
    """Each event with its worker, or marked as a permanent failure."""
    side = workers.select("worker_id", "worker_name")
    return events.join(side, "worker_id", "left").withColumn(
        "error", F.when(F.col("worker_name").isNull(),
                        F.concat(F.lit("worker "), F.col("worker_id").cast("string"), F.lit(" not found"))))


def eligible_workers(readings: DataFrame, workers: DataFrame) -> DataFrame:
    """How many workers a reading's pincode covers. Workers are counted per pincode first."""
    per_pin = workers.groupBy("pincode").agg(F.count(F.lit(1)).alias("eligible"))
    return readings.join(per_pin, "pincode")


def unprocessed(events: DataFrame, processed: DataFrame, consumer: str) -> DataFrame:
    """Events this consumer has not handled yet."""
    done = processed.where(F.col("consumer_name") == consumer).select("event_id").distinct()
    return events.join(done, "event_id", "left_anti")


def fired_days(fired: DataFrame) -> DataFrame:
    return fired.select("pincode", "trigger_type", day_text("ts").alias("day")).distinct()


def valid_by_trigger(claims: DataFrame, fired: DataFrame) -> DataFrame:
    """Claims whose trigger fired that day in their pincode; manual reasons need none.

    One left join on distinct days, so the claims are read once.
    """
    days = fired_days(fired).withColumn("_hit", F.lit(True))
    dated = claims.withColumn("day", day_text("created_at")).join(days, ["pincode", "trigger_type", "day"], "left")
    return dated.where(F.col("_hit") | (F.coalesce("trigger_type", F.lit("manual")) == "manual")).select(*claims.columns)


def daily_weather(readings: DataFrame) -> DataFrame:
    """Last reading of each pincode's day, and whether it counts as rain."""
    dated = readings.withColumn("day", day_text("ts")).select("pincode", "day", "ts", "reading_id", "rain_mm_hr")
    last = latest_per_key(dated, ["pincode", "day"], ["ts", "reading_id"])
    return last.select("pincode", "day", "rain_mm_hr", (F.col("rain_mm_hr") > RAIN_SEEN_MM).alias("had_rain"))


def with_weather(claims: DataFrame, weather: DataFrame, ts: str = "created_at") -> DataFrame:
    return claims.withColumn("day", day_text(ts)).join(weather, ["pincode", "day"], "left")


def with_zone_snapshot(probes: DataFrame, snapshots: DataFrame, fields: list[str], ttl_seconds: int,
                       tie: str) -> DataFrame:
    """Latest snapshot of the probe's pincode younger than the time to live (as-of join)."""
    return scans.last_known(
        probes.withColumn("_p", micros("ts")), snapshots.withColumn("_f", micros("ts")),
        ["pincode"], "_p", "_f", tie, fields, ttl=ttl_seconds * 1_000_000)


def photo_distance(claims: DataFrame, photos: DataFrame, coords: DataFrame) -> DataFrame:
    """Distance from the photo's position to the registered pincode, where both are known."""
    known = coords.select("pincode", "lat", "lon")
    return claims.join(photos, "claim_sk").join(known, "pincode", "left").withColumn(
        "photo_km", haversine_km("lat", "lon", "gps_lat", "gps_lon"))


def disruption_before(claims: DataFrame, fired: DataFrame, hours: int = 6) -> DataFrame:
    """Whether a disruption hit the claim's pincode in the hours before it.

    Existence within the interval is the same as the latest earlier event lying
    in it, so this is an as-of lookup, and no claim-event pairs are formed.
    """
    width = hours * scans.HOUR
    events = fired.select("pincode", micros("ts").alias("_f")).distinct().withColumn("one", F.lit(1))
    return scans.last_known(claims.withColumn("_p", micros("created_at")), events, ["pincode"],
                            "_p", "_f", "one", ["one"], ttl=width + 1, width=width)
