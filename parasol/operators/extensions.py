"""Operators the domain's documents describe: sustained events, clustering, lanes, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.numeric import as_col, round_to, truthy_or
from parasol.functions.temporal import day_text, micros
from parasol.operators import scans
from parasol.session import checkpointed, materialized


def sustained(readings: DataFrame, qualifies: Column, minutes: int) -> DataFrame:
    """Runs of consecutive qualifying readings per pincode lasting at least ``minutes``.

    A run is named by the last reading before it that did not qualify, so it is
    an ordinary group and aggregates map-side.
    """
    at = readings.withColumn("_at", micros("ts"))
    good = at.where(qualifies).select("pincode", "ts", "reading_id", "_at")
    breaks = at.where(~qualifies).select("pincode", F.col("reading_id").alias("break_id"), F.col("_at").alias("_b"))
    named = scans.last_known(good, breaks, ["pincode"], "_at", "_b", "break_id", ["break_id"])
    runs = named.groupBy("pincode", "break_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("readings"))
    span = (micros("ended") - micros("started")) / 60e6
    return runs.withColumn("minutes", span).where(F.col("minutes") >= minutes).drop("break_id")


def earning_profile(earnings: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """Average earning by worker, weekday and hour over the weeks before ``as_of``."""
    recent = earnings.where((F.col("ts") > as_of - F.expr(f"INTERVAL {weeks * 7} DAYS")) & (F.col("ts") <= as_of))
    money = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return recent.groupBy("worker_id", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("samples"), round_to(money / F.count(F.lit(1)), 2).alias("avg_earning"))


def outages(orders: DataFrame, platform: str, ts: str, bucket_minutes: int = 30, days: int = 7,
            drop: float = 0.60, sustained_minutes: int = 90) -> DataFrame:
    """Buckets in which volume stays more than ``drop`` below the same time of the prior days.

    Orders are counted per bucket before any window, so the windows run over
    time buckets, not orders; empty buckets count as zero.
    """
    width = bucket_minutes * 60
    seconds = F.floor(micros(ts) / 1_000_000)
    counted = orders.select(platform, (seconds - F.pmod(seconds, F.lit(width))).alias("bucket")).groupBy(
        platform, "bucket").agg(F.count(F.lit(1)).alias("orders"))
    reach = counted.groupBy(platform).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = reach.select(platform, F.explode(F.sequence("a", "b", F.lit(width).cast("bigint"))).alias("bucket"))
    full = grid.join(counted, [platform, "bucket"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    same_time = Window.partitionBy(platform, F.pmod(F.col("bucket"), F.lit(86400))).orderBy("bucket").rowsBetween(-days, -1)
    need = -(-sustained_minutes // bucket_minutes)
    in_a_row = Window.partitionBy(platform).orderBy("bucket").rowsBetween(1 - need, 0)
    judged = full.withColumns({"usual": F.sum("orders").over(same_time), "seen_days": F.count("orders").over(same_time)})
    judged = judged.withColumn("low", (F.col("seen_days") == days)
                               & (F.col("orders") * days < F.col("usual") * (1.0 - drop)))
    return judged.withColumn("outage", F.sum(F.col("low").cast("int")).over(in_a_row) == need)


def clustered(claims: DataFrame, key: str, ts: str, claim: str, at_least: int = 20, minutes: int = 5) -> DataFrame:
    """(claim, in_window, clustered): claims of the key filed within the trailing minutes."""
    stamped = claims.select(key, claim, micros(ts).alias("at"))
    per_instant = stamped.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    counts = scans.trailing_sum(per_instant, [key], "at", "n", "in_window", minutes * 60_000_000, True)
    return stamped.join(counts, [key, "at"], "left").select(
        claim, "in_window", (F.col("in_window") >= at_least).alias("clustered"))


def registration_spikes(first_days: DataFrame, days: int = 14) -> DataFrame:
    """Registrations per pincode over trailing days. ``first_days`` holds (pincode, worker_id, day)."""
    daily = first_days.groupBy("pincode", "day").agg(F.count(F.lit(1)).alias("registered"))
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    trailing = Window.partitionBy("pincode").orderBy(number).rangeBetween(1 - days, 0)
    return daily.withColumn("registered_14d", F.sum("registered").over(trailing))


def zone_consensus(scored: DataFrame, neighbours: int = 40, n_flags=None) -> DataFrame:
    """Add ``consensus``: enough other workers' clean claims in the same zone and day.

    Claims and both counts read the scored rows, so these are written once. They
    are shuffled whole: give only the columns read later.
    """
    dated = materialized(scored.withColumn("day", day_text("created_at")), "consensus")
    clean = (F.size("flags") if n_flags is None else as_col(n_flags)) == 0
    per_worker = dated.groupBy("pincode", "day", "worker_id").agg(F.max(clean.cast("int")).alias("own_clean"))
    per_zone = per_worker.groupBy("pincode", "day").agg(F.sum("own_clean").alias("clean_workers"))
    joined = dated.join(per_worker, ["pincode", "day", "worker_id"]).join(per_zone, ["pincode", "day"])
    return joined.withColumn("clean_neighbours", F.col("clean_workers") - F.col("own_clean")).withColumn(
        "consensus", F.col("clean_neighbours") >= neighbours).drop("clean_workers", "own_clean", "day")


def lane(consensus=None) -> Column:
    """Green, yellow or red lane of a scored claim; consensus softens red to yellow."""
    signals = F.size("flags")
    score = truthy_or("trust_score", 50.0)
    strict = (F.when((score >= 75) & (F.col("account_age_days") > 60) & (signals == 0), "green")
              .when(signals.between(1, 2), "yellow").otherwise("red"))
    return strict if consensus is None else softened(strict, consensus)


def softened(strict, consensus) -> Column:
    red = as_col(strict) == "red"
    return F.when(red & as_col(consensus), "yellow").otherwise(as_col(strict))


def boosted_cap(claims: DataFrame, plans: DataFrame, alerts: DataFrame) -> DataFrame:
    """Weekly cap of each claim's plan, half as much again for plus and pro on a flood-alert day."""
    flooded = alerts.where(F.col("trigger_type").isin("heavy_rain", "waterlogging")).select(
        "pincode", day_text("ts").alias("day")).distinct().withColumn("alert", F.lit(True))
    joined = claims.withColumn("day", day_text("created_at")).join(flooded, ["pincode", "day"], "left").join(
        plans.select("plan", "weekly_cap"), "plan")
    boost = F.coalesce("alert", F.lit(False)) & F.col("plan").isin("plus", "pro")
    return joined.withColumn("cap", F.when(boost, F.col("weekly_cap") * 1.5).otherwise(F.col("weekly_cap") * 1.0))


def exclusion(disrupted_at, paused) -> Column:
    """Why a claim is excluded, null if it is not."""
    return (F.when(as_col(paused), "policy paused").when(as_col(disrupted_at).isNull(), "filed late or no event"))


def device_rings(pairs: DataFrame) -> DataFrame:
    """(worker_id, ring, ring_size): workers connected through shared devices.

    Labels spread as minima over workers and devices, and each round also
    follows a label to its own label, which shortens long chains. Every round
    is checkpointed in the shared folder. Stops when nothing changes.
    """
    edges = checkpointed(pairs.select("device_id", "worker_id").distinct())
    labels = checkpointed(edges.groupBy("worker_id").agg(F.min("worker_id").alias("ring")))
    while True:  # labels only fall, so it ends
        by_device = edges.join(labels, "worker_id").groupBy("device_id").agg(F.min("ring").alias("ring"))
        spread = edges.join(by_device, "device_id").groupBy("worker_id").agg(F.min("ring").alias("near"))
        jump = labels.select(F.col("worker_id").alias("near"), F.col("ring").alias("far"))
        moved = spread.join(jump, "near", "left").select(
            "worker_id", F.least("near", F.coalesce("far", "near")).alias("ring"))
        moved = checkpointed(moved)
        settled = moved.join(labels.withColumnRenamed("ring", "old"), "worker_id").where("ring <> old").isEmpty()
        labels = moved
        if settled:
            sizes = labels.groupBy("ring").agg(F.count(F.lit(1)).alias("ring_size"))
            return labels.join(sizes, "ring")
