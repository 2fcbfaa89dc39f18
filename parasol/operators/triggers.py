"""Parametric triggers over readings, and the payouts they cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.constants import (
    CURFEW_ALERT_PINCODES, DEFAULT_RAIN_FACTOR, PLANS, WHAT_IF_AQI_RATE, WHAT_IF_RAIN, WHAT_IF_WATERLOGGING,
)
from parasol.functions.collections import lookup
from parasol.functions.numeric import as_col, round_even

WATERLOGGING_RAIN = 7.0


def rain_factor(plan) -> Column:
    return lookup({p[0]: p[4] for p in PLANS}, F.coalesce(as_col(plan), F.lit("")), DEFAULT_RAIN_FACTOR)


def rain_payout(earning, rain, duration, plan) -> Column:
    """Whole rupees: earning by intensity, duration and plan factor, half to even."""
    return round_even(as_col(earning) * (as_col(rain) / 10.0) * (as_col(duration) / 60.0) * rain_factor(plan))


def aqi_rate(aqi) -> Column:
    a = as_col(aqi)
    return F.when(a < 200, 0.30).when(a < 300, 0.45).otherwise(0.55)


def with_curfew_alerts(readings: DataFrame) -> DataFrame:
    """Curfew from the list of alerted pincodes."""
    return readings.withColumn("curfew_active", F.col("pincode").isin(CURFEW_ALERT_PINCODES))


def evaluate(zoned: DataFrame) -> DataFrame:
    """Five trigger columns per reading. Heavy rain suppresses waterlogging payouts.

    ``zoned`` readings carry ``waterlogging_score``. ``waterlogging_met`` is the bare
    condition, ``waterlogging`` what fires.
    """
    c = F.col
    heavy = (c("rain_mm_hr") > 7.5) & (c("duration_min") > 45)
    logged = (c("waterlogging_score") > 0.65) & (c("rain_mm_hr") > 6.0)
    return zoned.withColumns({
        "heavy_rain": heavy,
        "aqi_spike": c("aqi") > 150,
        "waterlogging_met": logged,
        "waterlogging": logged & ~heavy,
        "cyclone_wind": (c("wind_kmh") > 60) | (c("gust_kmh") > 80),
        "strike_curfew": c("curfew_active"),
    })


def fired(evaluated: DataFrame) -> DataFrame:
    """Long form: one row per reading and fired trigger, in one pass over the readings."""
    names = F.array(*[
        F.when(F.col(t), F.lit(t))
        for t in ("heavy_rain", "aqi_spike", "waterlogging", "cyclone_wind", "strike_curfew")])
    return evaluated.withColumn("trigger_type", F.explode(F.array_compact(names)))


def claim_amount(trigger, earning, plan, rain, duration, aqi) -> Column:
    """What one worker gets for one fired trigger."""
    tr, e = as_col(trigger), as_col(earning)
    return (
        F.when(tr == "heavy_rain", rain_payout(e, rain, duration, plan))
        .when(tr == "aqi_spike", round_even(e * aqi_rate(aqi)))
        .when(tr == "waterlogging", rain_payout(e, F.lit(WATERLOGGING_RAIN), duration, plan))
        .when(tr == "cyclone_wind", round_even(e * 0.50))
        .otherwise(round_even(e * 0.60))
    )


def auto_claims(fired_rows: DataFrame, workers: DataFrame) -> DataFrame:
    """One approved claim per fired trigger and worker of the pincode.

    The row count is the number of payments due. Use ``payout_totals`` where
    only sums are wanted: it never forms the pairs.
    """
    paid = workers.select("pincode", "worker_id", "worker_name", "plan", "avg_daily_earning", "trust_score")
    return fired_rows.join(paid, "pincode").withColumn("amount", claim_amount(
        "trigger_type", "avg_daily_earning", "plan", "rain_mm_hr", "duration_min", "aqi"))


# Readings matter to a payout only through these values.
_SHAPE = ["pincode", "trigger_type", "_rain", "_duration", "_aqi"]


def _shaped(fired_rows: DataFrame) -> DataFrame:
    tr = F.col("trigger_type")
    rainy = tr.isin("heavy_rain")
    wet = tr.isin("heavy_rain", "waterlogging")
    return fired_rows.withColumns({
        "_rain": F.when(rainy, F.col("rain_mm_hr")).otherwise(0.0),
        "_duration": F.when(wet, F.col("duration_min")).otherwise(0),
        "_aqi": F.when(tr == "aqi_spike", F.when(F.col("aqi") < 200, 199).when(F.col("aqi") < 300, 299)
                       .otherwise(300)).otherwise(0),
    })


def _worker_groups(workers: DataFrame) -> DataFrame:
    """Workers counted by what their payout depends on."""
    return workers.groupBy("pincode", "plan", "avg_daily_earning").agg(F.count(F.lit(1)).alias("n"))


def payout_shapes(fired_rows: DataFrame, workers: DataFrame) -> DataFrame:
    """Claims and rupees one fired trigger of each distinct shape causes.

    Both sides are reduced to their distinct payout-relevant values before they
    meet, so the join grows with value combinations, not with rows.
    """
    shapes = _shaped(fired_rows).select(*_SHAPE).distinct()
    groups = _worker_groups(workers)
    amount = claim_amount("trigger_type", "avg_daily_earning", "plan", "_rain", "_duration", "_aqi")
    return shapes.join(groups, "pincode").groupBy(*_SHAPE).agg(
        F.sum("n").alias("claims_count"), F.sum(amount * F.col("n")).alias("payout_total"))


def trigger_events(fired_rows: DataFrame, workers: DataFrame) -> DataFrame:
    """One row per fired trigger with the claims and rupees it causes."""
    per_shape = payout_shapes(fired_rows, workers)
    return _shaped(fired_rows).join(per_shape, _SHAPE, "left").drop("_rain", "_duration", "_aqi").withColumns({
        "claims_count": F.coalesce("claims_count", F.lit(0)),
        "payout_total": F.coalesce("payout_total", F.lit(0.0)),
    })


def payout_totals(fired_rows: DataFrame, workers: DataFrame, by: list[str]) -> DataFrame:
    """Claims and rupees by the given columns, in one pass over the firings.

    Firings are counted per shape before they meet the worker groups.
    """
    counted = _shaped(fired_rows).groupBy(*_SHAPE).agg(F.count(F.lit(1)).alias("firings"))
    groups = _worker_groups(workers)
    amount = claim_amount("trigger_type", "avg_daily_earning", "plan", "_rain", "_duration", "_aqi")
    per_shape = counted.join(groups, "pincode").groupBy(*_SHAPE, "firings").agg(
        F.sum("n").alias("workers"), F.sum(amount * F.col("n")).alias("paid"))
    return per_shape.groupBy(*by).agg(
        F.sum("firings").alias("firings"),
        F.sum(F.col("firings") * F.col("workers")).alias("claims_count"),
        F.sum(F.col("firings") * F.col("paid")).alias("payout_total"))


def run_summary(evaluated: DataFrame, workers: DataFrame) -> DataFrame:
    """Per reading: triggers fired of five, claims created and live sources."""
    per_pin = workers.groupBy("pincode").agg(F.count(F.lit(1)).alias("eligible"))
    n = sum((F.col(t).cast("int") for t in ("aqi_spike", "waterlogging", "cyclone_wind", "strike_curfew")),
            F.col("heavy_rain").cast("int"))
    return evaluated.join(per_pin, "pincode", "left").withColumns({
        "fired_count": n, "claims_count": n * F.coalesce("eligible", F.lit(0))})


def what_if(workers: DataFrame) -> DataFrame:
    """Claims and rupees each scenario would cause per pincode.

    Workers are reduced to distinct payout values first; the five scenarios are
    columns of the same pass.
    """
    groups = _worker_groups(workers)
    e = F.col("avg_daily_earning")
    amounts = {
        "heavy_rain": rain_payout(e, F.lit(WHAT_IF_RAIN[0]), F.lit(WHAT_IF_RAIN[1]), "plan"),
        "aqi_spike": round_even(e * WHAT_IF_AQI_RATE),
        "waterlogging": rain_payout(e, F.lit(WHAT_IF_WATERLOGGING[0]), F.lit(WHAT_IF_WATERLOGGING[1]), "plan"),
        "cyclone_wind": round_even(e * 0.50),
        "strike_curfew": round_even(e * 0.60),
    }
    lines = F.explode(F.array(*[
        F.struct(F.lit(t).alias("trigger_type"), a.alias("amount")) for t, a in amounts.items()]))
    return groups.select("pincode", "n", lines.alias("s")).groupBy("pincode", "s.trigger_type").agg(
        F.sum("n").alias("claims_count"), F.sum(F.col("s.amount") * F.col("n")).alias("payout_total"))
