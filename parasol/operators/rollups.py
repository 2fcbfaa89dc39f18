"""Dashboards: portfolio and worker rollups as single aggregation passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.constants import GRADES
from parasol.functions.numeric import count_if, ratio, round_to, sum_if, truthy_or
from parasol.functions.temporal import day_text
from parasol.operators.scoring import grade, with_zone_profile


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side measures of several one-row aggregates, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def is_approved() -> Column:
    return F.col("status") == "approved"


def is_pending() -> Column:
    return F.col("status").contains("pending")


def is_rejected() -> Column:
    return F.col("status").contains("rejected")


def coverage(workers: DataFrame, policies: DataFrame, plans: DataFrame) -> DataFrame:
    held = policies.select("worker_id", F.lit(True).alias("held"))
    joined = workers.join(held, "worker_id", "left").join(plans, "plan")
    earning = F.coalesce("avg_daily_earning", F.lit(600.0))
    return joined.select(
        "worker_id",
        F.when(F.col("policy_paused"), "paused").when(F.col("held"), "active").otherwise("no_policy").alias("coverage"),
        "weekly_cap", round_to(earning * 5, 2).alias("weekly_estimate"),
        round_to(F.col("weekly_cap") / F.greatest(earning * 5, F.lit(1.0)) * 100.0, 1).alias("protected_pct"))


def cap_use(workers: DataFrame, claims: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Approved rupees of the seven days before ``as_of`` against the weekly cap."""
    recent = claims.where(
        is_approved() & (F.col("created_at") > as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= as_of))
    used = recent.groupBy("worker_id").agg(F.sum("amount").alias("used"))
    joined = workers.join(used, "worker_id", "left").join(plans, "plan").withColumn(
        "used", F.coalesce("used", F.lit(0.0)))
    return joined.select(
        "worker_id", "used", "weekly_cap",
        round_to(F.least(F.col("used") / F.col("weekly_cap") * 100.0, F.lit(100.0)), 1).alias("used_pct"),
        F.greatest(F.col("weekly_cap") - F.col("used"), F.lit(0.0)).alias("remaining"))


def worker_summary(workers: DataFrame, claims: DataFrame) -> DataFrame:
    per = claims.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("total"), count_if(is_approved()).alias("approved"),
        count_if(is_pending()).alias("pending"), count_if(is_rejected()).alias("rejected"),
        sum_if(is_approved(), "amount").alias("paid"))
    zero = {"total": 0, "approved": 0, "pending": 0, "rejected": 0, "paid": 0.0}
    return workers.select("worker_id").join(per, "worker_id", "left").fillna(zero)


def overview(workers: DataFrame, policies: DataFrame, claims: DataFrame) -> DataFrame:
    return one_row(
        workers.agg(F.count(F.lit(1)).alias("total_workers")),
        policies.agg(count_if(F.col("status") == "active").alias("active_policies")),
        claims.agg(F.count(F.lit(1)).alias("total_claims"), count_if(is_approved()).alias("approved"),
                   count_if(is_pending()).alias("pending"), count_if(is_rejected()).alias("rejected")))


def financials(workers: DataFrame, claims: DataFrame, plans: DataFrame) -> DataFrame:
    priced = workers.join(plans, "plan", "left")
    money = one_row(
        claims.agg(sum_if(is_approved(), "amount").alias("total_payout"),
                   sum_if(is_approved() & F.col("payout_processed"), "amount").alias("payout_processed")),
        priced.agg(F.sum(F.coalesce("weekly_premium", F.lit(49))).alias("weekly_pool")))
    loss = round_to(F.col("total_payout") / F.greatest("annual_pool", F.lit(1)) * 100.0, 1)
    return money.withColumn("annual_pool", F.col("weekly_pool") * 52).withColumn("loss_ratio_pct", loss).withColumn(
        "loss_status", F.when(F.col("loss_ratio_pct") < 55, "healthy").when(F.col("loss_ratio_pct") < 70, "watch")
        .otherwise("critical"))


def pool_health(money: DataFrame) -> DataFrame:
    used = F.col("total_payout") / F.greatest("annual_pool", F.lit(1)) * 100.0
    return money.select(round_to(used, 1).alias("utilisation_pct"),
                        round_to(F.greatest(F.lit(0.0), F.lit(100.0) - used), 1).alias("reserve_pct"))


def score_histogram(workers: DataFrame) -> DataFrame:
    """Workers per grade, empty grades included, with the portfolio average."""
    score = truthy_or("trust_score", 50.0)
    names = [g[1] for g in GRADES]
    counted = workers.select(score.alias("s")).agg(
        F.sum(F.col("s").cast("decimal(10,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"),
        *[count_if(grade("s") == g).alias(g) for g in names])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"`{g}`").alias("workers")) for g in names]))
    return counted.select(rows.alias("r"), round_to(ratio("total", "n"), 1).alias("average")).select("r.*", "average")


def claims_by_trigger(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.coalesce("trigger_type", F.lit("unknown")).alias("trigger_type")).agg(
        F.count(F.lit(1)).alias("claims"))


def seven_day_forecast(workers: DataFrame, claims: DataFrame, zone_risk: DataFrame, as_of: str) -> DataFrame:
    zoned = with_zone_profile(workers.select("worker_id", "pincode"), zone_risk)
    base = one_row(
        zoned.agg(F.sum("disruption_days_per_year").alias("days"), F.count(F.lit(1)).alias("workers")),
        claims.agg(sum_if(is_approved(), "amount").alias("paid"), count_if(is_approved()).alias("approved")))
    daily = (F.col("days") / F.greatest("workers", F.lit(1))) / 365.0 * F.col("workers")
    average = F.when(F.col("approved") > 0, F.col("paid") / F.greatest("approved", F.lit(1))).otherwise(250.0)
    day = F.date_add(F.lit(as_of).cast("date"), F.col("ahead"))
    return base.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ahead")).select(
        day_text(day).alias("date"), F.date_format(day, "EEEE").alias("day"),
        round_to(daily, 1).alias("expected_claims"), round_to(daily * average, 2).alias("expected_payout"))


def fraud_summary(workers: DataFrame) -> DataFrame:
    return workers.agg(
        F.sum("fraudulent_flags").alias("total_flags"), count_if(F.col("fraudulent_flags") > 0).alias("flagged"),
        count_if(F.col("pan_verified")).alias("pan_verified"),
        count_if(F.col("has_delivery_history")).alias("with_history"))


def outbox_backlog(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("events"))


def portfolio_kpis(workers: DataFrame, claims: DataFrame) -> DataFrame:
    sums = one_row(
        workers.agg(F.sum(F.coalesce("avg_daily_earning", F.lit(0.0))).alias("e"), F.count(F.lit(1)).alias("w")),
        claims.agg(F.count(F.lit(1)).alias("n"), count_if(is_approved()).alias("ok"),
                   count_if(is_rejected()).alias("bad"), sum_if(is_approved(), "amount").alias("total_paid"),
                   sum_if(is_rejected(), "amount").alias("amount_blocked")))
    return sums.select(
        round_to(ratio("e", "w")).alias("avg_earning"), "total_paid",
        round_to(ratio("ok", "n") * 100.0).alias("approval_pct"),
        round_to(ratio("bad", "n") * 100.0, 1).alias("fraud_pct"), "amount_blocked")


def plan_distribution(workers: DataFrame) -> DataFrame:
    per = workers.groupBy("plan").agg(F.count(F.lit(1)).alias("workers"))
    everyone = Window.partitionBy(F.lit(1))  # over one row per plan
    return per.withColumn("share_pct", round_to(ratio("workers", F.sum("workers").over(everyone)) * 100.0))


def coverage_gap(workers: DataFrame, policies: DataFrame) -> DataFrame:
    base = one_row(
        workers.agg(F.count(F.lit(1)).alias("w"), F.sum("avg_daily_earning").alias("e")),
        policies.agg(count_if(F.col("status") == "active").alias("insured")))
    return base.select(
        "insured", F.greatest(F.lit(0).cast("bigint"), F.col("w") - F.col("insured")).alias("uninsured"),
        (F.col("insured") * round_to(ratio("e", "w")) * 5).alias("weekly_earnings_at_risk"))


def zone_risk_from_rain(readings: DataFrame) -> DataFrame:
    """Zone profile from daily rain: totals, wet days, flood frequency, waterlogging."""
    daily = readings.groupBy("pincode", F.to_date("ts").alias("day")).agg(F.sum("rain_mm_hr").alias("mm"))
    per = daily.groupBy("pincode").agg(
        F.sum("mm").alias("total_mm"), F.count(F.lit(1)).alias("days"),
        count_if(F.col("mm") > 7.5).alias("wet_days"), count_if(F.col("mm") > 20.0).alias("heavy_days"))
    n = F.greatest("days", F.lit(1))
    return per.select(
        "pincode", round_to("total_mm", 1).alias("total_mm"), "days", "wet_days", "heavy_days",
        round_to(F.least(F.col("wet_days") / n, F.lit(1.0)), 3).alias("flood_frequency"),
        round_to(F.least((F.col("wet_days") + F.col("heavy_days") * 0.5) / n, F.lit(1.0)), 3).alias("waterlogging_score"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("collection"), "rows")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("events"))


def cumulative_histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Rows at or below each bound, all bounds in one pass."""
    total = df.agg(*[count_if(F.col(column) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
                   F.count(column).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def hit_rate(probed: DataFrame, found: Column) -> DataFrame:
    return probed.agg(count_if(found).alias("hits"), count_if(~found).alias("misses")).select(
        "hits", "misses", (F.col("hits") + F.col("misses")).alias("total"),
        F.coalesce(round_to(ratio("hits", F.col("hits") + F.col("misses")) * 100.0, 1), F.lit(0.0)).alias("hit_rate"))


def top_k(df: DataFrame, measure: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(measure), tie).limit(k)


def not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference on whole rows."""
    return left.distinct().exceptAll(right.distinct())


def other_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, others): how many other members share the group.

    Counted from distinct pairs; no member list is collected.
    """
    pairs = df.select(group, member).distinct()
    sizes = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    return pairs.join(sizes, group).select(group, member, (F.col("members") - 1).alias("others"))


