"""Star schema: dimensions, facts and the views over them.

Surrogate keys are hashes of the natural key, so any rerun gives the same key.
Key -1 is the unknown member. Q1 reports natural keys that share a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.constants import PLANS
from parasol.functions.numeric import as_col, count_if, percent_of, truthy_or
from parasol.functions.temporal import date_attributes, date_key

UNKNOWN = -1


def surrogate(natural) -> Column:
    return F.coalesce(F.xxhash64(as_col(natural).cast("string")), F.lit(UNKNOWN))


def risk_segment(score) -> Column:
    s = as_col(score)
    return (
        F.when(s >= 85, "LOW").when(s >= 70, "MEDIUM").when(s >= 50, "HIGH").otherwise("VERY_HIGH")
    )


def score_segment(score) -> Column:
    s = as_col(score)
    return (
        F.when(s.isNull(), "UNSCORED").when(s >= 85, "A_PLUS").when(s >= 75, "A")
        .when(s >= 50, "B").otherwise("C_D")
    )


def platform_count(csv) -> Column:
    return F.size(F.filter(F.split(as_col(csv), ","), lambda p: p != ""))


def dim_worker(workers: DataFrame) -> DataFrame:
    """One row per worker; ``workers`` is already unique by worker_id."""
    return workers.select(
        surrogate("worker_id").alias("worker_key"),
        "worker_id", "worker_name",
        F.coalesce("plan", F.lit("plus")).alias("plan"),
        risk_segment(truthy_or("trust_score", 50.0)).alias("risk_segment"),
        platform_count(F.coalesce("platforms_csv", F.lit(""))).alias("platform_count"),
        F.coalesce("account_age_days", F.lit(90)).alias("account_age_days"),
        F.coalesce("avg_daily_earning", F.lit(600.0)).alias("avg_daily_earning"),
        F.coalesce("pan_verified", F.lit(False)).alias("pan_verified"),
    )


def dim_location(zoned: DataFrame) -> DataFrame:
    """One row per pincode seen; state and risk class take the table's defaults."""
    return (
        zoned.groupBy("pincode").agg(F.max("city").alias("city"))
        .select(
            surrogate("pincode").alias("location_key"), "pincode",
            F.coalesce("city", F.lit("Unknown")).alias("city"),
            F.lit("India").alias("state"), F.lit("MEDIUM").alias("zone_risk_cat"),
            F.lit(30).alias("disruption_days_per_year"),
        )
    )


def dim_date(stamped: DataFrame, ts: str) -> DataFrame:
    days = stamped.select(F.col(ts).cast("date").alias("day")).distinct()
    return days.select(*date_attributes("day"))


def dim_disruption(claims: DataFrame) -> DataFrame:
    kinds = claims.select("trigger_type").distinct()
    return kinds.where("trigger_type is not null and trigger_type not in ('', 'manual')").select(
        surrogate("trigger_type").alias("disruption_key"), "trigger_type",
        F.when(F.col("trigger_type").isin("heavy_rain", "flood"), "HIGH").otherwise("MEDIUM")
        .alias("severity_category"),
        F.lit(True).alias("payout_eligible"),
    )


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS, "plan string, weekly_premium int, weekly_cap int, plan_speed string, rain_factor double"
    )


def dim_policy(workers: DataFrame) -> DataFrame:
    """One row per plan in use, with the tier's price, cap and speed."""
    plans = plan_table(workers.sparkSession)
    return workers.select("plan").distinct().join(plans, "plan").select(
        surrogate("plan").alias("policy_key"), F.col("plan").alias("plan_type"),
        "weekly_premium", "weekly_cap", F.col("plan_speed").alias("payout_speed"),
    )


def fact_claims(claims: DataFrame, workers: DataFrame) -> DataFrame:
    """One row per claim. Keys are computed from natural keys, so only the worker's
    attributes need a join; ``claims`` carries fraud and layer scores if it has them."""
    home = workers.select("worker_id", "pincode", "plan", "trust_score")
    optional = {
        "payout_speed": "string", "vision_verdict": "string", "layer0_score": "double",
        "layer1_score": "double", "layer2_score": "double", "layer3_score": "double",
        "layer4_score": "double",
    }
    have = set(claims.columns)
    known = F.col("plan").isNotNull()
    manual = F.coalesce(F.col("trigger_type"), F.lit("manual")) == "manual"
    return claims.join(home, "worker_id", "left").select(
        "claim_sk", "claim_id",
        F.when(known, surrogate("worker_id")).otherwise(UNKNOWN).alias("worker_key"),
        surrogate("pincode").alias("location_key"),
        date_key("created_at").alias("date_key"),
        F.when(~manual, surrogate("trigger_type")).alias("disruption_key"),
        surrogate("plan").alias("policy_key"),
        F.col("amount").alias("claim_amount"), "fraud_score",
        F.col("status").alias("claim_status"), "trigger_type",
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
        F.coalesce(F.col("photo_verified") if "photo_verified" in have else F.lit(None),
                   F.col("photo_submitted"), F.lit(False)).alias("photo_submitted"),
        truthy_or("trust_score", 50.0).alias("trust_score_at_claim"),
        "created_at", "updated_at",
    )


def payouts_from_requests(requests: DataFrame) -> DataFrame:
    """One payout per claim: the earliest request wins, later ones are redelivery."""
    first = F.min(F.struct("requested_at", "attempt", "amount", "mode")).alias("r")
    return requests.groupBy("claim_sk").agg(first).select("claim_sk", "r.*")


def fact_payouts(payouts: DataFrame, claim_facts: DataFrame) -> DataFrame:
    """One row per paid claim; the worker key comes from the claim fact."""
    keys = claim_facts.select("claim_sk", "claim_id", "worker_key")
    return payouts.join(keys, "claim_sk", "left").select(
        "claim_sk", "claim_id",
        F.coalesce("worker_key", F.lit(UNKNOWN)).alias("worker_key"),
        date_key("requested_at").alias("date_key"),
        "amount", F.col("mode").alias("gateway_mode"),
        F.lit("completed").alias("status"), F.col("requested_at").alias("processed_at"),
    )


def _approved(status: str = "claim_status") -> Column:
    return F.col(status) == "approved"


def _rejected(status: str = "claim_status") -> Column:
    return F.col(status).startswith("rejected")


def _totals(sums: DataFrame, keys: list[str], largest: tuple[str, ...] = (), least: tuple[str, ...] = ()) -> DataFrame:
    """Sums of parts added up by key; ``largest`` and ``least`` take the extreme instead."""
    kinds = {c: F.max if c in largest else F.min if c in least else F.sum for c in sums.columns if c not in keys}
    return sums.groupBy(*keys).agg(*[kind(c).alias(c) for c, kind in kinds.items()])


def claim_sums(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("claim_amount").alias("amount"),
        F.sum("fraud_score").alias("fraud"), F.count("fraud_score").alias("scored"), F.max("fraud_score").alias("top_fraud"),
        count_if(_approved()).alias("approved"), count_if(_rejected()).alias("rejected"),
    )


def _by(sums: DataFrame, key: str) -> DataFrame:
    """Claim sums of one key, added up if they are kept by period and other keys."""
    kept = sums.select(key, "n", "amount", "fraud", "scored", "top_fraud", "approved", "rejected")
    return _totals(kept, [key], largest=("top_fraud",)) if "period" in sums.columns else kept


def _mean_fraud() -> Column:
    return F.try_divide(F.col("fraud").cast("double"), F.col("scored").cast("double"))


def claims_by_city(facts: DataFrame, locations: DataFrame) -> DataFrame:
    """Claim totals per location. Facts are reduced by key before they meet the dimension."""
    return city_view(claim_sums(facts, "location_key"), locations)


def city_view(sums: DataFrame, locations: DataFrame) -> DataFrame:
    return _by(sums, "location_key").join(locations, "location_key").select(
        "city", "pincode", F.col("n").alias("total_claims"), F.col("amount").alias("total_payout_inr"),
        (F.col("amount") / F.col("n")).alias("avg_claim_inr"), _mean_fraud().alias("avg_fraud_score"),
        F.col("approved").alias("approved_count"), F.col("rejected").alias("rejected_count"),
        percent_of("approved", "n").alias("approval_rate_pct"),
    ).orderBy(F.desc("total_payout_inr"), "pincode")


def day_sums(facts: DataFrame, *more: str) -> DataFrame:
    return facts.groupBy(*more, "date_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"),
        F.min("amount").alias("lo"), F.max("amount").alias("hi"),
    )


def monthly_payouts(facts: DataFrame) -> DataFrame:
    """Payouts by month. A day's key holds its year and month, so no date dimension is joined."""
    return month_view(day_sums(facts))


def month_view(sums: DataFrame) -> DataFrame:
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    days = sums.select(F.year(day).alias("year"), F.month(day).alias("month"), F.date_format(day, "MMM").alias("month_name"), "n", "s", "lo", "hi")
    return _totals(days, ["year", "month", "month_name"], largest=("hi",), least=("lo",)).select(
        "year", "month", "month_name", F.col("n").alias("payout_count"), F.col("s").alias("total_payout_inr"),
        F.col("lo").alias("min_payout_inr"), F.col("hi").alias("max_payout_inr"),
        (F.col("s") / F.col("n")).alias("avg_payout_inr")).orderBy("year", "month")


def fraud_by_disruption(facts: DataFrame, disruptions: DataFrame) -> DataFrame:
    return disruption_view(claim_sums(facts.where("disruption_key is not null"), "disruption_key"), disruptions)


def disruption_view(sums: DataFrame, disruptions: DataFrame) -> DataFrame:
    return _by(sums, "disruption_key").join(disruptions, "disruption_key").select(
        "trigger_type", "severity_category", F.col("n").alias("total_claims"), _mean_fraud().alias("avg_fraud_score"),
        F.col("top_fraud").alias("max_fraud_score"), F.col("rejected").alias("fraud_rejections"),
        percent_of("rejected", "n").alias("fraud_rate_pct"),
    ).orderBy(F.desc("fraud_rate_pct"), "trigger_type")


def worker_risk_segments(workers: DataFrame, facts: DataFrame) -> DataFrame:
    """Workers by segment and plan, idle workers kept.

    Claims are reduced to one row per worker first, which makes the distinct
    worker count a plain count and keeps the outer join small.
    """
    return segment_view(workers, claim_sums(facts, "worker_key"))


def segment_view(workers: DataFrame, sums: DataFrame) -> DataFrame:
    return (
        workers.join(_by(sums, "worker_key"), "worker_key", "left").groupBy("risk_segment", "plan")
        .agg(
            F.count(F.lit(1)).alias("worker_count"),
            F.try_divide(F.sum("amount"), F.sum("n").cast("double")).alias("avg_claim_amount"),
            F.try_divide(F.sum("fraud").cast("double"), F.sum("scored").cast("double")).alias("avg_fraud_score"),
            F.coalesce(F.sum("approved"), F.lit(0)).alias("approved_claims"),
            F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected_claims"),
        )
        .orderBy("risk_segment", "plan")
    )
