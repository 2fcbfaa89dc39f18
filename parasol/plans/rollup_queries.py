"""V1-V4: the analytics views over the star schema."""

from pyspark.sql import functions as F

from parasol.operators import warehouse as wh
from parasol.plans.registry import query, sql_date_key, sql_round

RISK_SQL = """CASE WHEN coalesce(nullif(trust_score,0),50) >= 85 THEN 'LOW'
 WHEN coalesce(nullif(trust_score,0),50) >= 70 THEN 'MEDIUM'
 WHEN coalesce(nullif(trust_score,0),50) >= 50 THEN 'HIGH' ELSE 'VERY_HIGH' END"""


@query("v1_claims_by_city", f"""
SELECT city, pincode, total_claims, total_payout_inr, total_payout_inr / total_claims AS avg_claim_inr,
 avg_fraud_score, approved_count, rejected_count,
 {sql_round("approved_count::DOUBLE / total_claims::DOUBLE * 100::DOUBLE", 1)} AS approval_rate_pct
FROM (SELECT w.city, w.pincode, count(*) AS total_claims, sum(c.amount) AS total_payout_inr,
 sum(c.fraud_score)::DOUBLE / count(c.fraud_score)::DOUBLE AS avg_fraud_score,
 CAST(sum(CASE WHEN c.status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved_count,
 CAST(sum(CASE WHEN c.status LIKE 'rejected%' THEN 1 ELSE 0 END) AS BIGINT) AS rejected_count
 FROM claims c JOIN workers w USING (worker_id) GROUP BY w.city, w.pincode) q
""")
def v1(t):
    return wh.claims_by_city(wh.fact_claims(t.claims, t.workers), wh.dim_location(t.workers))


@query("v2_monthly_payouts", """
WITH first_req AS (SELECT claim_sk, requested_at, amount,
  row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT CAST(year(requested_at) AS INT) AS year, CAST(month(requested_at) AS INT) AS month,
 strftime(requested_at, '%b') AS month_name, count(*) AS payout_count, sum(amount) AS total_payout_inr,
 sum(amount) / count(*) AS avg_payout_inr, min(amount) AS min_payout_inr, max(amount) AS max_payout_inr
FROM first_req WHERE rn = 1 GROUP BY 1, 2, 3
""")
def v2(t):
    payouts = wh.payouts_from_requests(t.payout_requests)
    # The rollup needs no worker key, so the claim facts are not joined.
    facts = payouts.select(wh.date_key("requested_at").alias("date_key"), "amount")
    return wh.monthly_payouts(facts)


@query("v3_fraud_by_disruption", f"""
SELECT trigger_type, CASE WHEN trigger_type IN ('heavy_rain','flood') THEN 'HIGH' ELSE 'MEDIUM' END AS severity_category,
 count(*) AS total_claims, sum(fraud_score)::DOUBLE / count(*)::DOUBLE AS avg_fraud_score,
 max(fraud_score) AS max_fraud_score,
 CAST(sum(CASE WHEN status LIKE 'rejected%' THEN 1 ELSE 0 END) AS BIGINT) AS fraud_rejections,
 {sql_round("sum(CASE WHEN status LIKE 'rejected%' THEN 1 ELSE 0 END)::DOUBLE / count(*)::DOUBLE * 100::DOUBLE", 1)} AS fraud_rate_pct
FROM claims WHERE trigger_type <> 'manual' GROUP BY 1, 2
""")
def v3(t):
    return wh.fraud_by_disruption(wh.fact_claims(t.claims, t.workers), wh.dim_disruption(t.claims))


@query("v4_worker_risk_segments", f"""
SELECT {RISK_SQL} AS risk_segment, plan, count(DISTINCT w.worker_id) AS worker_count,
 sum(c.amount) / count(c.claim_sk)::DOUBLE AS avg_claim_amount,
 sum(c.fraud_score)::DOUBLE / count(c.fraud_score)::DOUBLE AS avg_fraud_score,
 CAST(sum(CASE WHEN c.status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved_claims,
 CAST(sum(CASE WHEN c.status LIKE 'rejected%' THEN 1 ELSE 0 END) AS BIGINT) AS rejected_claims
FROM workers w LEFT JOIN claims c USING (worker_id) GROUP BY 1, 2
""")
def v4(t):
    return wh.worker_risk_segments(wh.dim_worker(t.workers), wh.fact_claims(t.claims, t.workers))


@query("j5_fact_to_dimensions", """
SELECT w.city, c.trigger_type, count(*) AS claims, sum(c.amount) AS amount
FROM claims c JOIN workers w USING (worker_id) WHERE c.trigger_type <> 'manual' GROUP BY 1, 2
""")
def j5(t):
    facts = wh.fact_claims(t.claims, t.workers)
    starred = facts.join(wh.dim_location(t.workers), "location_key").join(
        wh.dim_disruption(t.claims).select("disruption_key", "severity_category"), "disruption_key")
    return starred.groupBy("city", "trigger_type").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").alias("amount"))


@query("j6_workers_keeping_idle", """
SELECT w.worker_id, w.plan, count(c.claim_sk) AS claims, coalesce(sum(c.amount), 0) AS amount
FROM workers w LEFT JOIN claims c USING (worker_id) GROUP BY 1, 2
""")
def j6(t):
    facts = wh.fact_claims(t.claims, t.workers).groupBy("worker_key").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").alias("amount"))
    return wh.dim_worker(t.workers).join(facts, "worker_key", "left").select(
        "worker_id", "plan", F.coalesce("claims", F.lit(0)).alias("claims"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query("j7_payout_takes_worker_from_claim", """
WITH first_req AS (SELECT claim_sk, amount,
  row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT p.claim_sk, p.amount, c.claim_id, (c.claim_sk IS NOT NULL) AS claim_known
FROM first_req p LEFT JOIN claims c USING (claim_sk) WHERE rn = 1
""")
def j7(t):
    facts = wh.fact_payouts(wh.payouts_from_requests(t.payout_requests), wh.fact_claims(t.claims, t.workers))
    return facts.select("claim_sk", "amount", "claim_id", (F.col("worker_key") != wh.UNKNOWN).alias("claim_known"))


@query("e1_dim_worker", f"""
SELECT worker_id, worker_name, plan, {RISK_SQL} AS risk_segment,
 CASE WHEN platforms_csv = '' THEN 0 ELSE len(string_split(platforms_csv, ',')) END::INT AS platform_count,
 account_age_days, avg_daily_earning, pan_verified FROM workers
""")
def e1(t):
    return wh.dim_worker(t.workers).drop("worker_key")


@query("e2_dim_location", """
SELECT DISTINCT pincode, city, 'India' AS state, 'MEDIUM' AS zone_risk_cat, CAST(30 AS INT) AS disruption_days_per_year
FROM workers JOIN claims USING (worker_id)
""")
def e2(t):
    return wh.dim_location(t.claims_with_zone).drop("location_key")


@query("e3_dim_date", f"""
SELECT DISTINCT {sql_date_key("created_at")} AS date_key, strftime(created_at, '%Y-%m-%d') AS date,
 strftime(created_at, '%a') AS day_of_week, CAST(isodow(created_at) AS INT) AS day_num,
 CAST(month(created_at) AS INT) AS month, strftime(created_at, '%b') AS month_name,
 CAST(quarter(created_at) AS INT) AS quarter, CAST(year(created_at) AS INT) AS year,
 (isodow(created_at) >= 6) AS is_weekend, (month(created_at) IN (6,7,8,9)) AS is_monsoon FROM claims
""")
def e3(t):
    return wh.dim_date(t.claims, "created_at")


@query("e4_dim_disruption", """
SELECT DISTINCT trigger_type, CASE WHEN trigger_type IN ('heavy_rain','flood') THEN 'HIGH' ELSE 'MEDIUM' END AS severity_category,
 true AS payout_eligible FROM claims WHERE trigger_type <> 'manual'
""")
def e4(t):
    return wh.dim_disruption(t.claims).drop("disruption_key")


@query("e5_dim_policy", """
SELECT DISTINCT p.plan AS plan_type, p.weekly_premium, p.weekly_cap, p.plan_speed AS payout_speed
FROM workers w JOIN plans p ON w.plan = p.plan
""")
def e5(t):
    return wh.dim_policy(t.workers).drop("policy_key")
