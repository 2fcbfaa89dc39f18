"""Dashboards, top-k and set operations."""

from pyspark.sql import functions as F

from parasol.operators import change, matching, rollups, triggers, warehouse as wh
from parasol.operators.scoring import with_zone_profile
from parasol.plans.registry import ORACLES, query, sql_round
from parasol.plans.signal_queries import ASOF_SQL, fired_sql, snapshots

AS_OF = "2001-07-25"
APPROVED = "sum(CASE WHEN status = 'approved' THEN {} ELSE 0 END)"


@query("g1_worker_coverage", f"""
SELECT w.worker_id, CASE WHEN policy_paused THEN 'paused' WHEN p.worker_id IS NOT NULL THEN 'active' ELSE 'no_policy' END AS coverage,
 k.weekly_cap, {sql_round("avg_daily_earning * 5", 2)} AS weekly_estimate,
 {sql_round("weekly_cap / greatest(avg_daily_earning * 5, 1) * 100", 1)} AS protected_pct
FROM workers w JOIN plans k USING (plan) LEFT JOIN policies p ON p.worker_id = w.worker_id
""")
def g1(t):
    return rollups.coverage(t.workers, t.policies, t.plans)


@query("g2_weekly_cap_use", f"""
SELECT w.worker_id, coalesce(u.used, 0) AS used, k.weekly_cap,
 {sql_round("least(coalesce(u.used, 0) / k.weekly_cap * 100, 100::DOUBLE)", 1)} AS used_pct,
 greatest(k.weekly_cap - coalesce(u.used, 0), 0) AS remaining
FROM workers w JOIN plans k USING (plan) LEFT JOIN (SELECT worker_id, sum(amount) AS used FROM claims WHERE status = 'approved'
 AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1) u USING (worker_id)
""")
def g2(t):
    return rollups.cap_use(t.workers, t.claims, t.plans, F.lit(AS_OF).cast("timestamp_ntz"))


@query("g3_worker_claim_summary", """
SELECT w.worker_id, count(c.claim_sk) AS total, count(CASE WHEN status = 'approved' THEN 1 END) AS approved,
 count(CASE WHEN contains(status, 'pending') THEN 1 END) AS pending, count(CASE WHEN contains(status, 'rejected') THEN 1 END) AS rejected,
 coalesce(sum(CASE WHEN status = 'approved' THEN amount ELSE 0 END), 0) AS paid
FROM workers w LEFT JOIN claims c USING (worker_id) GROUP BY 1
""")
def g3(t):
    return rollups.worker_summary(t.workers, t.claims)


@query("g4_insurer_overview", """
SELECT (SELECT count(*) FROM workers) AS total_workers, (SELECT count(*) FROM policies) AS active_policies, count(*) AS total_claims,
 count(CASE WHEN status = 'approved' THEN 1 END) AS approved, count(CASE WHEN contains(status, 'pending') THEN 1 END) AS pending,
 count(CASE WHEN contains(status, 'rejected') THEN 1 END) AS rejected FROM claims
""")
def g4(t):
    return rollups.overview(t.workers, t.policies, t.claims)


MONEY_SQL = """
money AS (SELECT sum(CASE WHEN status = 'approved' THEN amount ELSE 0 END) AS total_payout,
 sum(CASE WHEN status = 'approved' AND payout_processed THEN amount ELSE 0 END) AS payout_processed,
 (SELECT CAST(sum(weekly_premium) AS BIGINT) FROM workers JOIN plans USING (plan)) AS weekly_pool FROM claims),
fin AS (SELECT *, weekly_pool * 52 AS annual_pool, total_payout / greatest(weekly_pool * 52, 1) * 100 AS used FROM money)
"""


@query("g5_financials", f"""
WITH {MONEY_SQL}
SELECT total_payout, payout_processed, weekly_pool, annual_pool, {sql_round("used", 1)} AS loss_ratio_pct,
 CASE WHEN {sql_round("used", 1)} < 55 THEN 'healthy' WHEN {sql_round("used", 1)} < 70 THEN 'watch' ELSE 'critical' END AS loss_status FROM fin
""")
def g5(t):
    return rollups.financials(t.workers, t.claims, t.plans)


@query("g6_pool_health", f"""
WITH {MONEY_SQL}
SELECT {sql_round("used", 1)} AS utilisation_pct, {sql_round("greatest(0::DOUBLE, 100 - used)", 1)} AS reserve_pct FROM fin
""")
def g6(t):
    return rollups.pool_health(rollups.financials(t.workers, t.claims, t.plans))


@query("g7_score_histogram", f"""
WITH s AS (SELECT coalesce(nullif(trust_score, 0), 50) AS s FROM workers),
 g AS (SELECT CASE WHEN s >= 85 THEN 'A+' WHEN s >= 75 THEN 'A' WHEN s >= 62 THEN 'B+' WHEN s >= 50 THEN 'B' WHEN s >= 35 THEN 'C' ELSE 'D' END AS grade FROM s)
SELECT n.grade, count(g.grade) AS workers, (SELECT {sql_round("sum(CAST(s AS DECIMAL(10,2)))::DOUBLE / count(*)", 1)} FROM s) AS average
FROM (VALUES ('A+'), ('A'), ('B+'), ('B'), ('C'), ('D')) n(grade) LEFT JOIN g ON g.grade = n.grade GROUP BY n.grade
""")
def g7(t):
    return rollups.score_histogram(t.workers)


@query("g8_claims_by_trigger", "SELECT trigger_type, count(*) AS claims FROM claims GROUP BY 1")
def g8(t):
    return rollups.claims_by_trigger(t.claims)


@query("g9_seven_day_forecast", f"""
WITH b AS (SELECT (SELECT CAST(sum(coalesce(disruption_days_per_year, 18)) AS BIGINT) FROM workers LEFT JOIN zone_risk USING (pincode)) AS days,
  (SELECT count(*) FROM workers) AS n, (SELECT sum(amount) FROM claims WHERE status = 'approved') AS paid,
  (SELECT count(*) FROM claims WHERE status = 'approved') AS ok)
SELECT strftime(DATE '{AS_OF}' + CAST(i AS INT), '%Y-%m-%d') AS date, strftime(DATE '{AS_OF}' + CAST(i AS INT), '%A') AS day,
 {sql_round("(days / n) / 365 * n", 1)} AS expected_claims, {sql_round("(days / n) / 365 * n * (paid / ok)", 2)} AS expected_payout
FROM b, range(1, 8) r(i)
""")
def g9(t):
    return rollups.seven_day_forecast(t.workers, t.claims, t.zone_risk, AS_OF)


@query("g10_fraud_summary", """
SELECT CAST(sum(fraudulent_flags) AS BIGINT) AS total_flags, count(CASE WHEN fraudulent_flags > 0 THEN 1 END) AS flagged,
 count(CASE WHEN pan_verified THEN 1 END) AS pan_verified, count(CASE WHEN has_delivery_history THEN 1 END) AS with_history FROM workers
""")
def g10(t):
    return rollups.fraud_summary(t.workers)


@query("g11_outbox_backlog", "SELECT status, count(*) AS events FROM outbox GROUP BY 1")
def g11(t):
    return rollups.outbox_backlog(t.outbox)


@query("g12_portfolio_kpis", f"""
SELECT {sql_round("(SELECT sum(avg_daily_earning) / count(*) FROM workers)")} AS avg_earning,
 sum(CASE WHEN status = 'approved' THEN amount ELSE 0 END) AS total_paid,
 {sql_round("count(CASE WHEN status = 'approved' THEN 1 END) / count(*) * 100")} AS approval_pct,
 {sql_round("count(CASE WHEN contains(status, 'rejected') THEN 1 END) / count(*) * 100", 1)} AS fraud_pct,
 sum(CASE WHEN contains(status, 'rejected') THEN amount ELSE 0 END) AS amount_blocked FROM claims
""")
def g12(t):
    return rollups.portfolio_kpis(t.workers, t.claims)


@query("g13_plan_distribution", f"""
SELECT plan, count(*) AS workers, {sql_round("count(*) / (SELECT count(*) FROM workers) * 100")} AS share_pct FROM workers GROUP BY 1
""")
def g13(t):
    return rollups.plan_distribution(t.workers)


@query("g14_coverage_gap", f"""
WITH b AS (SELECT (SELECT count(*) FROM policies) AS insured, count(*) AS w, {sql_round("sum(avg_daily_earning) / count(*)")} AS e FROM workers)
SELECT insured, greatest(0, w - insured) AS uninsured, insured * e * 5 AS weekly_earnings_at_risk FROM b
""")
def g14(t):
    return rollups.coverage_gap(t.workers, t.policies)


@query("g15_zone_risk_from_rain", f"""
WITH d AS (SELECT pincode, CAST(ts AS DATE) AS day, sum(rain_mm_hr) AS mm FROM readings GROUP BY 1, 2),
 p AS (SELECT pincode, sum(mm) AS mm, count(*) AS days, count(CASE WHEN mm > 7.5 THEN 1 END) AS wet_days,
  count(CASE WHEN mm > 20 THEN 1 END) AS heavy_days FROM d GROUP BY 1)
SELECT pincode, {sql_round("mm", 1)} AS total_mm, days, wet_days, heavy_days, {sql_round("least(wet_days / days, 1::DOUBLE)", 3)} AS flood_frequency,
 {sql_round("least((wet_days + heavy_days * 0.5::DOUBLE) / days, 1::DOUBLE)", 3)} AS waterlogging_score FROM p
""")
def g15(t):
    return rollups.zone_risk_from_rain(t.readings)


@query("g16_collection_counts", """
SELECT 'workers' AS collection, count(*) AS rows FROM workers UNION ALL SELECT 'policies', count(*) FROM policies
UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'payout_requests', count(*) FROM payout_requests
UNION ALL SELECT 'outbox_events', count(*) FROM outbox
""")
def g16(t):
    return rollups.table_counts({"workers": t.workers, "policies": t.policies, "claims": t.claims,
                                 "payout_requests": t.payout_requests, "outbox_events": t.outbox})


BOUNDS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]


@query("g17_score_histogram_buckets", f"""
SELECT le, (SELECT count(*) FROM claims WHERE fraud_score <= b) AS count
FROM (VALUES {", ".join(f"('{b}', {b})" for b in BOUNDS)}, ('+Inf', 1000)) v(le, b)
""")
def g17(t):
    return rollups.cumulative_histogram(t.claims, "fraud_score", BOUNDS)


@query("g17_event_counters", "SELECT topic, status, count(*) AS events FROM outbox GROUP BY 1, 2")
def g17b(t):
    return rollups.counters(t.outbox, ["topic", "status"])


@query("g18_cache_hit_rate", f"""
SELECT count(snapshot_id) AS hits, count(*) - count(snapshot_id) AS misses, count(*) AS total,
 {sql_round("count(snapshot_id) / count(*) * 100", 1)} AS hit_rate FROM ({ASOF_SQL.replace("{ttl}", "7200000000")}) q
""")
def g18(t):
    probed = matching.with_zone_snapshot(
        t.readings.select("reading_id", "pincode", "ts"), snapshots(t), ["snapshot_id"], 7200, "snapshot_id")
    return rollups.hit_rate(probed, F.col("snapshot_id").isNotNull())


@query("t1_top_zones", ORACLES["v1_claims_by_city"] + " ORDER BY total_payout_inr DESC, pincode LIMIT 10")
def t1(t):
    by_city = wh.claims_by_city(wh.fact_claims(t.claims, t.workers), wh.dim_location(t.workers))
    return rollups.top_k(by_city, "total_payout_inr", "pincode", 10)


@query("t3_append_trigger_branches", f"""
WITH {fired_sql("readings")} SELECT trigger_type, pincode, count(*) AS firings FROM fired GROUP BY 1, 2
""")
def t3(t):
    # The branches are appended in one pass: each reading yields its fired triggers.
    judged = triggers.evaluate(with_zone_profile(t.readings, t.zone_risk))
    return rollups.counters(triggers.fired(judged), ["trigger_type", "pincode"]).withColumnRenamed("events", "firings")


@query("t4_natural_key_distinct", """
SELECT worker_id, claim_sk, trigger_type, status FROM (SELECT *, row_number() OVER
 (PARTITION BY worker_id ORDER BY updated_at DESC, claim_sk DESC) AS rn FROM claims) q WHERE rn = 1
""")
def t4(t):
    rows = t.claims.select("worker_id", "claim_sk", "trigger_type", "status", "updated_at")
    return change.latest_per_key(rows, ["worker_id"], ["updated_at", "claim_sk"]).drop("updated_at")


@query("t5_set_difference", """
WITH d AS (SELECT worker_id FROM claims WHERE status LIKE 'rejected%' EXCEPT SELECT worker_id FROM claims WHERE status = 'approved'),
 p AS (SELECT DISTINCT device_id, worker_id FROM claims)
SELECT p.device_id, p.worker_id, (SELECT count(*) FROM p q WHERE q.device_id = p.device_id) - 1 AS others,
 (p.worker_id IN (SELECT worker_id FROM d)) AS only_rejected FROM p
""")
def t5(t):
    rejected = t.claims.where("status like 'rejected%'").select("worker_id")
    approved = t.claims.where("status = 'approved'").select("worker_id")
    only = rollups.not_in(rejected, approved).withColumn("only_rejected", F.lit(True))
    members = rollups.other_members(t.claims, "device_id", "worker_id")
    return members.join(only, "worker_id", "left").select(
        "device_id", "worker_id", "others", F.coalesce("only_rejected", F.lit(False)).alias("only_rejected"))
