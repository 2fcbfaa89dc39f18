"""Documents, lookups and change application."""

from pyspark.sql import functions as F

from parasol.operators import change, documents as docs
from parasol.plans.registry import query

FLAT_SQL = """
SELECT worker_id, worker_name AS name, pincode, plan, pan_number, pan_verified, policy_paused,
 array_to_string(list_filter(string_split(platforms_csv, ','), lambda x: x <> ''), ',') AS platform_links,
 CASE WHEN has_delivery_history THEN total_deliveries ELSE 0 END AS total_deliveries, has_delivery_history,
 CASE WHEN has_delivery_history THEN account_age_days ELSE 90 END AS account_age_days,
 CASE WHEN has_delivery_history THEN delivery_consistency ELSE 0.80 END::DOUBLE AS delivery_consistency,
 CASE WHEN has_delivery_history THEN avg_daily_earning ELSE 600.0 END::DOUBLE AS avg_daily_earning,
 claim_free_weeks, past_claims_count, location_honesty, claim_history_score, fraudulent_flags, trust_score
FROM workers
"""


def _sparse_documents(t):
    """Worker documents; those without history lack the delivery profile."""
    nested = docs.nest_worker(t.workers)
    return nested.withColumn(
        "delivery_profile",
        F.when(F.col("delivery_profile.has_delivery_history"), F.col("delivery_profile")))


@query("f1_flatten_worker", FLAT_SQL)
def f1(t):
    flat = docs.flatten_worker(_sparse_documents(t))
    return flat.withColumn("platform_links", F.array_join("platform_links", ","))


@query("f2_flatten_claim", """
SELECT claim_sk, claim_id, status, fraud_score, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
 strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM claims
""")
def f2(t):
    # Half of the documents hold the score only inside the fraud result.
    nested = t.claims.select(
        "claim_sk", "claim_id", "status", "created_at", "updated_at",
        F.struct(F.col("fraud_score").alias("score"), F.lit("LOW").alias("risk_level")).alias("fraud_result"),
        F.when(F.col("claim_sk") % 2 == 0, F.col("fraud_score")).alias("fraud_score"))
    return docs.flatten_claim(nested)


@query("f3_equality_lookups", """
SELECT 'worker' AS kind, worker_name AS key, pincode AS detail FROM workers WHERE worker_name = 'Customer#000000007'
UNION ALL SELECT 'claims_of_worker', worker_name, claim_id FROM claims JOIN workers USING (worker_id) WHERE worker_name = 'Customer#000000007'
UNION ALL SELECT 'claim', claim_id, status FROM claims WHERE claim_sk = 7
""")
def f3(t):
    worker = docs.lookup_by(t.workers, "worker_name", "Customer#000000007")
    of_worker = t.claims.join(worker.select("worker_id", "worker_name"), "worker_id")
    claim = docs.lookup_by(t.claims, "claim_sk", 7)
    return (
        worker.select(F.lit("worker").alias("kind"), F.col("worker_name").alias("key"), F.col("pincode").alias("detail"))
        .unionAll(of_worker.select(F.lit("claims_of_worker"), "worker_name", "claim_id"))
        .unionAll(claim.select(F.lit("claim"), "claim_id", "status"))
    )


@query("f4_claims_of_worker", """
SELECT worker_id, claim_sk, rn FROM (SELECT worker_id, claim_sk, CAST(row_number() OVER
 (PARTITION BY worker_id ORDER BY created_at DESC, claim_sk DESC) AS INT) AS rn FROM claims) q WHERE rn <= 200
""")
def f4(t):
    return docs.newest_per_worker(t.claims, 200).select("worker_id", "claim_sk", "rn")


@query("f5_newest_claims", """
SELECT claim_sk, claim_id, amount, status FROM claims ORDER BY created_at DESC, claim_sk DESC LIMIT 1000
""")
def f5(t):
    return docs.newest_claims(t.claims, 1000).select("claim_sk", "claim_id", "amount", "status")


@query("f6_payout_queue", """
SELECT claim_sk, claim_id, worker_id, amount FROM claims WHERE status = 'approved' AND NOT payout_processed
""")
def f6(t):
    return docs.approved_unpaid(t.claims).select("claim_sk", "claim_id", "worker_id", "amount")


@query("f7_pending_outbox", """
SELECT event_id, topic, retry_count FROM outbox WHERE status = 'pending' ORDER BY created_at, event_id LIMIT 20
""")
def f7(t):
    return docs.pending_outbox(t.outbox, 20).select("event_id", "topic", "retry_count")


@query("f8_failed_by_topic", """
SELECT event_id, topic, retry_count FROM outbox WHERE status = 'failed' AND topic = 'claim.approved'
ORDER BY created_at DESC, event_id DESC LIMIT 50
""")
def f8(t):
    return docs.failed_events(t.outbox, "claim.approved", 50).select("event_id", "topic", "retry_count")


@query("f9_worker_search", """
SELECT worker_id, worker_name, pincode, plan, trust_score FROM workers
WHERE lower(worker_name) LIKE '%5600%' OR pincode LIKE '%5600%' OR plan LIKE '%5600%'
""")
def f9(t):
    return docs.search_workers(t.workers, "5600").select("worker_id", "worker_name", "pincode", "plan", "trust_score")


@query("f10_ledger_filter", """
SELECT claim_sk, status, status = 'approved' AS in_approved, contains(status, 'pending') AS in_pending,
 contains(status, 'rejected') AS in_rejected FROM claims
""")
def f10(t):
    return t.claims.select("claim_sk", "status", *[
        docs.in_ledger("status", w).alias(f"in_{w}") for w in ("approved", "pending", "rejected")])


@query("m1_upsert_latest_wins", """
WITH base AS (SELECT claim_sk, requested_at, attempt, amount, mode FROM (SELECT *, row_number() OVER
  (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount) AS rn FROM payout_requests WHERE mode = 'live_api') b WHERE rn = 1),
 chg AS (SELECT claim_sk, requested_at, attempt, amount, mode FROM (SELECT *, row_number() OVER
  (PARTITION BY claim_sk ORDER BY requested_at DESC, attempt DESC, amount DESC) AS rn FROM payout_requests WHERE mode <> 'live_api') c WHERE rn = 1)
SELECT coalesce(c.claim_sk, b.claim_sk) AS claim_sk, CASE WHEN c.claim_sk IS NULL THEN b.attempt ELSE c.attempt END AS attempt,
 CASE WHEN c.claim_sk IS NULL THEN b.amount ELSE c.amount END AS amount, CASE WHEN c.claim_sk IS NULL THEN b.mode ELSE c.mode END AS mode
FROM base b FULL JOIN chg c ON b.claim_sk = c.claim_sk
""")
def m1(t):
    requests = t.payout_requests
    base = change.earliest_per_key(requests.where("mode = 'live_api'"), ["claim_sk"], ["requested_at", "attempt", "amount"])
    merged = change.upsert(base, requests.where("mode <> 'live_api'"), ["claim_sk"], ["requested_at", "attempt", "amount"])
    return merged.select("claim_sk", "attempt", "amount", "mode")


@query("m2_field_changes", """
WITH log AS (SELECT worker_id, created_at, claim_sk, fraud_score, CASE claim_sk % 3 WHEN 0 THEN 'total_deliveries'
  WHEN 1 THEN 'trust_score' ELSE 'plan' END AS field,
  CASE claim_sk % 3 WHEN 2 THEN 'plan-' || CAST(fraud_score AS VARCHAR) ELSE CAST(fraud_score AS VARCHAR) END AS value FROM claims),
 last_set AS (SELECT worker_id, field, value FROM (SELECT *, row_number() OVER
  (PARTITION BY worker_id, field ORDER BY created_at DESC, claim_sk DESC) AS rn FROM log) q WHERE rn = 1),
 wide AS (SELECT worker_id, max(CASE WHEN field = 'total_deliveries' THEN value END) AS d,
  max(CASE WHEN field = 'trust_score' THEN value END) AS s, max(CASE WHEN field = 'plan' THEN value END) AS p FROM last_set GROUP BY 1),
 stamps AS (SELECT worker_id, max(created_at) AS m FROM claims GROUP BY 1)
SELECT w.worker_id, coalesce(CAST(d AS INT), total_deliveries) AS total_deliveries,
 coalesce(CAST(s AS DOUBLE), trust_score) AS trust_score, coalesce(p, plan) AS plan,
 strftime(m, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM workers w LEFT JOIN wide USING (worker_id) LEFT JOIN stamps USING (worker_id)
""")
def m2(t):
    kind = F.col("claim_sk") % 3
    score = F.col("fraud_score").cast("string")
    log = t.claims.select(
        "worker_id", "created_at", "claim_sk",
        F.when(kind == 0, "total_deliveries").when(kind == 1, "trust_score").otherwise("plan").alias("field"),
        F.when(kind == 2, F.concat(F.lit("plan-"), score)).otherwise(score).alias("value"))
    wide = docs.changes_to_wide(log, "worker_id", "created_at", "claim_sk",
                                {"total_deliveries": "int", "trust_score": "double", "plan": "string"})
    changed = docs.with_fields(docs.nest_worker(t.workers), wide, "worker_id", "changed_at")
    return docs.flatten_worker(changed).select("worker_id", "total_deliveries", "trust_score", "plan").join(
        changed.select("worker_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")), "worker_id")


@query("m3_keyed_updates", """
WITH first_req AS (SELECT claim_sk, requested_at, row_number() OVER
  (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT c.claim_sk, CASE WHEN p.claim_sk IS NULL THEN payout_processed ELSE true END AS payout_processed,
 CASE WHEN p.claim_sk IS NULL THEN NULL ELSE 'pout-' || CAST(c.claim_sk AS VARCHAR) END AS payout_id,
 strftime(CASE WHEN p.claim_sk IS NULL THEN updated_at ELSE requested_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM claims c LEFT JOIN (SELECT f.* FROM first_req f JOIN claims k ON f.claim_sk = k.claim_sk AND k.status = 'approved'
 WHERE rn = 1) p ON c.claim_sk = p.claim_sk
""")
def m3(t):
    paid = change.earliest_per_key(t.payout_requests, ["claim_sk"], ["requested_at", "attempt", "amount", "mode"])
    approved = t.claims.where("status = 'approved'").select("claim_sk")
    paid = paid.join(approved, "claim_sk").select("claim_sk", "requested_at")
    base = t.claims.select("claim_sk", "payout_processed", F.lit(None).cast("string").alias("payout_id"), "updated_at")
    marked = change.update_where(base, paid, ["claim_sk"], {
        "payout_processed": F.lit(True),
        "payout_id": F.concat(F.lit("pout-"), F.col("claim_sk").cast("string")),
        "updated_at": F.col("new.requested_at"),
    })
    return marked.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("m4_toggle_and_increment", """
SELECT w.worker_id, (policy_paused <> (coalesce(presses, 0) % 2 = 1)) AS policy_paused,
 CAST(fraudulent_flags + coalesce(rejected, 0) AS BIGINT) AS fraudulent_flags
FROM workers w LEFT JOIN (SELECT worker_id, sum(CASE WHEN trigger_type = 'manual' THEN 1 ELSE 0 END) AS presses,
 sum(CASE WHEN status LIKE 'rejected%' THEN 1 ELSE 0 END) AS rejected FROM claims GROUP BY 1) c USING (worker_id)
""")
def m4(t):
    log = t.claims.groupBy("worker_id").agg(
        F.count(F.when(F.col("trigger_type") == "manual", 1)).alias("presses"),
        F.count(F.when(F.col("status").startswith("rejected"), 1)).alias("rejected"))
    return t.workers.join(log, "worker_id", "left").select(
        "worker_id", change.toggled(F.col("policy_paused"), F.col("presses")).alias("policy_paused"),
        (F.col("fraudulent_flags") + F.coalesce("rejected", F.lit(0))).alias("fraudulent_flags"))


@query("m5_policy_upsert", """
WITH req AS (SELECT worker_name, CASE WHEN worker_id % 29 = 0 THEN 'gold' ELSE plan END AS plan FROM workers WHERE NOT policy_paused),
 old AS (SELECT worker_name, plan, weekly_premium, weekly_cap FROM workers JOIN plans USING (plan) WHERE policy_paused OR worker_id % 3 = 0)
SELECT coalesce(r.worker_name, o.worker_name) AS worker_name, coalesce(r.plan, o.plan) AS plan,
 CASE WHEN r.plan IS NULL THEN 'paused' ELSE 'active' END AS status,
 CASE WHEN r.plan IS NULL THEN o.weekly_premium ELSE coalesce(p.weekly_premium, 49) END AS weekly_premium,
 CASE WHEN r.plan IS NULL THEN o.weekly_cap ELSE coalesce(p.weekly_cap, 1500) END AS weekly_cap,
 CASE WHEN o.worker_name IS NULL THEN '2001-08-02' ELSE '1995-01-01' END AS created_on,
 CASE WHEN r.plan IS NULL THEN '1995-01-01' ELSE '2001-08-02' END AS updated_on
FROM req r FULL JOIN old o ON r.worker_name = o.worker_name LEFT JOIN plans p ON r.plan = p.plan
""")
def m5(t):
    start, at = F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2001-08-02").cast("timestamp_ntz")
    existing = t.workers.where("policy_paused or worker_id % 3 = 0").join(
        t.plans, "plan").select(
        "worker_name", "plan", F.lit("paused").alias("status"), "weekly_premium", "weekly_cap",
        start.alias("created_at"), start.alias("updated_at"))
    requests = t.workers.where("not policy_paused").select(
        "worker_name", F.when(F.col("worker_id") % 29 == 0, "gold").otherwise(F.col("plan")).alias("plan"))
    done = docs.upsert_policies(existing, requests, t.plans, at)
    return done.select("worker_name", "plan", "status", "weekly_premium", "weekly_cap",
                       F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
                       F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))
