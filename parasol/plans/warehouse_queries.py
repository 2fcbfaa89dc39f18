"""Incremental load, checkpoint, run summary, quality."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from parasol.operators import quality, warehouse as wh
from parasol.plans.pricing_queries import AMOUNT_SQL
from parasol.plans.registry import ORACLES, query, sql_date_key
from parasol.plans.signal_queries import fired_rows, fired_sql
from parasol.plans.stream_queries import once, state_partitions
from parasol.operators import triggers
from parasol.plans.warehouse import Warehouse, load_arrivals, run_full_etl
from parasol.session import materialized, scratch_path

CUT = "1998-06-30"
FIRST, SECOND = datetime(1995, 1, 15), datetime(2001, 8, 5)


def _house(t, name):
    # The test tables are small: one partition per year.
    return Warehouse(t.spark, scratch_path(t.spark, name), period_digits=4)


def _payouts(t):
    """Each claim's payout, worked out once; every load reads the written rows."""
    return materialized(wh.payouts_from_requests(t.payout_requests), "payouts")


def _two_runs(t, user):
    """The warehouse after three runs."""
    return once(t, "warehouse", user, lambda: _load(t))


def _load(t):
    """A first load up to the cut, a second of what changed since, and a repeat of the second."""
    house = _house(t, "warehouse")
    payouts = _payouts(t)
    early = F.lit(CUT).cast("timestamp_ntz")
    runs = [run_full_etl(house, t.claims.where(F.col("updated_at") <= early), t.workers,
                         payouts.where(F.col("requested_at") <= early), FIRST)]
    for _ in range(2):
        runs.append(run_full_etl(house, t.claims, t.workers, payouts, SECOND))
    return house, runs


@query("e6_fact_claims_incremental", f"""
SELECT claim_id, worker_id IS NOT NULL AS worker_known, {sql_date_key("created_at")} AS date_key, amount AS claim_amount, fraud_score,
 status AS claim_status, trigger_type, coalesce(nullif(trust_score, 0), 50) AS trust_score_at_claim, photo_submitted FROM claims LEFT JOIN workers USING (worker_id)
""")
def e6(t):
    house, _ = _two_runs(t, "e6")
    return house.claims.read().select(
        "claim_id", (F.col("worker_key") != wh.UNKNOWN).alias("worker_known"), "date_key", "claim_amount", "fraud_score",
        "claim_status", "trigger_type", "trust_score_at_claim", "photo_submitted")


@query("e7_fact_payouts_incremental", f"""
WITH first_req AS (SELECT *, row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT p.claim_sk, c.claim_id, {sql_date_key("requested_at")} AS date_key, p.amount, p.mode AS gateway_mode, 'completed' AS status
FROM first_req p LEFT JOIN claims c USING (claim_sk) WHERE rn = 1
""")
def e7(t):
    house, _ = _two_runs(t, "e7")
    return house.payouts.read().select("claim_sk", "claim_id", "date_key", "amount", "gateway_mode", "status")


def _house_with(t, name, runs):
    house = _house(t, name)
    for claims, workers, payouts in runs:
        run_full_etl(house, claims, workers, payouts, FIRST)
    return house


@query("e6_status_change", f"""
SELECT claim_id, coalesce(nullif(trust_score, 0), 50) AS trust_score_at_claim, amount AS claim_amount, 'reopened' AS claim_status
FROM claims LEFT JOIN workers USING (worker_id)
""")
def e6_status_change(t):
    """Every claim changes its status and every worker their score between two loads; what held at the claim stays."""
    payouts = _payouts(t)
    later = t.claims.withColumns({"status": F.lit("reopened"), "amount": F.col("amount") + 1,
                                  "updated_at": F.expr("updated_at + interval 10 years")})
    scored = t.workers.withColumn("trust_score", F.lit(1.0))
    house = _house_with(t, "status-change", [(t.claims, t.workers, payouts), (later, scored, payouts)])
    return house.claims.read().select("claim_id", "trust_score_at_claim", "claim_amount", "claim_status")


@query("e7_late_payouts", f"""
WITH first_req AS (SELECT *, row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT claim_sk, {sql_date_key("requested_at")} AS date_key, amount FROM first_req WHERE rn = 1
""")
def e7_late_payouts(t):
    """All claims are loaded before any payout lands; no payout is lost."""
    payouts = _payouts(t)
    house = _house_with(t, "late-payouts", [(t.claims, t.workers, payouts.limit(0)), (t.claims, t.workers, payouts)])
    return house.payouts.read().select("claim_sk", "date_key", "amount")


@query("e6_late_scores", f"""
SELECT claim_id, coalesce(nullif(trust_score, 0), 50) AS trust_score_at_claim, amount AS claim_amount,
 CASE WHEN claim_sk % 3 = 0 THEN fraud_score ELSE (claim_sk % 50)::INT END AS fraud_score,
 CASE WHEN claim_sk % 3 <> 0 THEN (claim_sk % 7)::DOUBLE END AS layer1_score, CASE WHEN claim_sk % 3 <> 0 THEN 'VERIFIED' END AS vision_verdict,
 status AS claim_status FROM claims LEFT JOIN workers USING (worker_id)
""")
def e6_late_scores(t):
    """Scores come after the claim: two loads later for two claims in three; a still later change without scores takes none away."""
    payouts = _payouts(t)
    scored = F.col("claim_sk") % 3 != 0
    later = t.claims.withColumns({
        "fraud_score": F.when(scored, (F.col("claim_sk") % 50).cast("int")), "layer1_score": F.when(scored, (F.col("claim_sk") % 7).cast("double")),
        "vision_verdict": F.when(scored, "VERIFIED"), "amount": F.col("amount") + 1, "updated_at": F.expr("updated_at + interval 10 years")})
    silent = t.claims.withColumns({"fraud_score": F.lit(None).cast("int"), "updated_at": F.expr("updated_at + interval 20 years")})
    house = _house_with(t, "late-scores", [(rows, t.workers, payouts) for rows in (t.claims, later, silent)])
    return house.claims.read().select("claim_id", "trust_score_at_claim", "claim_amount", "fraud_score", "layer1_score", "vision_verdict", "claim_status")


def _arrivals(t, name):
    """Claims in three versions' order of landing, requests of every seventh claim 400 days late; one load per slice."""
    house, root = _house(t, name), scratch_path(t.spark, f"{name}-landed")
    lag = F.expr("CASE WHEN claim_sk % 7 = 0 THEN interval 400 days ELSE interval 0 days END")
    sides = {"claims": t.claims.withColumn("landed_at", F.col("updated_at")),
             "requests": t.payout_requests.withColumn("landed_at", F.col("requested_at") + lag)}
    streams = {}
    for side, rows in sides.items():
        rows.limit(0).write.parquet(f"{root}/{side}")
        streams[side] = t.spark.readStream.schema(rows.schema).parquet(f"{root}/{side}").drop("landed_at")
    for low, high in (("1900-01-01", "1997-03-01"), ("1997-03-01", "1999-06-01"), ("1999-06-01", "2100-01-01")):
        between = (F.col("landed_at") > F.lit(low).cast("timestamp_ntz")) & (F.col("landed_at") <= F.lit(high).cast("timestamp_ntz"))
        for side, rows in sides.items():
            rows.where(between).write.mode("append").parquet(f"{root}/{side}")
        with state_partitions(t.spark, *sides.values()):
            load_arrivals(house, streams["claims"], t.workers, streams["requests"], f"{root}/checkpoint")
    return house


@query("e7_late_arrival", ORACLES["e7_fact_payouts_incremental"])
def e7_late_arrival(t):
    """Payouts requested before, landed after ones that are loaded already."""
    return _arrivals(t, "arrivals").payouts.read().select("claim_sk", "claim_id", "date_key", "amount", "gateway_mode", "status")


@query("v_rollups_by_arrival", f"""
SELECT 'city' AS view, pincode AS key, total_claims AS n, total_payout_inr AS amount, approval_rate_pct AS rate FROM ({ORACLES["v1_claims_by_city"]}) a
UNION ALL SELECT 'month', (year * 100 + month)::VARCHAR, payout_count, total_payout_inr, min_payout_inr + max_payout_inr FROM ({ORACLES["v2_monthly_payouts"]}) b
UNION ALL SELECT 'disruption', trigger_type, total_claims, max_fraud_score + avg_fraud_score, fraud_rate_pct FROM ({ORACLES["v3_fraud_by_disruption"]}) c
UNION ALL SELECT 'segment', risk_segment || plan, worker_count, avg_claim_amount + avg_fraud_score, approved_claims - rejected_claims FROM ({ORACLES["v4_worker_risk_segments"]}) d
""")
def v_by_arrival(t):
    """The four rollups after three loads, from the sums kept by period."""
    views = _arrivals(t, "rollups").views()
    columns = {"city": ("pincode", "total_claims", "total_payout_inr", "approval_rate_pct"),
               "month": ("cast(year * 100 + month as string)", "payout_count", "total_payout_inr", "min_payout_inr + max_payout_inr"),
               "disruption": ("trigger_type", "total_claims", "max_fraud_score + avg_fraud_score", "fraud_rate_pct"),
               "segment": ("concat(risk_segment, plan)", "worker_count", "avg_claim_amount + avg_fraud_score", "cast(approved_claims - rejected_claims as double)")}
    parts = [views[v].selectExpr(f"'{v}' AS view", *[f"{e} AS {n}" for e, n in zip(es, ("key", "n", "amount", "rate"))]) for v, es in columns.items()]
    return reduce(DataFrame.unionByName, parts)


@query("e8_checkpoint", """
SELECT 'full_etl' AS job_name, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_watermark, 'success' AS status FROM claims
""")
def e8(t):
    house, _ = _two_runs(t, "e8")
    return house.checkpoints.read().where("job_name = 'full_etl'").select(
        "job_name", F.date_format("last_watermark", "yyyy-MM-dd HH:mm:ss").alias("last_watermark"), "status")


RUNS_SQL = f"""
WITH first_req AS (SELECT *, row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests),
 paid AS (SELECT * FROM first_req WHERE rn = 1), wm AS (SELECT max(updated_at) AS w1, (SELECT max(requested_at) FROM paid WHERE requested_at <= TIMESTAMP '{CUT}') AS p1 FROM claims WHERE updated_at <= TIMESTAMP '{CUT}'),
 wm2 AS (SELECT max(updated_at) AS w2, (SELECT max(requested_at) FROM paid) AS p2 FROM claims), f AS (SELECT TIMESTAMP '1995-01-15' - INTERVAL 30 DAYS AS w0),
 runs AS (SELECT 0 AS run, w0 AS since, w1 AS until, w0 AS paid_since, TIMESTAMP '{CUT}' AS cap FROM f, wm UNION ALL SELECT 1, w1, w2, p1, TIMESTAMP '2100-01-01' FROM wm, wm2
  UNION ALL SELECT 2, w2, w2, p2, TIMESTAMP '2100-01-01' FROM wm2)
SELECT CAST(run AS BIGINT) AS run, strftime(since, '%Y-%m-%d %H:%M:%S') AS watermark_from, strftime(until, '%Y-%m-%d %H:%M:%S') AS watermark_to,
 (SELECT count(*) FROM claims WHERE updated_at >= since - INTERVAL 300 SECONDS AND updated_at <= cap)
 + (SELECT count(*) FROM paid WHERE requested_at >= paid_since - INTERVAL 300 SECONDS AND requested_at <= cap) AS rows_loaded, 'success' AS status FROM runs
"""


def _summaries(t, user):
    _, runs = _two_runs(t, user)
    return t.spark.createDataFrame(
        [(i, f"{r.watermark_from:%Y-%m-%d %H:%M:%S}", f"{r.watermark_to:%Y-%m-%d %H:%M:%S}", r.rows_loaded, r.status)
         for i, r in enumerate(runs)],
        "run bigint, watermark_from string, watermark_to string, rows_loaded bigint, status string")


@query("e9_full_etl_runs", RUNS_SQL)
def e9(t):
    return _summaries(t, "e9")


@query("g19_run_summary", f"SELECT status, count(*) AS runs, CAST(sum(rows_loaded) AS BIGINT) AS rows_loaded FROM ({RUNS_SQL}) q GROUP BY 1")
def g19(t):
    return _summaries(t, "g19").groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows_loaded").alias("rows_loaded"))


@query("e6_trigger_event_fact", f"""
WITH {fired_sql("readings")}
SELECT CAST(f.reading_id AS VARCHAR) || '-' || f.trigger_type AS trigger_id, {sql_date_key("f.ts")} AS date_key, count(w.worker_id) AS claims_count, coalesce(sum({AMOUNT_SQL}), 0) AS payout_total
FROM fired f LEFT JOIN workers w ON f.pincode = w.pincode GROUP BY 1, 2
""")
def e6b(t):
    house = _house(t, "trigger-facts")
    events = triggers.trigger_events(fired_rows(t), t.workers)
    for _ in range(2):  # a repeat leaves the table as it is
        house.load_trigger_events(events)
    return house.trigger_events.read().select("trigger_id", "date_key", "claims_count", "payout_total")


@query("q1_data_quality", """
SELECT 'worker name unique' AS rule, count(*) AS violations FROM (SELECT worker_name FROM workers GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'one policy per worker', count(*) FROM (SELECT worker_name FROM policies GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'claim id unique', count(*) FROM (SELECT claim_id FROM claims GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'one payout per claim', count(*) FROM (SELECT claim_sk FROM payout_requests GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'outbox event unique', count(*) FROM (SELECT event_id FROM outbox GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'event handled once', count(*) FROM (SELECT event_id FROM event_log GROUP BY 1 HAVING count(*) > 1) q
UNION ALL SELECT 'event fields present', count(*) FROM event_log WHERE event_id IS NULL OR event_type IS NULL OR event_ts IS NULL OR props IS NULL
UNION ALL SELECT 'claim id format', count(*) FROM claims WHERE NOT regexp_full_match(claim_id, 'CLM-[0-9]{8}-[A-Z0-9]{4,}')
UNION ALL SELECT 'fraud score in range', count(*) FROM claims WHERE NOT fraud_score BETWEEN 0 AND 100
UNION ALL SELECT 'trust score in range', count(*) FROM workers WHERE trust_score IS NULL OR NOT trust_score BETWEEN 0 AND 100
UNION ALL SELECT 'worker key collisions', 0
""")
def q1(t):
    return quality.report(
        quality.unique("worker name unique", t.workers, "worker_name"),
        quality.unique("one policy per worker", t.policies, "worker_name"),
        quality.unique("claim id unique", t.claims, "claim_id"),
        quality.unique("one payout per claim", t.payout_requests, "claim_sk"),
        quality.unique("outbox event unique", t.outbox, "event_id"),
        quality.unique("event handled once", t.event_log, "event_id"),
        quality.holds("event fields present", t.event_log, F.expr(
            "event_id is not null and event_type is not null and event_ts is not null and props is not null")),
        quality.holds("claim id format", t.claims, F.col("claim_id").rlike(quality.CLAIM_ID_PATTERN)),
        quality.holds("fraud score in range", t.claims, F.col("fraud_score").between(0, 100)),
        quality.holds("trust score in range", t.workers, F.col("trust_score").between(0, 100)),
        quality.no_collisions("worker key collisions", wh.dim_worker(t.workers), "worker_key", "worker_id"))
