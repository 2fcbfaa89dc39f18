"""Operators the domain's documents describe."""

from pyspark.sql import functions as F

from parasol.operators import extensions as ext
from parasol.operators import fraud, matching
from parasol.plans.fraud_queries import LAYERS_SQL, assembled
from parasol.plans.registry import query, sql_round
from parasol.plans.signal_queries import fired_rows, fired_sql

SUSTAINED_SQL = """
SELECT pincode, '{kind}' AS kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS readings
FROM (SELECT *, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY pincode ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS grp FROM readings) q
WHERE {cond} GROUP BY pincode, grp HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 >= {minutes}
"""


@query("d1_sustained_triggers", SUSTAINED_SQL.format(kind="rain", cond="rain_mm_hr > 7.5", minutes=45) + " UNION ALL "
       + SUSTAINED_SQL.format(kind="aqi", cond="aqi > 200", minutes=180))
def d1(t):
    def runs(kind, qualifies, minutes):
        return ext.sustained(t.readings, qualifies, minutes).select(
            "pincode", F.lit(kind).alias("kind"), F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
            F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "readings")
    return runs("rain", F.col("rain_mm_hr") > 7.5, 45).unionByName(runs("aqi", F.col("aqi") > 200, 180))


@query("d2_earning_profile", f"""
SELECT user_id AS worker_id, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS samples,
 {sql_round("CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*)", 2)} AS avg_earning
FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 56 DAYS AND ts <= TIMESTAMP '2024-02-01' GROUP BY 1, 2, 3
""")
def d2(t):
    earnings = t.events.select(F.col("user_id").alias("worker_id"), "ts", "value")
    return ext.earning_profile(earnings, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("d3_platform_outages", """
WITH c AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6 / 1800) AS BIGINT) * 1800 AS bucket, count(*) AS orders FROM events GROUP BY 1, 2),
 g AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, 1800)) AS bucket FROM c GROUP BY 1),
 f AS (SELECT g.event_type, g.bucket, coalesce(c.orders, 0) AS orders FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.bucket = g.bucket),
 j AS (SELECT *, sum(orders) OVER w AS usual, count(orders) OVER w AS n FROM f WINDOW w AS (PARTITION BY event_type, bucket % 86400 ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, n = 7 AND orders * 7 < usual * (1 - 0.6::DOUBLE) AS low FROM j)
SELECT event_type, bucket, CAST(orders AS BIGINT) AS orders, low, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER
 (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS outage FROM l
""")
def d3(t):
    return ext.outages(t.events, "event_type", "ts").select("event_type", "bucket", "orders", F.coalesce("low", F.lit(False)).alias("low"), "outage")


@query("d4_claim_clustering", """
SELECT event_id, count(*) OVER (PARTITION BY pincode ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS in_window,
 count(*) OVER (PARTITION BY pincode ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) >= 20 AS clustered FROM zone_claims
""")
def d4(t):
    return ext.clustered(t.zone_claims, "pincode", "ts", "event_id")


@query("d5_registration_spikes", """
WITH r AS (SELECT w.pincode, c.worker_id, CAST(min(created_at) AS DATE) AS day FROM claims c JOIN workers w USING (worker_id) GROUP BY 1, 2),
 d AS (SELECT pincode, day, count(*) AS registered FROM r GROUP BY 1, 2)
SELECT pincode, strftime(day, '%Y-%m-%d') AS day, registered, CAST(sum(registered) OVER (PARTITION BY pincode ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS registered_14d FROM d
""")
def d5(t):
    first = t.claims_with_zone.where("pincode is not null").groupBy("pincode", "worker_id").agg(
        F.to_date(F.min("created_at")).alias("day"))
    return ext.registration_spikes(first).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


N_FLAGS = "CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, '|')) END"
LANE_SQL = f"""
ln AS (SELECT *, CASE WHEN coalesce(nullif(trust_score, 0), 50) >= 75 AND account_age_days > 60 AND {N_FLAGS} = 0 THEN 'green' WHEN {N_FLAGS} BETWEEN 1 AND 2 THEN 'yellow' ELSE 'red' END AS lane FROM lay)
"""


@query("d6_zone_consensus", f"""
WITH {LAYERS_SQL}, {LANE_SQL}, pw AS (SELECT pincode, CAST(created_at AS DATE) AS day, worker_id, max(CASE WHEN flags = '' THEN 1 ELSE 0 END) AS own FROM ln GROUP BY 1, 2, 3),
 pz AS (SELECT pincode, day, sum(own) AS total FROM pw GROUP BY 1, 2)
SELECT claim_sk, CAST(total - own AS BIGINT) AS clean_neighbours, CASE WHEN lane = 'red' AND total - own >= 40 THEN 'yellow' ELSE lane END AS lane
FROM ln JOIN pw ON pw.pincode = ln.pincode AND pw.worker_id = ln.worker_id AND pw.day = CAST(ln.created_at AS DATE) JOIN pz ON pz.pincode = ln.pincode AND pz.day = pw.day
""")
def d6(t):
    scored = fraud.score_claims(assembled(t)).select(
        "claim_sk", "worker_id", "pincode", "created_at", F.size("flags").alias("n_flags"), ext.lane().alias("strict"))
    found = ext.zone_consensus(scored, n_flags="n_flags")
    return found.select("claim_sk", "clean_neighbours", ext.softened("strict", "consensus").alias("lane"))


@query("d7_fraud_lanes", f"WITH {LAYERS_SQL}, {LANE_SQL} SELECT claim_sk, lane FROM ln")
def d7(t):
    return fraud.score_claims(assembled(t)).select("claim_sk", ext.lane().alias("lane"))


@query("d8_flood_cap_boost", f"""
WITH {fired_sql("past_readings")}, al AS (SELECT DISTINCT pincode, CAST(ts AS DATE) AS day FROM fired WHERE trigger_type IN ('heavy_rain', 'waterlogging'))
SELECT claim_sk, w.plan, CASE WHEN al.day IS NOT NULL AND w.plan IN ('plus', 'pro') THEN weekly_cap * 1.5::DOUBLE ELSE weekly_cap::DOUBLE END AS cap
FROM claims c JOIN workers w USING (worker_id) JOIN plans p ON p.plan = w.plan LEFT JOIN al ON al.pincode = w.pincode AND al.day = CAST(c.created_at AS DATE)
""")
def d8(t):
    planned = t.claims.join(t.workers.select("worker_id", "pincode", "plan"), "worker_id")
    return ext.boosted_cap(planned, t.plans, fired_rows(t, "past_readings")).select("claim_sk", "plan", "cap")


@query("d9_exclusions", f"""
WITH {fired_sql("past_readings")}, hits AS (SELECT DISTINCT pincode, ts FROM fired)
SELECT claim_sk, CASE WHEN policy_paused THEN 'policy paused' WHEN h.ts IS NULL OR epoch_us(created_at) - epoch_us(h.ts) > 21600000000 THEN 'filed late or no event' END AS excluded
FROM (SELECT c.claim_sk, c.created_at, w.pincode, w.policy_paused FROM claims c JOIN workers w USING (worker_id)) k ASOF LEFT JOIN hits h ON h.pincode = k.pincode AND k.created_at >= h.ts
""")
def d9(t):
    rows = t.claims.join(t.workers.select("worker_id", "pincode", "policy_paused"), "worker_id")
    found = matching.disruption_before(rows, fired_rows(t, "past_readings"))
    return found.select("claim_sk", ext.exclusion("known_at", "policy_paused").alias("excluded"))


@query("d10_device_rings", """
WITH RECURSIVE e AS (SELECT DISTINCT a.worker_id AS x, b.worker_id AS y FROM claims a JOIN claims b ON a.device_id = b.device_id),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS worker_id, min(y) AS ring FROM r GROUP BY 1)
SELECT worker_id, ring, count(*) OVER (PARTITION BY ring) AS ring_size, count(*) OVER (PARTITION BY ring) = 1 AS isolated FROM c
""")
def d10(t):
    return ext.device_rings(t.claims).select("worker_id", "ring", "ring_size", (F.col("ring_size") == 1).alias("isolated"))
