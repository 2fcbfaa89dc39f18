"""Joins and history signals."""

from pyspark.sql import functions as F

from parasol.functions.numeric import round_even, round_to, truthy_or
from parasol.operators import matching, signals, triggers
from parasol.operators.scoring import with_zone_profile
from parasol.plans.registry import query, sql_haversine, sql_round

FIRED_SQL = """
fired AS (SELECT r.reading_id, r.pincode, r.ts, r.rain_mm_hr, r.duration_min, r.aqi, t.trigger_type
 FROM (SELECT q.*, coalesce(z.waterlogging_score, 0.35) AS wl FROM {source} q LEFT JOIN zone_risk z USING (pincode)) r,
 (VALUES ('heavy_rain'), ('aqi_spike'), ('waterlogging'), ('cyclone_wind'), ('strike_curfew')) t(trigger_type)
 WHERE CASE t.trigger_type WHEN 'heavy_rain' THEN rain_mm_hr > 7.5 AND duration_min > 45 WHEN 'aqi_spike' THEN aqi > 150
  WHEN 'waterlogging' THEN wl > 0.65 AND rain_mm_hr > 6 AND NOT (rain_mm_hr > 7.5 AND duration_min > 45)
  WHEN 'cyclone_wind' THEN wind_kmh > 60 OR gust_kmh > 80 ELSE curfew_active END)
"""


def fired_sql(source: str) -> str:
    return FIRED_SQL.replace("{source}", source)


def fired_rows(t, source: str = "readings"):
    return triggers.fired(triggers.evaluate(with_zone_profile(getattr(t, source), t.zone_risk)))


@query("j1_enrich_with_worker", """
SELECT claim_sk, coalesce(plan, 'plus') AS plan, trust_score, coalesce(avg_daily_earning, 600) AS avg_daily_earning
FROM claims LEFT JOIN workers USING (worker_id)
""")
def j1(t):
    return matching.enrich_with_worker(t.claims, t.workers).select("claim_sk", "plan", "trust_score", "avg_daily_earning")


@query("j2_worker_lookup_per_event", """
SELECT event_id, strftime(arrival_ts, '%Y-%m-%d %H:%M:%S') AS arrived, worker_name,
 CASE WHEN worker_name IS NULL THEN 'worker ' || CAST(user_id * 20 AS VARCHAR) || ' not found' END AS error
FROM event_log LEFT JOIN workers ON user_id * 20 = worker_id
""")
def j2(t):
    # Every twentieth worker id, so that some events name a worker nobody knows.
    events = t.event_log.withColumn("worker_id", F.col("user_id") * 20)
    return matching.split_known(events, t.workers).select(
        "event_id", F.date_format("arrival_ts", "yyyy-MM-dd HH:mm:ss").alias("arrived"), "worker_name", "error")


@query("j3_eligible_workers", """
SELECT reading_id, count(*) AS eligible FROM readings r JOIN workers w ON r.pincode = w.pincode GROUP BY 1
""")
def j3(t):
    return matching.eligible_workers(t.readings, t.workers).select("reading_id", "eligible")


@query("j4_zone_profile_or_default", """
SELECT worker_id, coalesce(flood_frequency, 0.40) AS flood_frequency, coalesce(avg_rainfall_mm, 900) AS avg_rainfall_mm,
 coalesce(aqi_annual_avg, 120) AS aqi_annual_avg, coalesce(waterlogging_score, 0.35) AS waterlogging_score,
 coalesce(disruption_days_per_year, 18) AS disruption_days_per_year
FROM workers LEFT JOIN zone_risk USING (pincode)
""")
def j4(t):
    return with_zone_profile(t.workers, t.zone_risk).select(
        "worker_id", "flood_frequency", "avg_rainfall_mm", "aqi_annual_avg", "waterlogging_score", "disruption_days_per_year")


@query("j8_unprocessed_events", """
SELECT event_id, event_type, strftime(arrival_ts, '%Y-%m-%d %H:%M:%S') AS arrived FROM event_log
WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))
""")
def j8(t):
    consumer = F.when(F.col("event_type") == "error", "payout-processor").otherwise("fraud-processor")
    processed = t.events.where("event_type in ('click', 'view', 'error')").select(
        "event_id", consumer.alias("consumer_name"))
    return matching.unprocessed(t.event_log, processed, "fraud-processor").select(
        "event_id", "event_type", F.date_format("arrival_ts", "yyyy-MM-dd HH:mm:ss").alias("arrived"))


@query("j9_valid_by_trigger", f"""
WITH {fired_sql("past_readings")}
SELECT claim_sk, trigger_type FROM claims c JOIN workers w USING (worker_id)
WHERE trigger_type = 'manual' OR EXISTS (SELECT 1 FROM fired f WHERE f.pincode = w.pincode
 AND f.trigger_type = c.trigger_type AND CAST(f.ts AS DATE) = CAST(c.created_at AS DATE))
""")
def j9(t):
    return matching.valid_by_trigger(t.claims_with_zone, fired_rows(t, "past_readings")).select("claim_sk", "trigger_type")


DAILY_SQL = """
daily AS (SELECT pincode, CAST(ts AS DATE) AS day, rain_mm_hr FROM (SELECT *, row_number() OVER
 (PARTITION BY pincode, CAST(ts AS DATE) ORDER BY ts DESC, reading_id DESC) AS rn FROM past_readings) q WHERE rn = 1)
"""


@query("j10_weather_cross_check", f"""
WITH {DAILY_SQL}
SELECT claim_sk, d.rain_mm_hr, d.rain_mm_hr > 2 AS had_rain,
 coalesce(trigger_type = 'heavy_rain' AND NOT (d.rain_mm_hr > 2), false) AS weather_mismatch
FROM claims c JOIN workers w USING (worker_id) LEFT JOIN daily d ON d.pincode = w.pincode AND d.day = CAST(c.created_at AS DATE)
""")
def j10(t):
    checked = matching.with_weather(t.claims_with_zone, matching.daily_weather(t.past_readings))
    return checked.select("claim_sk", "rain_mm_hr", "had_rain", F.coalesce(
        (F.col("trigger_type") == "heavy_rain") & ~F.col("had_rain"), F.lit(False)).alias("weather_mismatch"))


def snapshots(t):
    """Zone snapshots: the readings that came with a 'view' event."""
    views = t.events.where("event_type = 'view'").select(F.col("event_id").alias("reading_id"))
    return t.readings.join(views, "reading_id").select(
        "pincode", "ts", F.col("reading_id").alias("snapshot_id"), F.col("rain_mm_hr").alias("snap_rain"))


ASOF_SQL = """
WITH snaps AS (SELECT r.pincode, r.ts, r.reading_id AS snapshot_id, r.rain_mm_hr AS snap_rain FROM readings r
 JOIN events e ON e.event_id = r.reading_id AND e.event_type = 'view')
SELECT r.reading_id, CASE WHEN epoch_us(r.ts) - epoch_us(s.ts) < {ttl} THEN s.snapshot_id END AS snapshot_id,
 CASE WHEN epoch_us(r.ts) - epoch_us(s.ts) < {ttl} THEN s.snap_rain END AS snap_rain
FROM readings r ASOF LEFT JOIN snaps s ON r.pincode = s.pincode AND r.ts >= s.ts
"""


@query("j11_latest_zone_snapshot", ASOF_SQL.replace("{ttl}", "86400000000"))
def j11(t):
    return matching.with_zone_snapshot(
        t.readings.select("reading_id", "pincode", "ts"), snapshots(t), ["snapshot_id", "snap_rain"], 86400,
        "snapshot_id").select("reading_id", "snapshot_id", "snap_rain")


@query("j12_photo_distance", f"""
SELECT p.claim_sk, {sql_round(sql_haversine("z.lat", "z.lon", "p.gps_lat", "p.gps_lon"), 3)} AS photo_km,
 coalesce({sql_haversine("z.lat", "z.lon", "p.gps_lat", "p.gps_lon")} > 25, false) AS far_away
FROM claims c JOIN claim_photos p USING (claim_sk) JOIN workers w USING (worker_id) LEFT JOIN zone_coords z ON z.pincode = w.pincode
""")
def j12(t):
    return matching.photo_distance(t.claims_with_zone, t.claim_photos, t.zone_coords).select(
        "claim_sk", round_to("photo_km", 3).alias("photo_km"),
        F.coalesce(F.col("photo_km") > matching.PHOTO_MAX_KM, F.lit(False)).alias("far_away"))


DEVICE_SQL = """
SELECT claim_sk, CAST(count(DISTINCT worker_id) OVER (PARTITION BY device_id ORDER BY created_at, claim_sk
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - CASE WHEN count(*) OVER (PARTITION BY device_id, worker_id
  ORDER BY created_at, claim_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS BIGINT) AS others
FROM claims
"""


@query("j13_shared_device", f"SELECT claim_sk, others > 0 AS shared_device FROM ({DEVICE_SQL}) q")
def j13(t):
    seen = signals.others_on_device(t.claims, "device_id", "worker_id", "created_at", "claim_sk")
    return seen.select("claim_sk", (F.col("others") > 0).alias("shared_device"))


@query("j14_claims_of_a_disruption", f"""
WITH {fired_sql("past_readings")}, hits AS (SELECT DISTINCT pincode, ts FROM fired)
SELECT claim_sk, strftime(CASE WHEN epoch_us(created_at) - epoch_us(h.ts) <= 21600000000 THEN h.ts END, '%Y-%m-%d %H:%M:%S') AS disrupted_at
FROM (SELECT c.claim_sk, c.created_at, w.pincode FROM claims c JOIN workers w USING (worker_id)) k
ASOF LEFT JOIN hits h ON h.pincode = k.pincode AND k.created_at >= h.ts
""")
def j14(t):
    found = matching.disruption_before(t.claims_with_zone.where("pincode is not null"), fired_rows(t, "past_readings"))
    at = F.timestamp_micros("known_at").cast("timestamp_ntz")
    return found.select("claim_sk", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("disrupted_at"))


@query("w1_zone_burst", """
SELECT event_id, count(*) OVER (PARTITION BY pincode ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS prior_hour,
 count(*) OVER (PARTITION BY pincode ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 > 8 AS burst
FROM zone_claims
""")
def w1(t):
    counts = signals.zone_burst(t.zone_claims, "pincode", "ts", "event_id")
    return counts.select("event_id", "prior_hour", (F.col("prior_hour") > signals.BURST_CLAIMS).alias("burst"))


@query("w2_multi_zone", """
SELECT event_id, zones_before, zones_before > 3 AS multi_zone FROM (SELECT event_id, count(DISTINCT pincode) OVER
 (PARTITION BY worker_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS zones_before FROM zone_visits) q
""")
def w2(t):
    z = signals.zones_before(t.zone_visits, "worker_id", "pincode", "ts", "event_id")
    return z.select("event_id", "zones_before", (F.col("zones_before") > signals.MULTI_ZONES).alias("multi_zone"))


@query("w3_others_on_device", DEVICE_SQL)
def w3(t):
    return signals.others_on_device(t.claims, "device_id", "worker_id", "created_at", "claim_sk")


HOPS_SQL = f"""
hops AS (SELECT trace_id, ping_id, lat, lon, plat, km, minutes, km / (minutes / 60) AS kmh FROM (
 SELECT trace_id, ping_id, lat, lon, plat, {sql_haversine("plat", "plon", "lat", "lon")} AS km,
  CASE WHEN pat IS NULL THEN NULL ELSE greatest((epoch_us(ts) - pat) / 60e6, 0.1::DOUBLE) END AS minutes
 FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(epoch_us(ts)) OVER w AS pat FROM gps_pings
  WINDOW w AS (PARTITION BY trace_id ORDER BY ts, ping_id)) a) b)
"""


@query("w4_gps_hops", f"""
WITH {HOPS_SQL}
SELECT ping_id, {sql_round("km", 3)} AS km, {sql_round("minutes", 3)} AS minutes, {sql_round("kmh", 1)} AS kmh,
 coalesce(km > 50 AND minutes < 10, false) AS jump, coalesce(kmh > 80, false) AS too_fast FROM hops
""")
def w4(t):
    return signals.gps_hops(t.gps_pings).select(
        "ping_id", round_to("km", 3).alias("km"), round_to("minutes", 3).alias("minutes"),
        round_to("kmh", 1).alias("kmh"), "jump", "too_fast")


@query("w5_trace_verdict", f"""
WITH {HOPS_SQL}, per AS (SELECT trace_id, count(*) AS points, CAST(sum(CASE WHEN km > 50 AND minutes < 10 THEN 1 ELSE 0 END) AS BIGINT)
  + CAST(sum(CASE WHEN kmh > 80 THEN 1 ELSE 0 END) AS BIGINT) + CASE WHEN count(DISTINCT round(lat, 4)) = 1 THEN 1 ELSE 0 END AS n,
  count(DISTINCT round(lat, 4)) = 1 AS static FROM hops GROUP BY 1)
SELECT trace_id, points, points >= 2 AND static AS static, CASE WHEN points < 2 THEN 0 ELSE n END AS n_flags,
 {sql_round("least(CASE WHEN points < 2 THEN 0 ELSE n END * 0.35::DOUBLE, 1::DOUBLE)", 2)} AS confidence,
 points >= 2 AND n > 0 AS spoofed, points < 2 AS insufficient FROM per
""")
def w5(t):
    return signals.trace_verdict(signals.gps_hops(t.gps_pings))


@query("w6_recent_claims", """
SELECT worker_id, claim_sk, rn FROM (SELECT worker_id, claim_sk, CAST(row_number() OVER
 (PARTITION BY worker_id ORDER BY created_at DESC, claim_sk DESC) AS INT) AS rn FROM claims) q WHERE rn <= 5
""")
def w6(t):
    return signals.recent_claims(t.claims).select("worker_id", "claim_sk", "rn")


BEFORE_SQL = """
SELECT *, CAST(coalesce(sum(CASE WHEN status LIKE 'rejected%' THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id
 ORDER BY created_at, claim_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS false_before FROM claims
"""


@query("w7_false_claim_escalation", f"""
WITH nth AS (SELECT q.*, CASE WHEN false_before >= 2 THEN 15 WHEN false_before = 1 THEN 10 ELSE 8 END AS penalty
  FROM ({BEFORE_SQL}) q WHERE status LIKE 'rejected%'),
 run AS (SELECT nth.*, greatest(10::DOUBLE, coalesce(nullif(trust_score, 0), 50) - sum(penalty) OVER (PARTITION BY nth.worker_id
  ORDER BY created_at, claim_sk ROWS UNBOUNDED PRECEDING)) AS score_after FROM nth JOIN workers USING (worker_id))
SELECT claim_sk, false_before + 1 AS nth, penalty, score_after, CASE WHEN score_after >= 85 THEN 'A+' WHEN score_after >= 75 THEN 'A'
 WHEN score_after >= 62 THEN 'B+' WHEN score_after >= 50 THEN 'B' WHEN score_after >= 35 THEN 'C' ELSE 'D' END AS grade_after FROM run
""")
def w7(t):
    rejected = signals.earlier_rejections(t.claims).where("status like 'rejected%'")
    scored = rejected.join(t.workers.select("worker_id", "trust_score"), "worker_id")
    return signals.escalation(scored, truthy_or("trust_score", 50.0)).select(
        "claim_sk", "nth", "penalty", "score_after", "grade_after")


@query("w8_repeat_reduction", f"""
SELECT claim_sk, false_before, CASE WHEN false_before >= 3 THEN 0.50 WHEN false_before = 2 THEN 0.70 WHEN false_before = 1 THEN 0.85
 ELSE 1.0 END::DOUBLE AS factor, round_even(amount * CASE WHEN false_before >= 3 THEN 0.50 WHEN false_before = 2 THEN 0.70
 WHEN false_before = 1 THEN 0.85 ELSE 1.0 END::DOUBLE, 0) AS paid FROM ({BEFORE_SQL}) q
""")
def w8(t):
    factor = signals.repeat_payout_factor("false_before")
    return signals.earlier_rejections(t.claims).select(
        "claim_sk", "false_before", factor.alias("factor"), round_even(F.col("amount") * factor).alias("paid"))


@query("w9_rolling_approved", """
SELECT worker_id, claim_sk, sum(CASE WHEN status = 'approved' THEN amount ELSE 0 END) OVER (PARTITION BY worker_id
 ORDER BY created_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS approved_7d FROM claims
""")
def w9(t):
    return signals.rolling_approved(t.claims)
