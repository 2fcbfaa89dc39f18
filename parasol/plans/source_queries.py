"""Files and landed feeds."""

from pyspark.sql import functions as F

from parasol.operators import documents as docs, pricing
from parasol.plans.document_queries import FLAT_SQL
from parasol.plans.pricing_queries import TRAIN_SQL
from parasol.plans.registry import query, sql_round
from parasol.session import scratch_path
from parasol.sources import feeds, files
from parasol.sources.views import Tables


@query("s1_state_snapshot", """
SELECT 'workers' AS kind, worker_name AS key, pincode AS detail FROM workers
UNION ALL SELECT 'policies', worker_name, plan FROM policies UNION ALL SELECT 'claims', claim_id, status FROM claims
""")
def s1(t: Tables):
    path = scratch_path(t.spark, "state")
    files.write_state(t.workers, t.policies, t.claims, path)
    state = files.read_state(t.spark, path)
    return (state["workers"].select(F.lit("workers").alias("kind"), F.col("name").alias("key"), F.col("pincode").alias("detail"))
            .unionAll(state["policies"].select(F.lit("policies"), "user", "plan"))
            .unionAll(state["claims"].select(F.lit("claims"), "claim_id", "status")))


@query("s2_snapshot_round_trip", "SELECT claim_sk, claim_id, amount, status FROM claims")
def s2(t: Tables):
    path = scratch_path(t.spark, "snapshot")
    files.write_tables({"claims": t.claims, "workers": t.workers}, path)
    return files.read_table(t.spark, path, "claims").select("claim_sk", "claim_id", "amount", "status")


@query("s3_collection_scan", """
SELECT worker_name, pincode, city, plan, pan_number, pan_verified, policy_paused, avg_daily_earning, trust_score FROM workers
""")
def s3(t: Tables):
    return t.workers.select("worker_name", "pincode", "city", "plan", "pan_number", "pan_verified", "policy_paused",
                            "avg_daily_earning", "trust_score")


@query("s4_seed_load", """
SELECT 'CLM-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(claim_sk AS VARCHAR), 8, '0') AS claim_id, worker_name, coalesce(pincode, '') AS pincode,
 amount, trigger_type, status, fraud_score AS score, CASE WHEN fraud_score < 25 THEN 'LOW' WHEN fraud_score < 50 THEN 'MEDIUM' WHEN fraud_score < 70 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
 status = 'approved' AS approved, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM claims LEFT JOIN workers USING (worker_id)
""")
def s4(t: Tables):
    flat = t.claims_with_zone.select(
        F.col("claim_sk").alias("id"), F.col("worker_name").alias("user"), "amount", "reason",
        F.col("trigger_type").alias("trigger"), "status", "fraud_score",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    homes = t.workers.select(F.col("worker_name").alias("name"), "pincode")
    loaded = files.seed_claims(flat, homes, loaded_at=F.lit("2001-08-02").cast("timestamp_ntz"), id_width=8)
    return loaded.select("claim_id", "worker_name", "pincode", "amount", "trigger_type", "status",
                         "fraud_result.score", "fraud_result.risk_level", "fraud_result.approved",
                         F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("s4_seed_workers", FLAT_SQL)
def s4b(t: Tables):
    # Workers without history come without the delivery fields, as in an old snapshot.
    sparse = {f: F.when(F.col("has_delivery_history"), F.col(f)) for f in docs.DELIVERY_FIELDS}
    seeded = files.seed_workers(t.workers.withColumns(sparse))
    return docs.flatten_worker(seeded).withColumn("platform_links", F.array_join("platform_links", ","))


@query("s5_csv_features", f"WITH {TRAIN_SQL} SELECT worker_id, month, trust_score, avg_daily_earning, expected_weekly_payout FROM vec")
def s5(t: Tables):
    path = scratch_path(t.spark, "features")
    rows = pricing.training_set(t.workers, t.zone_risk)
    files.write_csv(rows, path)
    back = files.read_csv(t.spark, path, rows.schema)
    return back.select("worker_id", "month", "trust_score", "avg_daily_earning", "expected_weekly_payout")


def _observed(t, which=None):
    body = F.to_json(F.struct(
        F.struct(F.col("rain_mm_hr").alias("1h")).alias("rain"), F.struct(F.col("wind_kmh").alias("speed")).alias("wind"),
        F.array(F.struct(F.lit("light rain").alias("description"))).alias("weather"), F.col("pincode").alias("name")))
    rows = t.readings if which is None else t.readings.where(which)
    return rows.select("reading_id", "pincode", body.alias("body"))


DURATION_SQL = "CASE WHEN rain_mm_hr >= 7.5 THEN 60 WHEN rain_mm_hr >= 4 THEN 50 WHEN rain_mm_hr >= 1.5 THEN 35 ELSE 15 END"


@query("s8_observation_feed", f"""
SELECT reading_id, {sql_round("rain_mm_hr", 1)} AS rain_intensity, {DURATION_SQL} AS duration,
 {sql_round("wind_kmh * 3.6::DOUBLE", 1)} AS wind_speed, pincode AS place, 'light rain' AS description FROM readings
""")
def s8(t: Tables):
    return feeds.parse_observation(_observed(t)).drop("pincode")


def _forecast(t):
    # Twenty-six hourly values: the reading's rain, scaled hour by hour.
    hours = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda h: F.pmod(F.col("rain_mm_hr") + h, F.lit(5.0)))
    body = F.to_json(F.struct(
        F.struct(F.col("rain_mm_hr").alias("precipitation"), F.col("wind_kmh").alias("wind_speed_10m")).alias("current"),
        F.struct(hours.alias("precipitation")).alias("hourly")))
    return t.readings.select("reading_id", "pincode", body.alias("body"))


FORECAST_SQL = """least(60 * (SELECT count(*) FROM range(0, 24) h(i) WHERE (rain_mm_hr + i) % 5 > 2), 180)"""


@query("s9_forecast_feed", f"""
SELECT reading_id, {sql_round("rain_mm_hr", 1)} AS rain_intensity, CAST({FORECAST_SQL} AS INT) AS duration, {sql_round("wind_kmh", 1)} AS wind_speed FROM readings
""")
def s9(t: Tables):
    return feeds.parse_forecast(_forecast(t)).drop("pincode")


@query("s10_air_feed", """
SELECT reading_id, aqi, rain_mm_hr AS pm25, 'pm10' AS dominant, pincode AS station FROM readings WHERE NOT curfew_active
""")
def s10(t: Tables):
    body = F.to_json(F.struct(
        F.when(F.col("curfew_active"), "error").otherwise("ok").alias("status"),
        F.struct("aqi", F.struct(F.col("pincode").alias("name")).alias("city"),
                 F.struct(F.struct(F.col("rain_mm_hr").alias("v")).alias("pm25")).alias("iaqi"),
                 F.lit("pm10").alias("dominentpol")).alias("data")))
    return feeds.parse_air(t.readings.select("reading_id", body.alias("body")))


@query("s11_storm_feed", f"""
SELECT reading_id, {sql_round("wind_kmh * 3.6::DOUBLE", 1)} AS wind_speed_kmh, {sql_round("gust_kmh * 3.6::DOUBLE", 1)} AS wind_gust_kmh,
 {sql_round("rain_mm_hr", 2)} AS precip_mm_hr, 0::DOUBLE AS flood_index FROM readings
""")
def s11(t: Tables):
    body = F.to_json(F.struct(F.struct(F.struct(
        F.col("wind_kmh").alias("windSpeed"), F.col("gust_kmh").alias("windGust"),
        F.col("rain_mm_hr").alias("precipitationIntensity")).alias("values")).alias("data")))
    return feeds.parse_storm(t.readings.select("reading_id", body.alias("body")))


@query("s12_reading_cascade", f"""
SELECT r.reading_id, CASE WHEN event_type = 'view' THEN {sql_round("rain_mm_hr", 1)} WHEN event_type = 'click' THEN {sql_round("rain_mm_hr", 1)} ELSE coalesce(z.rain, 6.0::DOUBLE) END AS rain_intensity,
 CAST(CASE WHEN event_type = 'view' THEN {DURATION_SQL} WHEN event_type = 'click' THEN {FORECAST_SQL} ELSE coalesce(z.duration, 35) END AS INT) AS duration,
 CASE WHEN event_type = 'view' THEN {sql_round("wind_kmh * 3.6::DOUBLE", 1)} WHEN event_type = 'click' THEN {sql_round("wind_kmh", 1)} ELSE coalesce(z.wind, 20::DOUBLE) END AS wind_speed,
 CASE WHEN event_type = 'view' THEN 'observation' WHEN event_type = 'click' THEN 'forecast' ELSE 'zone fallback' END AS source, event_type IN ('view', 'click') AS is_live
FROM readings r JOIN events e ON e.event_id = r.reading_id LEFT JOIN zone_fallback z ON z.pincode = r.pincode
""")
def s12(t: Tables):
    # The first feed answered for 'view' events, the second for 'click' events.
    kind = t.events.select(F.col("event_id").alias("reading_id"), "event_type")
    primary = feeds.parse_observation(_observed(t)).join(kind.where("event_type = 'view'"), "reading_id", "left_semi")
    secondary = feeds.parse_forecast(_forecast(t)).join(kind.where("event_type = 'click'"), "reading_id", "left_semi")
    out = feeds.cascade(t.readings.select("reading_id", "pincode"), primary, secondary, t.zone_fallback, "reading_id")
    return out.drop("pincode")


@query("s13_geocode", """
SELECT w.worker_id, coalesce(k.lat, 10 + z.zone_idx) AS lat, coalesce(k.lon, 70 + z.zone_idx) AS lon, coalesce(k.place, w.city) AS place
FROM workers w JOIN zone_pins z USING (pincode) LEFT JOIN zone_coords k USING (pincode)
""")
def s13(t: Tables):
    answers = t.zone_pins.select("pincode", F.to_json(F.array(F.struct(
        (F.lit(10) + F.col("zone_idx")).cast("string").alias("lat"), (F.lit(70) + F.col("zone_idx")).cast("string").alias("lon"),
        F.struct(F.lit(None).cast("string").alias("suburb"), F.col("city")).alias("address")))).alias("body"))
    pins = t.workers.select("pincode").distinct()
    coded = feeds.geocode(pins, t.zone_coords, answers)
    return t.workers.select("worker_id", "pincode").join(coded, "pincode").drop("pincode")


@query("s14_vision_answers", """
SELECT claim_sk, claim_sk % 7 <> 0 AS vision_used, claim_sk % 7 = 0 OR claim_sk % 5 <> 0 AS authentic,
 CASE WHEN claim_sk % 7 = 0 THEN 'UNVERIFIED' WHEN claim_sk % 5 = 0 THEN 'REJECTED' WHEN claim_sk % 5 = 1 THEN 'SUSPICIOUS' ELSE 'VERIFIED' END AS verdict,
 CASE WHEN claim_sk % 7 = 0 THEN 'UNKNOWN' WHEN claim_sk % 3 = 0 THEN 'STRONG' ELSE 'WEAK' END AS weather_evidence,
 CAST(CASE WHEN claim_sk % 7 = 0 THEN 0 ELSE greatest(-30, least(40, (claim_sk * 7) % 101 - 50)) END AS INT) AS score_adjustment FROM claims
""")
def s14(t: Tables):
    return feeds.parse_vision(t.vision_raw).select(
        "claim_sk", "vision_used", "authentic", "verdict", "weather_evidence", "score_adjustment")
