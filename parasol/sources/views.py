"""The driver's tables seen as insurance tables.

This is the only module that knows the driver's table and column names. Each
view is one SELECT in the dialect Spark and DuckDB share, so the test oracle
reads the same inputs; ``DIV_`` (integer division) and ``NTZ_`` (the literal
prefix of a zone-less timestamp) are the two tokens that differ.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from parasol.constants import ZONE_FALLBACK_READINGS, KNOWN_COORDS, PLANS, ZONE_RISK

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def values_list(rows) -> str:
    def literal(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)

    return ",\n ".join("(" + ",".join(literal(v) for v in row) + ")" for row in rows)


# Pincode and city of each nation key.
ZONE_PINS = [
    (0, "560034", "Koramangala"), (1, "560038", "Indiranagar"), (2, "560068", "Rajajinagar"),
    (3, "560001", "MG Road"), (4, "560029", "JP Nagar"), (5, "400001", "Mumbai Fort"),
    (6, "400070", "Mumbai Andheri"), (7, "110001", "Delhi CP"), (8, "110092", "Delhi East"),
    (9, "600001", "Chennai Central"), (10, "600028", "T Nagar"), (11, "603203", "Maraimalai Nagar"),
    (12, "603002", "Chengalpattu"), (13, "700001", "Kolkata"), (14, "500001", "Hyderabad"),
    (15, "411001", "Pune"), (16, "682001", "Kochi"), (17, "695001", "Thiruvananthapuram"),
    (18, "440001", "Nagpur"), (19, "160017", "Chandigarh"), (20, "302001", "Jaipur"),
    (21, "380001", "Ahmedabad"), (22, "999999", "Honeypot"), (23, "560099", "Ghost A"),
    (24, "110099", "Ghost B"),
]

VIEWS: dict[str, str] = {
    "zone_pins": f"""
SELECT CAST(zone_idx AS INT) AS zone_idx, pincode, city FROM (VALUES
 {values_list(ZONE_PINS)}) z(zone_idx, pincode, city)""",
    "zone_risk": f"""
SELECT pincode, CAST(ff AS DOUBLE) AS flood_frequency, CAST(rain AS DOUBLE) AS avg_rainfall_mm,
 CAST(aqi AS DOUBLE) AS aqi_annual_avg, CAST(wl AS DOUBLE) AS waterlogging_score,
 CAST(dd AS INT) AS disruption_days_per_year
FROM (VALUES
 {values_list(ZONE_RISK)}) z(pincode, ff, rain, aqi, wl, dd)""",
    "zone_coords": f"""
SELECT pincode, CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lon, place
FROM (VALUES
 {values_list(KNOWN_COORDS)}) z(pincode, la, lo, place)""",
    "zone_fallback": f"""
SELECT pincode, CAST(r AS DOUBLE) AS rain, CAST(du AS INT) AS duration,
 CAST(w AS DOUBLE) AS wind, CAST(a AS INT) AS aqi
FROM (VALUES
 {values_list(ZONE_FALLBACK_READINGS)}) z(pincode, r, du, w, a)""",
    "plans": f"""
SELECT plan, CAST(p AS INT) AS weekly_premium, CAST(c AS INT) AS weekly_cap, s AS plan_speed,
 CAST(f AS DOUBLE) AS rain_factor
FROM (VALUES
 {values_list(PLANS)}) z(plan, p, c, s, f)""",
    "workers": """
SELECT c_custkey AS worker_id, c_name AS worker_name, z.pincode, z.city,
 CASE c_mktsegment WHEN 'FURNITURE' THEN 'pro' WHEN 'MACHINERY' THEN 'plus'
                   WHEN 'HOUSEHOLD' THEN 'plus' ELSE 'basic' END AS plan,
 CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'BAD123'
      ELSE concat('ABCPK', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'R') END AS pan_number,
 (c_custkey % 7 <> 0) AS pan_verified,
 CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'swiggy' WHEN 2 THEN 'swiggy,zomato'
                    ELSE 'swiggy,zomato,blinkit' END AS platforms_csv,
 (c_custkey % 23 = 0) AS policy_paused,
 CAST((c_custkey * 17) % 600 AS INT) AS total_deliveries,
 (c_custkey % 9 <> 0) AS has_delivery_history,
 CAST((c_custkey * 13) % 400 AS INT) AS account_age_days,
 CAST(60 + c_custkey % 40 AS DOUBLE) / 100 AS delivery_consistency,
 CAST(300 + c_custkey % 900 AS DOUBLE) AS avg_daily_earning,
 CAST(c_custkey % 15 AS INT) AS claim_free_weeks,
 CAST(c_custkey % 12 AS INT) AS past_claims_count,
 CAST(60 + (c_custkey * 3) % 40 AS DOUBLE) / 100 AS location_honesty,
 CAST(50 + c_custkey % 51 AS DOUBLE) / 100 AS claim_history_score,
 CAST(CASE WHEN c_custkey % 10 = 0 THEN (c_custkey DIV_ 10) % 4 ELSE 0 END AS INT) AS fraudulent_flags,
 CASE WHEN c_custkey % 11 = 0 THEN NULL
      ELSE CAST(200 + (c_custkey * 7) % 800 AS DOUBLE) / 10 END AS trust_score
FROM {customer} JOIN {zone_pins} z ON c_nationkey = z.zone_idx""",
    # Policies are held by the workers whose account is not overdrawn.
    "policies": """
SELECT w.worker_id, w.worker_name, w.plan, 'active' AS status
FROM {workers} w JOIN {customer} k ON w.worker_id = k.c_custkey WHERE k.c_acctbal >= 0""",
    "claims": """
SELECT o_orderkey AS claim_sk,
 concat('CLM-', CAST(year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) AS STRING),
        '-', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS claim_id,
 o_custkey AS worker_id,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 1200 + 50 AS DOUBLE) AS amount,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'heavy_rain' WHEN '2-HIGH' THEN 'waterlogging'
      WHEN '3-MEDIUM' THEN 'aqi_spike' WHEN '5-LOW' THEN 'strike_curfew'
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'cyclone_wind' ELSE 'manual' END END AS trigger_type,
 CASE o_orderkey % 3 WHEN 0 THEN 'heavy rain disruption' WHEN 1 THEN 'could not work today'
                     ELSE 'flood on route' END AS reason,
 CASE o_orderstatus WHEN 'F' THEN 'approved'
      WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'pending_review' END
      ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'rejected_fraud' END END AS status,
 CAST((o_orderkey * 37) % 101 AS INT) AS fraud_score,
 concat('dev-', CAST((o_orderkey * 31) % 6007 AS STRING)) AS device_id,
 (o_orderkey % 3 <> 0) AS photo_submitted,
 (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS payout_processed,
 o_orderdate + ((o_orderkey * 7919) % 86400) * INTERVAL '1' SECOND AS created_at,
 o_orderdate + ((o_orderkey * 7919) % 86400 + (o_orderkey % 72) * 3600) * INTERVAL '1' SECOND AS updated_at
FROM {orders}""",
    "payout_requests": """
SELECT l_orderkey AS claim_sk, l_linenumber AS attempt, l_shipdate AS requested_at,
 CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1200 + 50 AS DOUBLE) AS amount,
 CASE l_returnflag WHEN 'R' THEN 'fallback_simulation' ELSE 'live_api' END AS mode
FROM {lineitem}""",
    "readings": """
SELECT event_id AS reading_id, z.pincode, ts,
 CAST(CAST(floor(value) AS BIGINT) % 13 AS DOUBLE) AS rain_mm_hr,
 CAST((event_id * 53) % 90 AS INT) AS duration_min,
 CAST(60 + (event_id * 53) % 300 AS INT) AS aqi,
 CAST((event_id * 29) % 90 AS DOUBLE) AS wind_kmh,
 CAST((event_id * 29) % 90 * 13 AS DOUBLE) / 10 AS gust_kmh,
 (event_type = 'signup' AND event_id % 10 = 0) AS curfew_active
FROM {events} JOIN {zone_pins} z ON user_id % 25 = z.zone_idx""",
    # The same readings laid over the claims' years, so that claims meet weather.
    "past_readings": """
SELECT reading_id, pincode, rain_mm_hr, duration_min, aqi, wind_kmh, gust_kmh, curfew_active,
 NTZ_ '1995-01-01 00:00:00' + ((reading_id * 7919) % 2404 * 86400
  + hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT)) * INTERVAL '1' SECOND AS ts
FROM {readings}""",
    "gps_pings": """
SELECT user_id AS trace_id, event_id AS ping_id, ts,
 CASE WHEN user_id % 10 = 0 THEN CAST(12.9 AS DOUBLE)
      ELSE CAST(12900 + (event_id * 7919) % 200 AS DOUBLE) / 1000
           + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END END AS lat,
 CAST(77500 + (event_id * 104729) % 200 AS DOUBLE) / 1000 AS lon
FROM {events}""",
    "event_log": """
SELECT event_id, ts AS event_ts, ts AS arrival_ts, user_id, event_type, value, props FROM {events}
UNION ALL
SELECT event_id, ts AS event_ts, ts + INTERVAL '1' MINUTE AS arrival_ts, user_id, event_type, value, props
FROM {events} WHERE event_id % 10 = 0""",
    # Claims filed in five zones, dense enough for the one-hour burst rule.
    "zone_claims": """
SELECT event_id, user_id, concat('zone-', CAST(user_id % 5 AS STRING)) AS pincode, ts FROM {events}""",
    # A worker filing from changing zones.
    "zone_visits": """
SELECT event_id, user_id AS worker_id, z.pincode, ts
FROM {events} JOIN {zone_pins} z ON (event_id * 7 + user_id) % 25 = z.zone_idx""",
    "outbox": """
SELECT event_id, concat('agg-', CAST(user_id AS STRING)) AS aggregate_id,
 CASE event_type WHEN 'purchase' THEN 'claim.created' WHEN 'click' THEN 'claim.approved'
      WHEN 'view' THEN 'claim.rejected' WHEN 'signup' THEN 'payout.completed'
      ELSE 'claim.processing.dlq' END AS topic,
 CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending'
      ELSE 'published' END AS status,
 CAST(event_id % 12 AS INT) AS retry_count, ts AS created_at
FROM {events}""",
    # What a photo carries besides its pixels, per claim.
    "claim_photos": """
SELECT claim_sk,
 CASE WHEN claim_sk % 10 = 0 THEN NULL
      ELSE created_at - ((claim_sk * 13) % 240) * INTERVAL '1' MINUTE END AS photo_ts,
 (claim_sk % 8 = 0) AS exif_stripped,
 CASE WHEN claim_sk % 5 = 0 THEN NULL
      ELSE CAST(8000 + (claim_sk * 37) % 22000 AS DOUBLE) / 1000 END AS gps_lat,
 CAST(72000 + (claim_sk * 91) % 8000 AS DOUBLE) / 1000 AS gps_lon,
 CASE claim_sk % 4 WHEN 0 THEN 'gallery' ELSE 'camera_only' END AS capture_type,
 (claim_sk % 6 = 0) AS require_location
FROM {claims}""",
    # What the vision model answered, per claim: fenced, bare or broken JSON.
    "vision_raw": """
SELECT claim_sk,
 CASE claim_sk % 7
  WHEN 0 THEN 'model overloaded'
  WHEN 1 THEN concat('```json\\n', body, '\\n```')
  WHEN 2 THEN concat('```\\n', body, '\\n```')
  ELSE body END AS response
FROM (SELECT claim_sk, concat('{"authentic": ', CASE WHEN claim_sk % 5 = 0 THEN 'false' ELSE 'true' END,
  ', "verdict": "', CASE claim_sk % 5 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'SUSPICIOUS' ELSE 'VERIFIED' END,
  '", "weather_evidence": "', CASE claim_sk % 3 WHEN 0 THEN 'STRONG' ELSE 'WEAK' END,
  '", "recommended_action": "', CASE WHEN claim_sk % 10 = 0 THEN 'REJECT' WHEN claim_sk % 5 = 1 THEN 'MANUAL_REVIEW' ELSE 'APPROVE' END,
  '", "is_stock_photo": ', CASE WHEN claim_sk % 11 = 0 THEN 'true' ELSE 'false' END,
  ', "is_screenshot": ', CASE WHEN claim_sk % 17 = 0 THEN 'true' ELSE 'false' END,
  ', "is_ai_generated": ', CASE WHEN claim_sk % 19 = 0 THEN 'true' ELSE 'false' END,
  ', "score_adjustment": ', CAST((claim_sk * 7) % 101 - 50 AS STRING), '}') AS body
 FROM {claims}) v""",
}

_REF = re.compile(r"\{(\w+)\}")


def references(name: str) -> list[str]:
    return [r for r in dict.fromkeys(_REF.findall(VIEWS[name])) if r in VIEWS or r in RAW_TABLES]


def _fill(text: str, div: str, ntz: str) -> str:
    return text.replace("DIV_", div).replace("NTZ_", ntz)


class Tables:
    """Lazily built views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in RAW_TABLES):
            raise AttributeError(name)
        if name not in self._cache:
            if name in RAW_TABLES:
                df = self.spark.read.parquet(self.path(name))
            else:
                df = view_over(self.spark, name, {r: getattr(self, r) for r in references(name)})
            self._cache[name] = df
        return self._cache[name]

    @cached_property
    def claims_with_zone(self) -> DataFrame:
        """Claims with the pincode of the worker who filed them."""
        home = self.workers.select("worker_id", "worker_name", "pincode", "city")
        return self.claims.join(home, "worker_id", "left")


def view_over(spark: SparkSession, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """One view's SELECT over the given inputs (static or streaming)."""
    text = _fill(VIEWS[name], "DIV", "TIMESTAMP_NTZ")
    for ref in inputs:
        text = text.replace("{" + ref + "}", "__" + ref)
    text = text.replace("{", "{{").replace("}", "}}")
    for ref in inputs:
        text = text.replace("__" + ref, "{" + ref + "}")
    return spark.sql(text, **inputs)


def duckdb_cte(name: str) -> str:
    text = _fill(VIEWS[name], "//", "TIMESTAMP").replace("\\n", "' || chr(10) || '")
    for ref in references(name):
        text = text.replace("{" + ref + "}", ref)
    return f"{name} AS ({text.strip()})"
