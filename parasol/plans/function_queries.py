"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from parasol.constants import DISRUPTION_WORDS
from parasol.functions import collections as coll
from parasol.functions import geo, numeric as num, temporal as tm, text as tx
from parasol.operators.warehouse import risk_segment, score_segment
from parasol.plans.registry import query, sql_haversine, sql_round


@query("x1_pan_check", """
SELECT worker_id, coalesce(regexp_full_match(upper(trim(pan_number)), '[A-Z]{5}[0-9]{4}[A-Z]'), false) AS pan_valid,
 CASE WHEN regexp_full_match(upper(trim(pan_number)), '[A-Z]{5}[0-9]{4}[A-Z]') THEN
  CASE substr(upper(trim(pan_number)), 4, 1) WHEN 'P' THEN 'Individual' WHEN 'C' THEN 'Company' WHEN 'H' THEN 'HUF'
   WHEN 'F' THEN 'Firm' WHEN 'T' THEN 'Trust' ELSE 'Other' END END AS holder FROM workers
""")
def x1(t):
    return t.workers.select("worker_id", tx.pan_is_valid("pan_number").alias("pan_valid"),
                            tx.pan_holder("pan_number").alias("holder"))


@query("x2_derived_ids", """
SELECT claim_sk, claim_id AS rebuilt_id, 'PAY-' || claim_id AS idempotency_key,
 replace(lower(worker_name), ' ', '.') || '@upi' AS upi FROM claims JOIN workers USING (worker_id)
""")
def x2(t):
    # The id's day is the filing day: created_at adds only a time of day.
    return t.claims_with_zone.where("worker_name is not null").select(
        "claim_sk", tx.claim_id("created_at", "claim_sk").alias("rebuilt_id"),
        tx.idempotency_key("claim_id").alias("idempotency_key"), tx.upi_handle("worker_name").alias("upi"))


@query("x3_text_matches", """
SELECT claim_sk, regexp_matches(lower(reason), 'rain|aqi|flood|storm|curfew|strike|wind') AS mentions,
 status LIKE 'rejected%' AS rejected, contains(status, 'pending') AS pending FROM claims
""")
def x3(t):
    return t.claims.select("claim_sk", tx.mentions_any("reason", DISRUPTION_WORDS).alias("mentions"),
                           F.col("status").startswith("rejected").alias("rejected"),
                           F.col("status").contains("pending").alias("pending"))


@query("x4_text_shaping", """
SELECT claim_sk, substr(repeat(reason || ' ', 40), 1, 500) AS truncated,
 upper(substr(list_aggregate(list_transform(string_split(city, ' '), lambda x: substr(x, 1, 1)), 'string_agg', ''), 1, 2)) AS initials,
 CASE trigger_type WHEN 'heavy_rain' THEN 'Heavy Rain' WHEN 'waterlogging' THEN 'Waterlogging' WHEN 'aqi_spike' THEN 'Aqi Spike'
  WHEN 'strike_curfew' THEN 'Strike Curfew' WHEN 'cyclone_wind' THEN 'Cyclone Wind' ELSE 'Manual' END AS title
FROM claims JOIN workers USING (worker_id)
""")
def x4(t):
    return t.claims_with_zone.where("city is not null").select(
        "claim_sk", tx.truncated(F.repeat(F.concat("reason", F.lit(" ")), 40)).alias("truncated"),
        tx.initials("city").alias("initials"), tx.title_words("trigger_type").alias("title"))


@query("x5_date_attributes", """
SELECT claim_sk, CAST(year(updated_at)*10000 + month(updated_at)*100 + day(updated_at) AS INT) AS date_key,
 strftime(updated_at, '%a') AS day_of_week, CAST(isodow(updated_at) AS INT) AS day_num,
 strftime(updated_at, '%b') AS month_name, CAST(quarter(updated_at) AS INT) AS quarter,
 (isodow(updated_at) >= 6) AS is_weekend, (month(updated_at) IN (6,7,8,9)) AS is_monsoon,
 (month(updated_at) IN (10,11,12,1,2)) AS is_aqi_season FROM claims
""")
def x5(t):
    rows = t.claims.select("claim_sk", *tm.date_attributes("updated_at"),
                           tm.is_aqi_season(F.month("updated_at")).alias("is_aqi_season"))
    return rows.drop("date", "month", "year")


@query("x6_time_arithmetic", """
SELECT claim_sk, CASE WHEN claim_sk % 9 = 0 THEN strftime(updated_at, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS parsed,
 date_diff('second', created_at, updated_at)::DOUBLE / 3600::DOUBLE AS hours_open,
 CAST((hour(created_at) + 5) % 24 AS INT) AS ist_hour, ((hour(created_at) + 5) % 24) BETWEEN 2 AND 5 AS odd_hour,
 CASE WHEN hour(created_at) < 5 THEN 'Night' WHEN hour(created_at) < 12 THEN 'Morning' WHEN hour(created_at) < 17 THEN 'Afternoon'
  WHEN hour(created_at) < 21 THEN 'Evening' ELSE 'Night' END AS day_part FROM claims
""")
def x6(t):
    text = F.when(F.col("claim_sk") % 9 == 0, "not a date").otherwise(tm.iso_text("created_at"))
    return t.claims.select(
        "claim_sk", F.date_format(tm.parse_iso(text, "updated_at"), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        (tm.seconds_between("updated_at", "created_at") / 3600.0).alias("hours_open"),
        tm.ist_hour("created_at").alias("ist_hour"), tm.is_odd_hour("created_at").alias("odd_hour"),
        tm.part_of_day(F.hour("created_at")).alias("day_part"))


@query("x7_numeric", f"""
SELECT claim_sk, CASE WHEN trust_score IS NULL THEN NULL ELSE least(greatest(trust_score, 35::DOUBLE), 85::DOUBLE) END AS clipped,
 least(amount / greatest(avg_daily_earning, 1), 1::DOUBLE) AS earning_ratio, (amount > 100 AND amount % 500 = 0) AS round_amount,
 {sql_round("amount * 3.6::DOUBLE", 1)} AS kmh, CAST(trunc(amount * 100) AS BIGINT) AS paise
FROM claims JOIN workers USING (worker_id)
""")
def x7(t):
    joined = t.claims.join(t.workers.select("worker_id", "trust_score", "avg_daily_earning"), "worker_id")
    return joined.select(
        "claim_sk", num.clip("trust_score", 35.0, 85.0).alias("clipped"),
        F.least(F.col("amount") / F.greatest("avg_daily_earning", F.lit(1.0)), F.lit(1.0)).alias("earning_ratio"),
        ((F.col("amount") > 100) & (F.col("amount") % 500 == 0)).alias("round_amount"),
        num.round_to(num.kmh("amount"), 1).alias("kmh"), num.paise("amount").alias("paise"))


@query("x8_haversine", f"""
SELECT ping_id, {sql_round(sql_haversine("lat", "lon", "12.9352::DOUBLE", "77.6245::DOUBLE"), 3)} AS km FROM gps_pings
""")
def x8(t):
    return t.gps_pings.select("ping_id", num.round_to(
        geo.haversine_km("lat", "lon", F.lit(12.9352), F.lit(77.6245)), 3).alias("km"))


@query("x9_flag_arrays", """
SELECT worker_id, concat_ws('|', CASE WHEN pan_number IS NULL THEN 'NO_PAN' END, CASE WHEN NOT has_delivery_history THEN 'NO_HISTORY' END,
  CASE WHEN platforms_csv = '' THEN 'NO_PLATFORM' END) AS flags,
 CAST((CASE WHEN pan_number IS NULL THEN 1 ELSE 0 END) + (CASE WHEN NOT has_delivery_history THEN 1 ELSE 0 END)
  + (CASE WHEN platforms_csv = '' THEN 1 ELSE 0 END) AS INT) AS n_flags,
 (pan_number IS NULL OR platforms_csv = '' OR NOT has_delivery_history) AS any_missing,
 CASE WHEN platforms_csv = '' THEN 0 ELSE len(string_split(platforms_csv, ',')) END::INT AS platforms FROM workers
""")
def x9(t):
    flags = coll.flag_list(
        (F.col("pan_number").isNull(), "NO_PAN"), (~F.col("has_delivery_history"), "NO_HISTORY"),
        (F.col("platforms_csv") == "", "NO_PLATFORM"))
    return t.workers.select(
        "worker_id", coll.joined(flags).alias("flags"), F.size(flags).alias("n_flags"),
        coll.any_contains(flags, "NO_").alias("any_missing"),
        F.size(F.filter(F.split("platforms_csv", ","), lambda p: p != "")).alias("platforms"))


@query("x10_struct_arrays", """
SELECT worker_id, CAST(avg_daily_earning + CASE WHEN claim_free_weeks > 0 THEN -claim_free_weeks ELSE 0 END AS DOUBLE) AS total,
 CAST(1 + CASE WHEN claim_free_weeks > 0 THEN 1 ELSE 0 END AS INT) AS lines FROM workers
""")
def x10(t):
    lines = F.array(
        F.struct(F.lit("base").alias("factor"), F.col("avg_daily_earning").alias("amount")),
        F.struct(F.lit("streak").alias("factor"), (-F.col("claim_free_weeks").cast("double")).alias("amount")))
    kept = F.filter(lines, lambda x: x["amount"] != 0.0)
    return t.workers.select(
        "worker_id", F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["amount"]).alias("total"),
        F.size(kept).alias("lines"))


@query("x11_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
 '{"k":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events
""")
def x11(t):
    parsed = F.from_json("props", "k int")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("encoded"))


@query("x12_default_maps", """
SELECT worker_id, CASE CASE WHEN worker_id % 29 = 0 THEN 'gold' ELSE plan END WHEN 'basic' THEN 29 WHEN 'pro' THEN 79 ELSE 49 END AS price
FROM workers
""")
def x12(t):
    plan = F.when(F.col("worker_id") % 29 == 0, "gold").otherwise(F.col("plan"))
    return t.workers.select("worker_id", coll.lookup({"basic": 29, "plus": 49, "pro": 79}, plan, 49).alias("price"))


@query("x13_buckets", """
SELECT worker_id, CASE WHEN s >= 85 THEN 'LOW' WHEN s >= 70 THEN 'MEDIUM' WHEN s >= 50 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk,
 CASE WHEN trust_score IS NULL THEN 'UNSCORED' WHEN trust_score >= 85 THEN 'A_PLUS' WHEN trust_score >= 75 THEN 'A'
  WHEN trust_score >= 50 THEN 'B' ELSE 'C_D' END AS segment,
 CASE WHEN s >= 82 THEN 'Excellent' WHEN s >= 68 THEN 'Good' WHEN s >= 52 THEN 'Fair' ELSE 'Building' END AS label,
 CASE WHEN s < 25 THEN 'LOW' WHEN s < 50 THEN 'MEDIUM' WHEN s < 70 THEN 'HIGH' ELSE 'CRITICAL' END AS seed_risk
FROM (SELECT *, coalesce(nullif(trust_score, 0), 50) AS s FROM workers) q
""")
def x13(t):
    from parasol.operators.scoring import score_label, seed_risk_level
    s = num.truthy_or("trust_score", 50.0)
    return t.workers.select(
        "worker_id", risk_segment(s).alias("risk"), score_segment("trust_score").alias("segment"),
        score_label(s).alias("label"), seed_risk_level(s).alias("seed_risk"))
