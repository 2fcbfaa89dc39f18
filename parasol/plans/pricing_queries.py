"""Scoring, pricing and triggers over whole tables."""

from pyspark.sql import functions as F

from parasol.functions.collections import joined
from parasol.functions.numeric import round_to
from parasol.operators import pricing, scoring, triggers
from parasol.operators.scoring import with_zone_profile
from parasol.plans.registry import query, sql_round
from parasol.plans.signal_queries import fired_rows, fired_sql

ZONED_SQL = """
zoned AS (SELECT w.*, coalesce(flood_frequency, 0.40::DOUBLE) AS flood_frequency, coalesce(avg_rainfall_mm, 900::DOUBLE) AS avg_rainfall_mm,
 coalesce(aqi_annual_avg, 120::DOUBLE) AS aqi_annual_avg, coalesce(waterlogging_score, 0.35::DOUBLE) AS waterlogging_score,
 coalesce(disruption_days_per_year, 18) AS disruption_days_per_year FROM workers w LEFT JOIN zone_risk USING (pincode))
"""
CLIP = "least(greatest({}, {}::DOUBLE), {}::DOUBLE)"
SIMPLE = f"""{CLIP.format(
    "delivery_consistency * 100::DOUBLE * 0.30::DOUBLE + location_honesty * 100::DOUBLE * 0.25::DOUBLE + "
    + CLIP.format("claim_history_score * 100::DOUBLE - least(fraudulent_flags * 25, 100) + least(claim_free_weeks * 2, 15)", 0, 100)
    + " * 0.25::DOUBLE + "
    + CLIP.format("100::DOUBLE - disruption_days_per_year / 52::DOUBLE * 80::DOUBLE - flood_frequency * 20::DOUBLE", 20, 100)
    + " * 0.20::DOUBLE", 0, 100)}"""
SCORE_SQL = f"""
scored AS (SELECT * EXCLUDE (trust_score), {sql_round(f'''CASE WHEN account_age_days < 21 THEN least({SIMPLE}, 65::DOUBLE)
 WHEN account_age_days < 60 THEN least({SIMPLE}, 80::DOUBLE) ELSE {SIMPLE} END''', 1)} AS trust_score FROM zoned)
"""
GRADE_SQL = """CASE WHEN {0} >= 85 THEN 'A+' WHEN {0} >= 75 THEN 'A' WHEN {0} >= 62 THEN 'B+' WHEN {0} >= 50 THEN 'B'
 WHEN {0} >= 35 THEN 'C' ELSE 'D' END"""
SPEED_SQL = """CASE WHEN {0} >= 85 THEN 'Instant' WHEN {0} >= 62 THEN '2hr auto' WHEN {0} >= 50 THEN '6hr hold' ELSE '24hr review' END"""
MODIFIER_SQL = sql_round(CLIP.format(
    "CASE WHEN {0} >= 50 THEN 1::DOUBLE - (({0} - 50::DOUBLE) / 10::DOUBLE) * 0.04::DOUBLE "
    "ELSE 1::DOUBLE + ((50::DOUBLE - {0}) / 10::DOUBLE) * 0.05::DOUBLE END", 0.65, 1.40), 3)


@query("p1_trust_score_simple", f"WITH {ZONED_SQL}, {SCORE_SQL} SELECT worker_id, trust_score FROM scored")
def p1(t):
    return pricing.zoned_scored(t.workers, t.zone_risk).select("worker_id", "trust_score")


FULL_INPUT_SQL = f"""{ZONED_SQL}, inp AS (SELECT worker_id, total_deliveries % 31 AS active_days, delivery_consistency * 20 AS deliveries_per_day,
 account_age_days % 20 AS streak_days, account_age_days AS tenure_days, location_honesty AS gps_consistency, claim_history_score AS zone_adherence,
 delivery_consistency AS tower_match, past_claims_count AS total_claims, past_claims_count - past_claims_count % 3 AS approved_claims,
 fraudulent_flags, claim_free_weeks, past_claims_count % 2 AS false_positives, disruption_days_per_year, flood_frequency,
 CASE WHEN has_delivery_history THEN location_honesty END AS behaviour, pan_verified, account_age_days FROM zoned),
 parts AS (SELECT *, least(active_days / 22::DOUBLE, 1::DOUBLE) AS act,
  CASE WHEN total_claims = 0 THEN 1::DOUBLE ELSE {CLIP.format("(approved_claims - false_positives) / greatest(total_claims, 1)", 0, 1)} END AS appr,
  (gps_consistency * 0.35::DOUBLE + zone_adherence * 0.35::DOUBLE + tower_match * 0.30::DOUBLE) * CASE WHEN pan_verified THEN 1::DOUBLE ELSE 0.40::DOUBLE END * 100::DOUBLE AS loc,
  {CLIP.format("100::DOUBLE - disruption_days_per_year / 52::DOUBLE * 80::DOUBLE - flood_frequency * 20::DOUBLE", 20, 100)} AS c4 FROM inp),
 subs AS (SELECT *, (act * 0.40::DOUBLE + least(deliveries_per_day / 20::DOUBLE, 1::DOUBLE) * 0.30::DOUBLE + least(streak_days / 14::DOUBLE, 1::DOUBLE) * 0.15::DOUBLE
   + least(tenure_days / 180::DOUBLE, 1::DOUBLE) * 0.15::DOUBLE) * 100::DOUBLE AS c1,
  CASE WHEN behaviour IS NULL THEN loc ELSE {CLIP.format("loc + (behaviour - 0.5::DOUBLE) * 10::DOUBLE", 0, 100)} END AS c2,
  {CLIP.format("(CASE WHEN total_claims = 0 THEN 0.85::DOUBLE ELSE appr * (1::DOUBLE - least(fraudulent_flags * 0.25::DOUBLE, 1::DOUBLE)) END "
               "+ least(claim_free_weeks * 0.02::DOUBLE, 0.15::DOUBLE)) * 100::DOUBLE", 0, 100)} AS c3 FROM parts),
 raw AS (SELECT *, {CLIP.format("c1 * 0.30::DOUBLE + c2 * 0.25::DOUBLE + c3 * 0.25::DOUBLE + c4 * 0.20::DOUBLE", 0, 100)} AS r FROM subs),
 tot AS (SELECT *, CASE WHEN account_age_days < 21 THEN least(r, 65::DOUBLE) WHEN account_age_days < 60 THEN least(r, 80::DOUBLE) ELSE r END AS total FROM raw)
"""


@query("p2_trust_score_full", f"""
WITH {FULL_INPUT_SQL}
SELECT worker_id, {sql_round("total", 1)} AS total_score, {sql_round("c1", 1)} AS delivery_score, {sql_round("c2", 1)} AS location_score,
 {sql_round("c3", 1)} AS claim_score, {sql_round("c4", 1)} AS zone_score,
 concat_ws('|', CASE WHEN act > 0.85 THEN 'Works ' || CAST(active_days AS VARCHAR) || '/30 days consistently' END,
  CASE WHEN streak_days >= 7 THEN CAST(streak_days AS VARCHAR) || '-day delivery streak' END,
  CASE WHEN tower_match > 0.90 THEN 'Location signals consistent across GPS and cell tower' END,
  CASE WHEN behaviour > 0.85 THEN 'Behavioral biometrics consistent (trusted device)' END,
  CASE WHEN claim_free_weeks >= 4 THEN CAST(claim_free_weeks AS VARCHAR) || '-week claim-free streak' END,
  CASE WHEN total_claims > 0 AND appr > 0.95 THEN 'Clean claim history (' || CAST(approved_claims AS VARCHAR) || '/' || CAST(total_claims AS VARCHAR) || ' approved)' END,
  CASE WHEN flood_frequency < 0.2 THEN 'Low flood-risk zone' END) AS strengths,
 concat_ws('|', CASE WHEN act < 0.50 THEN 'Low activity in last 30 days' END, CASE WHEN NOT pan_verified THEN 'PAN not verified — location honesty capped' END,
  CASE WHEN zone_adherence < 0.70 THEN 'Frequently operates outside registered zone' END,
  CASE WHEN fraudulent_flags > 0 THEN CAST(fraudulent_flags AS VARCHAR) || ' fraud flag(s) on record' END,
  CASE WHEN flood_frequency > 0.7 THEN 'High flood-risk zone — premium adjusted accordingly' END,
  CASE WHEN account_age_days < 21 THEN 'New account — score capped at 65 until 21-day mark' END) AS flags FROM tot
""")
def p2(t):
    return _full(t).select("worker_id", "total_score", "delivery_score", "location_score", "claim_score", "zone_score",
                           joined(F.col("strengths")).alias("strengths"), joined(F.col("flags")).alias("flags"))


def _full(t):
    c = F.col
    inputs = with_zone_profile(t.workers, t.zone_risk).select(
        "worker_id", (c("total_deliveries") % 31).alias("active_days"), (c("delivery_consistency") * 20).alias("deliveries_per_day"),
        (c("account_age_days") % 20).alias("streak_days"), c("account_age_days").alias("tenure_days"),
        c("location_honesty").alias("gps_consistency"), c("claim_history_score").alias("zone_adherence"),
        c("delivery_consistency").alias("tower_match"), c("past_claims_count").alias("total_claims"),
        (c("past_claims_count") - c("past_claims_count") % 3).alias("approved_claims"), "fraudulent_flags", "claim_free_weeks",
        (c("past_claims_count") % 2).alias("false_positives"), "disruption_days_per_year", "flood_frequency",
        F.when(c("has_delivery_history"), c("location_honesty")).alias("behaviour"), "pan_verified", "account_age_days")
    return scoring.full_trust_score(inputs)


@query("p3_grade_and_speed", f"""
WITH {FULL_INPUT_SQL} SELECT worker_id, {GRADE_SQL.format("total")} AS grade, {SPEED_SQL.format("total")} AS payout_speed,
 CASE WHEN total >= 85 THEN 'Elite worker. Instant payouts. Maximum discount.' WHEN total >= 75 THEN 'Trusted worker. Auto-approve all claims.'
  WHEN total >= 62 THEN 'Good standing. Standard auto-approval.' WHEN total >= 50 THEN 'Acceptable. Light review on high-value claims.'
  WHEN total >= 35 THEN 'Watch closely. Manual review recommended.' ELSE 'High risk. All claims require manual review.' END AS recommendation FROM tot
""")
def p3(t):
    return _full(t).select("worker_id", "grade", "payout_speed", "recommendation")


@query("p4_premium_modifier", f"WITH {FULL_INPUT_SQL} SELECT worker_id, {MODIFIER_SQL.format('total')} AS premium_modifier FROM tot")
def p4(t):
    return _full(t).select("worker_id", "premium_modifier")


FEATURE_SQL = """
feat AS (SELECT *, CASE plan WHEN 'basic' THEN 29 WHEN 'pro' THEN 79 ELSE 49 END AS base_premium,
 CASE WHEN {m} IN (6,7,8,9) THEN 1 ELSE 0 END AS is_monsoon, CASE WHEN {m} IN (10,11,12,1,2) THEN 1 ELSE 0 END AS is_aqi_season,
 CASE WHEN {m} IN (6,7,8,9) THEN disruption_days_per_year / 365::DOUBLE * 7::DOUBLE * 2.5::DOUBLE ELSE disruption_days_per_year / 365::DOUBLE * 7::DOUBLE END AS weekly_disruption_prob
 FROM {src}), vec AS (SELECT *, weekly_disruption_prob * avg_daily_earning * 0.5::DOUBLE AS expected_weekly_payout FROM feat)
"""
RAW_SQL = """(49::DOUBLE + flood_frequency * 18::DOUBLE + aqi_annual_avg / 220::DOUBLE * 6::DOUBLE - ((trust_score - 50::DOUBLE) / 50::DOUBLE) * 12::DOUBLE
 + CASE WHEN is_monsoon = 1 THEN 8::DOUBLE ELSE 0::DOUBLE END)"""
PREMIUM_SQL = sql_round(f"greatest(greatest(20::DOUBLE, base_premium * 0.6::DOUBLE), least(base_premium * 2.2::DOUBLE, {RAW_SQL} * 0.7::DOUBLE))", 2)


def quoted_sql(month: int) -> str:
    return f"{ZONED_SQL}, {SCORE_SQL}, {FEATURE_SQL.replace('{m}', str(month)).replace('{src}', 'scored')}"


def _vector(t, month):
    return pricing.premium_features(pricing.zoned_scored(t.workers, t.zone_risk), month)


@query("p5_feature_vector", f"WITH {quoted_sql(7)} SELECT worker_id, {', '.join(pricing.FEATURES)} FROM vec")
def p5(t):
    return _vector(t, 7).select("worker_id", *pricing.FEATURES)


@query("p6_actuarial_premium", f"WITH {quoted_sql(7)} SELECT worker_id, {sql_round(RAW_SQL, 4)} AS raw_premium FROM vec")
def p6(t):
    return _vector(t, 7).select("worker_id", round_to(pricing.actuarial_premium(), 4).alias("raw_premium"))


@query("p7_calibrated_premium", f"WITH {quoted_sql(4)} SELECT worker_id, {PREMIUM_SQL} AS premium FROM vec")
def p7(t):
    return _vector(t, 4).select("worker_id", pricing.calibrated(pricing.actuarial_premium()).alias("premium"))


def breakdown_sql(month: int, model: bool) -> str:
    lines = f"""
 SELECT worker_id, premium, 0 AS pos, 'Base Premium (' || upper(substr(plan,1,1)) || substr(plan,2) || ')' AS factor, base_premium::DOUBLE AS amount, 'base' AS direction FROM pr
 UNION ALL SELECT worker_id, premium, 1, 'Flood Risk — ' || city, {sql_round("flood_frequency * 18::DOUBLE", 2)}, 'increase' FROM pr
 UNION ALL SELECT worker_id, premium, 2, 'Air Quality Index (AQI) Risk', {sql_round("aqi_annual_avg / 220::DOUBLE * 6::DOUBLE", 2)}, 'increase' FROM pr
 UNION ALL SELECT worker_id, premium, 3, 'Zone Disruption Frequency', {sql_round("(disruption_days_per_year / 52::DOUBLE) * 2.5::DOUBLE", 2)}, 'increase' FROM pr
 UNION ALL SELECT worker_id, premium, 4, CASE WHEN is_monsoon = 1 THEN 'Monsoon Season Surcharge' ELSE 'Non-Monsoon Stability' END,
  CASE WHEN is_monsoon = 1 THEN 8 ELSE -5 END::DOUBLE, CASE WHEN is_monsoon = 1 THEN 'increase' ELSE 'discount' END FROM pr
 UNION ALL SELECT worker_id, premium, 5, 'Winter AQI Season Surcharge', 4::DOUBLE, 'increase' FROM pr WHERE is_aqi_season = 1
 UNION ALL SELECT worker_id, premium, 6, CASE WHEN adj > 0 THEN 'Trust Score Discount (grade ' ELSE 'Trust Score Risk Premium (grade ' END || {GRADE_SQL.format("trust_score")} || ')',
  CASE WHEN adj > 0 THEN -adj ELSE abs(adj) END, CASE WHEN adj > 0 THEN 'discount' ELSE 'increase' END FROM (SELECT *, {sql_round("((trust_score - 50::DOUBLE) / 50::DOUBLE) * 12::DOUBLE", 2)} AS adj FROM pr) a
 UNION ALL SELECT worker_id, premium, 7, 'No-Claim Streak (' || CAST(claim_free_weeks AS VARCHAR) || ' weeks)', -{sql_round("least(1::DOUBLE, claim_free_weeks / 12::DOUBLE) * 8::DOUBLE", 2)}, 'discount' FROM pr WHERE claim_free_weeks > 0
 UNION ALL SELECT worker_id, premium, 8, 'New Account Surcharge', {sql_round("(1::DOUBLE - account_age_days / 90::DOUBLE) * 5::DOUBLE", 2)}, 'increase' FROM pr WHERE account_age_days < 90"""
    head = f"WITH {quoted_sql(month)}, pr AS (SELECT *, {PREMIUM_SQL} AS premium FROM vec), li AS ({lines})"
    if not model:
        return f"{head} SELECT worker_id, CAST(row_number() OVER (PARTITION BY worker_id ORDER BY pos) - 1 AS INT) AS line, factor, amount, direction FROM li"
    gap = (f"gaps AS (SELECT worker_id, {sql_round('any_value(premium) - ' + sql_round('sum(CASE WHEN direction = $$discount$$ THEN -abs(amount) ELSE amount END)', 2), 2)} AS g FROM li GROUP BY 1)"
           .replace("$$", "'"))
    return f"""{head}, {gap} SELECT worker_id, factor, amount, direction FROM li
 UNION ALL SELECT worker_id, 'ML Personalization Adjustment', abs(g), CASE WHEN g > 0 THEN 'increase' ELSE 'discount' END FROM gaps WHERE g <> 0"""


@query("p8_itemised_breakdown", breakdown_sql(12, False))
def p8(t):
    return pricing.long_breakdown(pricing.quote(t.workers, t.zone_risk, 12), "worker_id")


@query("p8_reconciled_breakdown", breakdown_sql(7, True))
def p8b(t):
    priced = _vector(t, 7).withColumn("premium", pricing.calibrated(pricing.actuarial_premium()))
    return pricing.long_breakdown(pricing.breakdown(priced, model_used=True), "worker_id").drop("line")


@query("p9_rule_premium", f"""
SELECT worker_id, {sql_round("least(greatest(40::DOUBLE + avg_daily_earning * 0.02::DOUBLE - coalesce(trust_score, 70) * 0.1::DOUBLE, 20::DOUBLE), 120::DOUBLE)", 2)} AS premium FROM workers
""")
def p9(t):
    return t.workers.select("worker_id", pricing.rule_premium(
        F.coalesce("avg_daily_earning", F.lit(500.0)), F.coalesce("trust_score", F.lit(70.0))).alias("premium"))


TRAIN_SQL = f"""{ZONED_SQL}, {SCORE_SQL}, months AS (SELECT scored.*, m.month FROM scored, (SELECT CAST(unnest(range(1, 13)) AS INT) AS month) m),
 {FEATURE_SQL.replace('{m}', 'month').replace('{src}', 'months')}"""


@query("p10_training_set", f"""
WITH {TRAIN_SQL} SELECT worker_id, month, 49 AS base_premium, {', '.join(pricing.FEATURES[1:])},
 least(greatest(expected_weekly_payout * 1.35::DOUBLE, 20::DOUBLE), 120::DOUBLE) AS optimal_premium FROM vec
""")
def p10(t):
    return pricing.training_set(t.workers, t.zone_risk)


RAIN_SQL = "round_even(avg_daily_earning * ({rain} / 10::DOUBLE) * ({dur} / 60::DOUBLE) * CASE plan WHEN 'plus' THEN 0.6 WHEN 'pro' THEN 0.8 ELSE 0.4 END::DOUBLE, 0)"


@query("r1_rain_payout", f"""
WITH peak AS (SELECT pincode, rain_mm_hr, duration_min FROM (SELECT *, row_number() OVER
 (PARTITION BY pincode ORDER BY rain_mm_hr DESC, duration_min DESC, reading_id DESC) AS rn FROM readings) q WHERE rn = 1)
SELECT worker_id, {RAIN_SQL.format(rain="rain_mm_hr", dur="duration_min")} AS payout FROM workers JOIN peak USING (pincode)
""")
def r1(t):
    # The heaviest reading of each pincode, one row per zone, meets the zone's workers.
    peak = t.readings.groupBy("pincode").agg(
        F.max(F.struct("rain_mm_hr", "duration_min", "reading_id")).alias("p")).select("pincode", "p.*")
    return t.workers.join(peak, "pincode").select("worker_id", triggers.rain_payout(
        "avg_daily_earning", "rain_mm_hr", "duration_min", "plan").alias("payout"))


def _judged(t, source="readings"):
    return triggers.evaluate(with_zone_profile(getattr(t, source), t.zone_risk))


@query("r2_five_triggers", """
SELECT reading_id, rain_mm_hr > 7.5 AND duration_min > 45 AS heavy_rain, aqi > 150 AS aqi_spike,
 coalesce(waterlogging_score, 0.35) > 0.65 AND rain_mm_hr > 6 AS waterlogging_met, wind_kmh > 60 OR gust_kmh > 80 AS cyclone_wind,
 curfew_active AS strike_curfew FROM readings LEFT JOIN zone_risk USING (pincode)
""")
def r2(t):
    return _judged(t).select("reading_id", "heavy_rain", "aqi_spike", "waterlogging_met", "cyclone_wind", "strike_curfew")


@query("r3_waterlogging_suppressed", """
SELECT reading_id, coalesce(waterlogging_score, 0.35) > 0.65 AND rain_mm_hr > 6 AND NOT (rain_mm_hr > 7.5 AND duration_min > 45) AS waterlogging
FROM readings LEFT JOIN zone_risk USING (pincode)
""")
def r3(t):
    return _judged(t).select("reading_id", "waterlogging")


AMOUNT_SQL = f"""CASE f.trigger_type WHEN 'heavy_rain' THEN {RAIN_SQL.format(rain="rain_mm_hr", dur="duration_min")}
 WHEN 'aqi_spike' THEN round_even(avg_daily_earning * CASE WHEN aqi < 200 THEN 0.30 WHEN aqi < 300 THEN 0.45 ELSE 0.55 END::DOUBLE, 0)
 WHEN 'waterlogging' THEN {RAIN_SQL.format(rain="7", dur="duration_min")} WHEN 'cyclone_wind' THEN round_even(avg_daily_earning * 0.50::DOUBLE, 0)
 ELSE round_even(avg_daily_earning * 0.60::DOUBLE, 0) END"""


@query("r4_auto_claim_totals", f"""
WITH {fired_sql("readings")}
SELECT f.pincode, f.trigger_type, count(DISTINCT reading_id) AS firings, count(*) AS claims_count, sum({AMOUNT_SQL}) AS payout_total
FROM fired f JOIN workers w ON f.pincode = w.pincode GROUP BY 1, 2
""")
def r4(t):
    return triggers.payout_totals(fired_rows(t), t.workers, ["pincode", "trigger_type"])


@query("r5_trigger_run_summary", f"""
WITH {fired_sql("readings")}, n AS (SELECT reading_id, count(*) AS n FROM fired GROUP BY 1), e AS (SELECT pincode, count(*) AS e FROM workers GROUP BY 1)
SELECT reading_id, CAST(coalesce(n, 0) AS INT) AS fired_count, coalesce(n, 0) * coalesce(e, 0) AS claims_count
FROM readings LEFT JOIN n USING (reading_id) LEFT JOIN e USING (pincode)
""")
def r5(t):
    return triggers.run_summary(_judged(t), t.workers).select("reading_id", "fired_count", "claims_count")


@query("r6_curfew_alerts", "SELECT reading_id, pincode IN ('110001', '400001') AS curfew_active FROM readings")
def r6(t):
    return triggers.with_curfew_alerts(t.readings).select("reading_id", "curfew_active")


@query("r7_what_if", f"""
SELECT pincode, f.trigger_type, count(*) AS claims_count, sum(CASE f.trigger_type WHEN 'heavy_rain' THEN {RAIN_SQL.format(rain="9.2::DOUBLE", dur="55")}
 WHEN 'aqi_spike' THEN round_even(avg_daily_earning * 0.45::DOUBLE, 0) WHEN 'waterlogging' THEN {RAIN_SQL.format(rain="7.5::DOUBLE", dur="50")}
 WHEN 'cyclone_wind' THEN round_even(avg_daily_earning * 0.50::DOUBLE, 0) ELSE round_even(avg_daily_earning * 0.60::DOUBLE, 0) END) AS payout_total
FROM workers, (VALUES ('heavy_rain'), ('aqi_spike'), ('waterlogging'), ('cyclone_wind'), ('strike_curfew')) f(trigger_type) GROUP BY 1, 2
""")
def r7(t):
    return triggers.what_if(t.workers)


@query("r8_trigger_event_fact", f"""
WITH {fired_sql("readings")}
SELECT f.reading_id, f.trigger_type, count(w.worker_id) AS claims_count, coalesce(sum({AMOUNT_SQL}), 0) AS payout_total
FROM fired f LEFT JOIN workers w ON f.pincode = w.pincode GROUP BY 1, 2
""")
def r8(t):
    return triggers.trigger_events(fired_rows(t), t.workers).select("reading_id", "trigger_type", "claims_count", "payout_total")


@query("r9_claim_routing", """
SELECT claim_sk, CASE WHEN s >= 85 THEN 'Instant' WHEN s >= 62 THEN '2hr auto' WHEN s >= 50 THEN '6hr hold' ELSE '24hr review' END AS trigger_speed,
 CASE WHEN s >= 50 THEN 'approved' ELSE 'pending_review' END AS consumer_status,
 CASE WHEN s >= 85 THEN 'Instant' WHEN s >= 75 THEN '2hr auto' WHEN s >= 50 THEN '6hr hold' ELSE '24hr review' END AS consumer_speed,
 CASE WHEN s >= 75 THEN 'Auto-approved — grade A/A+' WHEN s >= 50 THEN 'Auto-approved — grade B/B+, 6hr processing' ELSE 'Manual review required — grade C/D' END AS manual_note
FROM (SELECT claim_sk, coalesce(nullif(trust_score, 0), 50) AS s FROM claims LEFT JOIN workers USING (worker_id)) q
""")
def r9(t):
    side = t.workers.select("worker_id", "trust_score")
    return t.claims.join(side, "worker_id", "left").select(
        "claim_sk", scoring.route("trust_score", "trigger")["payout_speed"].alias("trigger_speed"),
        scoring.route("trust_score", "consumer")["status"].alias("consumer_status"),
        scoring.route("trust_score", "consumer")["payout_speed"].alias("consumer_speed"),
        scoring.route("trust_score", "manual")["review_note"].alias("manual_note"))
