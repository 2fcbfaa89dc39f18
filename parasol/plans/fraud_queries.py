"""L0-L7 without the anomaly model: fraud layers over the whole claims table."""

from pyspark.sql import functions as F

from parasol.functions.collections import joined
from parasol.operators import fraud, matching, signals
from parasol.plans.registry import query, sql_haversine, sql_round
from parasol.plans.signal_queries import DAILY_SQL, HOPS_SQL
from parasol.sources.feeds import parse_vision

PAN_OK = "regexp_full_match(upper(coalesce(pan_number, '')), '[A-Z]{5}[0-9]{4}[A-Z]')"
ACCOUNT_SQL = f"""
acct0 AS (SELECT *, CASE WHEN coalesce(pan_number, '') = '' THEN 45 WHEN NOT pan_verified THEN 25 WHEN NOT {PAN_OK} THEN 35 ELSE 0 END AS pp FROM workers),
acct AS (SELECT *, least(CASE WHEN NOT has_delivery_history THEN pp + 30 WHEN total_deliveries < 5 THEN pp + 15
   WHEN total_deliveries >= 50 THEN greatest(pp - 10, 0) ELSE pp END
  + CASE WHEN account_age_days < 3 AND past_claims_count > 0 THEN 50 WHEN account_age_days < 7 THEN 20 ELSE 0 END
  + CASE WHEN platforms_csv = '' THEN 20 ELSE 0 END, 100) AS integrity_score FROM acct0)
"""


def account_flags_sql(tag: str) -> str:
    return f"""CASE WHEN coalesce(pan_number, '') = '' THEN '{tag}NO_PAN' WHEN NOT pan_verified THEN '{tag}PAN_UNVERIFIED' WHEN NOT {PAN_OK} THEN '{tag}PAN_INVALID' END,
 CASE WHEN NOT has_delivery_history THEN '{tag}NO_DELIVERY_HISTORY' WHEN total_deliveries < 5 THEN '{tag}SPARSE_HISTORY' END,
 CASE WHEN account_age_days < 3 AND past_claims_count > 0 THEN '{tag}INSTANT_CLAIM' WHEN account_age_days < 7 THEN '{tag}VERY_NEW_ACCOUNT' END,
 CASE WHEN platforms_csv = '' THEN '{tag}NO_PLATFORM_LINK' END"""


@query("l0_account_integrity", f"""
WITH {ACCOUNT_SQL} SELECT worker_id, integrity_score, concat_ws('|', {account_flags_sql("")}) AS flags,
 has_delivery_history AND total_deliveries >= 5 AS history_ok, integrity_score < 50 AS passes_gate FROM acct
""")
def l0(t):
    return fraud.account_integrity(t.workers).select(
        "worker_id", "integrity_score", joined(F.col("integrity_flags")).alias("flags"), "history_ok", "passes_gate")


NETWORK_SQL = """
located AS (SELECT c.*, w.pincode FROM claims c JOIN workers w USING (worker_id) WHERE w.pincode <> '999999'),
net AS (SELECT claim_sk, count(*) OVER (PARTITION BY pincode ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS prior_hour,
 count(DISTINCT pincode) OVER (PARTITION BY worker_id ORDER BY created_at, claim_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS zones_before,
 count(DISTINCT worker_id) OVER (PARTITION BY device_id ORDER BY created_at, claim_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - CASE WHEN count(*) OVER (PARTITION BY device_id, worker_id ORDER BY created_at, claim_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS others
 FROM located)
"""
VISION_SQL = """
vis0 AS (SELECT claim_sk, claim_sk % 7 <> 0 AS used FROM claims),
vis AS (SELECT claim_sk, used, NOT used OR claim_sk % 5 <> 0 AS authentic,
 CASE WHEN NOT used THEN 'UNVERIFIED' WHEN claim_sk % 5 = 0 THEN 'REJECTED' WHEN claim_sk % 5 = 1 THEN 'SUSPICIOUS' ELSE 'VERIFIED' END AS verdict,
 CASE WHEN NOT used THEN 'MANUAL_REVIEW' WHEN claim_sk % 10 = 0 THEN 'REJECT' WHEN claim_sk % 5 = 1 THEN 'MANUAL_REVIEW' ELSE 'APPROVE' END AS recommended,
 CAST(CASE WHEN NOT used THEN 0 ELSE greatest(-30, least(40, (claim_sk * 7) % 101 - 50)) END AS INT) AS adj FROM vis0)
"""
TRACE_SQL = f"""
{HOPS_SQL}, tr0 AS (SELECT trace_id, count(*) AS points, sum(CASE WHEN km > 50 AND minutes < 10 THEN 1 ELSE 0 END)
 + sum(CASE WHEN kmh > 80 THEN 1 ELSE 0 END) + CASE WHEN count(DISTINCT round(lat, 4)) = 1 THEN 1 ELSE 0 END AS n FROM hops GROUP BY 1),
tr AS (SELECT trace_id, {sql_round("least(n * 0.35::DOUBLE, 1::DOUBLE)", 2)} AS conf FROM tr0 WHERE points >= 2 AND n > 0)
"""
LAYERS_SQL = f"""
{ACCOUNT_SQL}, {DAILY_SQL}, {NETWORK_SQL}, {VISION_SQL}, {TRACE_SQL},
wide AS (SELECT c.claim_sk, c.amount, c.trigger_type, c.reason, c.created_at, c.photo_submitted, a.* EXCLUDE (worker_id), a.worker_id,
  p.photo_ts, p.exif_stripped, {sql_haversine("z.lat", "z.lon", "p.gps_lat", "p.gps_lon")} AS photo_km, d.rain_mm_hr > 2 AS had_rain,
  c.photo_submitted AS has_vision, v.authentic, v.verdict, v.recommended, v.adj, tr.conf, n.prior_hour, n.zones_before, coalesce(n.others, 0) AS others,
  a.pincode IN ('560099', '400099', '110099') AS ghost, a.pincode = '999999' AS trap
 FROM claims c LEFT JOIN acct a USING (worker_id) LEFT JOIN claim_photos p USING (claim_sk) LEFT JOIN zone_coords z ON z.pincode = a.pincode
 LEFT JOIN daily d ON d.pincode = a.pincode AND d.day = CAST(c.created_at AS DATE) LEFT JOIN vis v USING (claim_sk)
 LEFT JOIN tr ON tr.trace_id = c.worker_id LEFT JOIN net n USING (claim_sk)),
marks AS (SELECT *, trigger_type IN ('heavy_rain','waterlogging','aqi_spike','cyclone_wind') AND NOT photo_submitted AS e_missing,
  photo_submitted AND coalesce(abs(epoch_us(created_at) - epoch_us(photo_ts)) / 1e6 / 3600 > 2, false) AS e_old, photo_submitted AND photo_ts IS NULL AS e_unread,
  photo_submitted AND exif_stripped AS e_exif, photo_submitted AND coalesce(photo_km > 25, false) AS e_far,
  photo_submitted AND trigger_type = 'heavy_rain' AND coalesce(NOT had_rain, false) AS e_dry,
  amount > avg_daily_earning * 0.90::DOUBLE AS r1, account_age_days < 14 AND amount > 300 AS r2, fraudulent_flags > 0 AS r3,
  coalesce(nullif(trust_score, 0), 50) < 35 AND amount > 500 AS r4, past_claims_count > 8 AS r5, ((hour(created_at) + 5) % 24) BETWEEN 2 AND 5 AS r6,
  amount > 100 AND amount % 500 = 0 AS r7, trigger_type = 'manual' AND amount > avg_daily_earning * 0.50::DOUBLE
   AND NOT regexp_matches(lower(reason), 'rain|aqi|flood|storm|curfew|strike|wind') AS r8, NOT has_delivery_history AND past_claims_count > 0 AS r9, others > 0 AS r10,
  coalesce(prior_hour > 8, false) AS n1, coalesce(zones_before > 3, false) AS n2, others > 0 AS n3 FROM wide),
pts AS (SELECT *, CASE WHEN e_missing THEN 40 ELSE least((CASE WHEN e_old THEN 25 ELSE 0 END) + (CASE WHEN e_unread THEN 10 ELSE 0 END)
   + (CASE WHEN e_exif THEN 20 ELSE 0 END) + (CASE WHEN e_far THEN 30 ELSE 0 END) + (CASE WHEN e_dry THEN 35 ELSE 0 END), 60) END AS e_pen,
  (CASE WHEN r1 THEN 20 ELSE 0 END) + (CASE WHEN r2 THEN 25 ELSE 0 END) + (CASE WHEN r3 THEN least(fraudulent_flags * 18, 54) ELSE 0 END)
   + (CASE WHEN r4 THEN 18 ELSE 0 END) + (CASE WHEN r5 THEN 12 ELSE 0 END) + (CASE WHEN r6 THEN 10 ELSE 0 END) + (CASE WHEN r7 THEN 8 ELSE 0 END)
   + (CASE WHEN r8 THEN 8 ELSE 0 END) + (CASE WHEN r9 THEN 22 ELSE 0 END) + (CASE WHEN r10 THEN 35 ELSE 0 END) AS rule_points,
  15 * ((CASE WHEN n1 THEN 1 ELSE 0 END) + (CASE WHEN n2 THEN 1 ELSE 0 END) + (CASE WHEN n3 THEN 1 ELSE 0 END)) AS network_points,
  CASE WHEN conf IS NULL THEN 0 ELSE CAST(trunc(conf * 40) AS INT) END AS gps_points, CASE WHEN ghost THEN 55 ELSE 0 END AS ghost_points,
  CAST(trunc(CASE WHEN integrity_score >= 50 THEN integrity_score * 0.5::DOUBLE ELSE integrity_score * 0.25::DOUBLE
   * CASE WHEN concat_ws('|', {account_flags_sql("")}) = '' THEN 0 ELSE 1 END END) AS INT) AS integrity_points FROM marks),
ev AS (SELECT *, NOT e_missing AND e_pen < 30 AND NOT e_far AND NOT e_dry AS e_valid FROM pts),
st AS (SELECT *, CASE WHEN NOT e_valid THEN e_pen ELSE CAST(trunc(e_pen * 0.5::DOUBLE) AS INT) END AS evidence_points FROM ev),
st2 AS (SELECT *, ghost_points + integrity_points + evidence_points AS before_vision FROM st),
st3 AS (SELECT *, CASE WHEN has_vision AND NOT authentic THEN before_vision + greatest(0, adj)
  WHEN has_vision AND verdict = 'VERIFIED' THEN greatest(0, before_vision + adj) ELSE before_vision END AS after_vision FROM st2),
st4 AS (SELECT *, least(least(after_vision + gps_points + rule_points, 100) + network_points, 100) AS rule_score FROM st3),
fin AS (SELECT *, CASE WHEN trap THEN 100::DOUBLE ELSE rule_score::DOUBLE END AS score, has_vision AND recommended = 'REJECT' AS veto FROM st4),
dec AS (SELECT *, CASE WHEN trap THEN 'CRITICAL' WHEN veto THEN 'HIGH' WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  NOT trap AND NOT veto AND score < 50 AS approved, CASE WHEN trap THEN 'REJECT — honeypot triggered' WHEN veto THEN 'REJECT — vision check'
  WHEN score >= 75 THEN 'REJECT — high confidence fraud' WHEN score >= 50 THEN 'HOLD — manual review required' WHEN score >= 25 THEN 'APPROVE with monitoring' ELSE 'APPROVE — clean' END AS action,
  CASE WHEN trap THEN 'HONEYPOT' ELSE concat_ws('|', CASE WHEN ghost THEN 'GHOST_ZONE' END, {account_flags_sql("[L0] ")},
   CASE WHEN e_missing THEN '[L4] NO_PHOTO' END, CASE WHEN e_old THEN '[L4] PHOTO_TIMESTAMP' END, CASE WHEN e_unread THEN '[L4] PHOTO_TIMESTAMP_INVALID' END,
   CASE WHEN e_exif THEN '[L4] EXIF_STRIPPED' END, CASE WHEN e_far THEN '[L4] PHOTO_GPS_MISMATCH' END, CASE WHEN e_dry THEN '[L4] WEATHER_MISMATCH' END,
   CASE WHEN has_vision AND NOT authentic THEN '[VISION] Verdict: ' || verdict WHEN has_vision AND verdict = 'VERIFIED' THEN '[VISION] Photo verified' END,
   CASE WHEN conf IS NOT NULL THEN '[GPS] SPOOFED' END, CASE WHEN r1 THEN 'HIGH_CLAIM_RATIO' END, CASE WHEN r2 THEN 'NEW_ACCOUNT_HIGH_CLAIM' END,
   CASE WHEN r3 THEN 'FRAUD_HISTORY' END, CASE WHEN r4 THEN 'LOW_SCORE_HIGH_CLAIM' END, CASE WHEN r5 THEN 'HIGH_FREQUENCY' END, CASE WHEN r6 THEN 'ODD_HOURS' END,
   CASE WHEN r7 THEN 'ROUND_AMOUNT' END, CASE WHEN r8 THEN 'REASON_MISMATCH' END, CASE WHEN r9 THEN 'CLAIM_WITHOUT_HISTORY' END, CASE WHEN r10 THEN 'DEVICE_FARM' END,
   CASE WHEN n1 THEN '[L2] ZONE_BURST' END, CASE WHEN n2 THEN '[L2] MULTI_ZONE' END, CASE WHEN n3 THEN '[L2] SHARED_DEVICE' END) END AS flags FROM fin),
lay AS (SELECT *, CASE WHEN trap THEN 'Layer 3 Proactive' ELSE coalesce(nullif(concat_ws('|', CASE WHEN contains(flags, '[L0]') THEN 'Layer 0 Account Integrity' END,
  CASE WHEN regexp_matches(flags, 'HIGH_CLAIM|NEW_ACCOUNT|FRAUD_HISTORY|LOW_SCORE|HIGH_FREQ|ODD_HOURS|ROUND|REASON|HISTORY|DEVICE_FARM') THEN 'Layer 1 Rules' END,
  CASE WHEN contains(flags, '[L2]') THEN 'Layer 2 Network Graph' END, CASE WHEN contains(flags, '[L4]') OR contains(flags, '[GPS]') OR contains(flags, '[VISION]') THEN 'Layer 4 Vision+Evidence' END), ''), 'None — clean') END AS layers FROM dec)
"""


def side_inputs(t):
    """Daily weather and trace verdicts, the two inputs that are themselves aggregates."""
    return matching.daily_weather(t.past_readings), signals.trace_verdict(signals.gps_hops(t.gps_pings))


def assembled(t, claims=None, network=None, sides=None, narrow=False):
    weather, traces = sides or side_inputs(t)
    return fraud.assemble(
        t.claims if claims is None else claims, t.workers, t.claim_photos, t.zone_coords, weather,
        parse_vision(t.vision_raw), traces, network, narrow)


@query("l1_rule_signals", f"""
WITH {LAYERS_SQL} SELECT claim_sk, CAST(rule_points AS INT) AS rule_points, concat_ws('|', CASE WHEN r1 THEN 'HIGH_CLAIM_RATIO' END, CASE WHEN r2 THEN 'NEW_ACCOUNT_HIGH_CLAIM' END,
   CASE WHEN r3 THEN 'FRAUD_HISTORY' END, CASE WHEN r4 THEN 'LOW_SCORE_HIGH_CLAIM' END, CASE WHEN r5 THEN 'HIGH_FREQUENCY' END, CASE WHEN r6 THEN 'ODD_HOURS' END,
   CASE WHEN r7 THEN 'ROUND_AMOUNT' END, CASE WHEN r8 THEN 'REASON_MISMATCH' END, CASE WHEN r9 THEN 'CLAIM_WITHOUT_HISTORY' END, CASE WHEN r10 THEN 'DEVICE_FARM' END) AS flags FROM pts
""")
def l1(t):
    return fraud.rule_signals(fraud.assemble(t.claims, t.workers)).select(
        "claim_sk", "rule_points", joined(F.col("rule_flags")).alias("flags"))


@query("l1b_honeypot_and_ghost", """
SELECT claim_sk, pincode IN ('999999','000001','111111','560000','000000') AS honeypot,
 CASE WHEN pincode IN ('560099','400099','110099') THEN 55 ELSE 0 END AS ghost_points FROM claims LEFT JOIN workers USING (worker_id)
""")
def l1b(t):
    return t.claims_with_zone.select("claim_sk", fraud.is_honeypot().alias("honeypot"),
                                     F.when(fraud.is_ghost(), 55).otherwise(0).alias("ghost_points"))


@query("l2_network_points", f"""
WITH {NETWORK_SQL} SELECT claim_sk, prior_hour, zones_before, CAST(others AS BIGINT) AS others_on_device,
 CAST(15 * ((CASE WHEN prior_hour > 8 THEN 1 ELSE 0 END) + (CASE WHEN zones_before > 3 THEN 1 ELSE 0 END) + (CASE WHEN others > 0 THEN 1 ELSE 0 END)) AS INT) AS network_points FROM net
""")
def l2(t):
    located = t.claims_with_zone.where("pincode is not null")
    return fraud.network_points(fraud.network_signals(located)).select(
        "claim_sk", "prior_hour", "zones_before", "others_on_device", "network_points")


@query("l3a_anomaly_features", """
SELECT claim_sk, least(amount / greatest(avg_daily_earning, 1), 1::DOUBLE) AS f_amount, hour(created_at) / 23::DOUBLE AS f_hour,
 (isodow(created_at) - 1) / 6::DOUBLE AS f_weekday, least(past_claims_count / 10::DOUBLE, 1::DOUBLE) AS f_claims,
 coalesce(nullif(trust_score, 0), 50) / 100::DOUBLE AS f_score, least(account_age_days / 365::DOUBLE, 1::DOUBLE) AS f_age
FROM claims JOIN workers USING (worker_id)
""")
def l3a(t):
    rows = t.claims.join(t.workers.select(*fraud.WORKER_COLUMNS), "worker_id")
    return fraud.ml_features(rows).select("claim_sk", *fraud.ML_FEATURES)


@query("l4_photo_evidence", f"""
WITH {LAYERS_SQL} SELECT claim_sk, e_valid AS evidence_valid, CAST(e_pen AS INT) AS evidence_penalty,
 CASE WHEN e_missing THEN 'REJECT_NO_EVIDENCE' WHEN NOT photo_submitted THEN 'NOT_REQUIRED' WHEN e_valid THEN 'PASS' ELSE 'SUSPECT' END AS evidence_verdict,
 trigger_type IN ('heavy_rain','waterlogging','aqi_spike','cyclone_wind') AS photo_required FROM ev
""")
def l4(t):
    rows = fraud.assemble(t.claims, t.workers, t.claim_photos, t.zone_coords, matching.daily_weather(t.past_readings))
    return fraud.photo_evidence(rows).select(
        "claim_sk", "evidence_valid", "evidence_penalty", "evidence_verdict", "photo_required")


@query("l4b_vision_adjustment", f"""
WITH {LAYERS_SQL} SELECT claim_sk, CAST(after_vision - before_vision AS INT) AS vision_points, veto,
 CASE verdict WHEN 'VERIFIED' THEN 'GENUINE CLAIM' WHEN 'SUSPICIOUS' THEN 'NEEDS REVIEW' WHEN 'REJECTED' THEN 'FAKE PHOTO' ELSE 'UNVERIFIED' END AS label FROM fin
""")
def l4b(t):
    return fraud.layer_points(assembled(t)).select(
        "claim_sk", "vision_points", (F.col("has_vision") & (F.col("recommended_action") == "REJECT")).alias("veto"),
        fraud.vision_label("verdict").alias("label"))


@query("l4c_photo_gate", """
SELECT claim_sk, CASE WHEN claim_sk % 4 = 0 THEN 'capture' WHEN claim_sk % 6 = 0 AND claim_sk % 5 = 0 THEN 'location'
 WHEN claim_sk % 7 <> 0 AND claim_sk % 10 = 0 THEN 'vision'
 WHEN claim_sk % 7 <> 0 AND (claim_sk % 11 = 0 OR claim_sk % 17 = 0 OR claim_sk % 19 = 0) THEN 'fake photo' END AS stopped_by FROM claims
""")
def l4c(t):
    return fraud.photo_gate(t.claim_photos.join(parse_vision(t.vision_raw), "claim_sk")).select("claim_sk", "stopped_by")


@query("l4d_rule_score", f"""
WITH {LAYERS_SQL} SELECT claim_sk, ghost_points, integrity_points, CAST(evidence_points AS INT) AS evidence_points, gps_points, CAST(rule_score AS INT) AS rule_score FROM st4
""")
def l4d(t):
    return fraud.layer_points(assembled(t)).select(
        "claim_sk", "ghost_points", "integrity_points", "evidence_points", "gps_points", "rule_score")


@query("l5_combined_decision", f"WITH {LAYERS_SQL} SELECT claim_sk, score, risk_level, approved, action FROM dec")
def l5(t):
    return fraud.combine(fraud.layer_points(assembled(t))).select("claim_sk", "score", "risk_level", "approved", "action")


@query("l6_layers_and_flags", f"WITH {LAYERS_SQL} SELECT claim_sk, flags, layers FROM lay")
def l6(t):
    return fraud.with_flags(fraud.combine(fraud.layer_points(assembled(t)))).select(
        "claim_sk", joined(F.col("flags")).alias("flags"), joined(F.col("layers")).alias("layers"))


@query("l7_scored_claims", f"""
WITH {LAYERS_SQL} SELECT claim_sk, score, risk_level, approved, action, flags, layers,
 CASE WHEN NOT trap THEN integrity_points::DOUBLE END AS layer0_score, CASE WHEN NOT trap THEN rule_points::DOUBLE END AS layer1_score,
 CASE WHEN NOT trap THEN network_points::DOUBLE END AS layer2_score, CAST(NULL AS DOUBLE) AS layer3_score,
 CASE WHEN NOT trap THEN (evidence_points + after_vision - before_vision + gps_points)::DOUBLE END AS layer4_score FROM lay
""")
def l7(t):
    scored = fraud.score_claims(assembled(t))
    return scored.select(
        "claim_sk", "score", "risk_level", "approved", "action", joined(F.col("flags")).alias("flags"),
        joined(F.col("layers")).alias("layers"), *[f"layer{i}_score" for i in range(5)])
