"""Fraud layers as column expressions over one wide claim row.

``assemble`` joins a claim with everything the layers look at; each layer then
adds its points and flags. Order matters where a floor or a cap sits between two
layers, so ``score`` applies them in the domain's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.constants import DISRUPTION_WORDS, GHOST_PINCODES, HONEYPOT_PINCODES, PAN_PATTERN, PHOTO_TRIGGERS
from parasol.functions.collections import flag_list
from parasol.functions.geo import haversine_km
from parasol.functions.numeric import as_col, clip, round_to, truthy_or
from parasol.functions.temporal import day_text, is_odd_hour, seconds_between
from parasol.functions.text import mentions_any
from parasol.operators import signals
from parasol.session import materialized

WORKER_COLUMNS = [
    "worker_id", "worker_name", "pincode", "plan", "pan_number", "pan_verified", "platforms_csv",
    "total_deliveries", "has_delivery_history", "account_age_days", "avg_daily_earning",
    "past_claims_count", "fraudulent_flags", "trust_score",
]


def account_integrity(workers: DataFrame) -> DataFrame:
    """Add integrity_score, integrity_flags, history_ok and passes_gate."""
    c = F.col
    pan = F.coalesce(c("pan_number"), F.lit(""))
    bad_pan = ~F.upper(pan).rlike(PAN_PATTERN)
    verified = F.coalesce(c("pan_verified"), F.lit(False))
    history = F.coalesce(c("has_delivery_history"), F.lit(False))
    rides = F.coalesce(c("total_deliveries"), F.lit(0))
    age = F.coalesce(c("account_age_days"), F.lit(0))
    claimed = F.coalesce(c("past_claims_count"), F.lit(0)) > 0
    unlinked = F.coalesce(c("platforms_csv"), F.lit("")) == ""
    instant = (age < 3) & claimed
    pan_points = F.when(pan == "", 45).when(~verified, 25).when(bad_pan, 35).otherwise(0)
    with_history = (
        F.when(~history, pan_points + 30).when(rides < 5, pan_points + 15)
        .when(rides >= 50, F.greatest(pan_points - 10, F.lit(0))).otherwise(pan_points))
    points = with_history + F.when(instant, 50).when(age < 7, 20).otherwise(0) + F.when(unlinked, 20).otherwise(0)
    score = F.least(points, F.lit(100))
    flags = flag_list(
        (pan == "", "NO_PAN"), ((pan != "") & ~verified, "PAN_UNVERIFIED"),
        ((pan != "") & verified & bad_pan, "PAN_INVALID"),
        (~history, "NO_DELIVERY_HISTORY"), (history & (rides < 5), "SPARSE_HISTORY"),
        (instant, "INSTANT_CLAIM"), (~instant & (age < 7), "VERY_NEW_ACCOUNT"), (unlinked, "NO_PLATFORM_LINK"))
    return workers.withColumns({
        "integrity_score": score, "integrity_flags": flags,
        "history_ok": history & (rides >= 5), "passes_gate": score < 50})


def photo_evidence(claims: DataFrame) -> DataFrame:
    """Add evidence_* columns from the photo's metadata, place and the day's weather.

    Needs trigger_type, photo_submitted, has_photo_meta, photo_ts, exif_stripped,
    photo_km (null where unknown), had_rain (null where unrecorded), created_at.
    """
    c = F.col
    trigger = F.coalesce(c("trigger_type"), F.lit("manual"))
    required = trigger.isin(PHOTO_TRIGGERS)
    submitted = F.coalesce(c("photo_submitted"), F.lit(False))
    meta = submitted & F.coalesce(c("has_photo_meta"), F.lit(False))
    hours = F.abs(seconds_between("created_at", "photo_ts")) / 3600.0
    old = meta & F.coalesce(hours > 2, F.lit(False))
    unreadable = meta & c("photo_ts").isNull()
    stripped = meta & F.coalesce(c("exif_stripped"), F.lit(False))
    far = meta & F.coalesce(c("photo_km") > 25, F.lit(False))
    dry = meta & (trigger == "heavy_rain") & F.coalesce(~c("had_rain"), F.lit(False))
    missing = required & ~submitted

    def pts(cond, n):
        return F.when(cond, n).otherwise(0)

    penalty = F.when(missing, 40).otherwise(F.least(
        pts(old, 25) + pts(unreadable, 10) + pts(stripped, 20) + pts(far, 30) + pts(dry, 35), F.lit(60)))
    valid = ~missing & (penalty < 30) & ~far & ~dry
    flags = flag_list(
        (missing, "NO_PHOTO"), (old, "PHOTO_TIMESTAMP"), (unreadable, "PHOTO_TIMESTAMP_INVALID"),
        (stripped, "EXIF_STRIPPED"), (far, "PHOTO_GPS_MISMATCH"), (dry, "WEATHER_MISMATCH"))
    return claims.withColumns({
        "evidence_valid": valid, "evidence_penalty": penalty, "evidence_flags": flags,
        "evidence_verdict": F.when(missing, "REJECT_NO_EVIDENCE").when(~submitted, "NOT_REQUIRED")
        .when(valid, "PASS").otherwise("SUSPECT"),
        "photo_required": required})


def vision_label(verdict) -> Column:
    v = as_col(verdict)
    return (F.when(v == "VERIFIED", "GENUINE CLAIM").when(v == "SUSPICIOUS", "NEEDS REVIEW")
            .when(v == "REJECTED", "FAKE PHOTO").otherwise("UNVERIFIED"))


def photo_gate(df: DataFrame) -> DataFrame:
    """Why a photo claim is stopped before scoring, null when it passes."""
    c = F.col
    return df.withColumn("stopped_by", F.when(
        c("capture_type").isNotNull() & (c("capture_type") != "camera_only"), "capture")
        .when(c("require_location") & c("gps_lat").isNull(), "location")
        .when(c("vision_used") & (c("recommended_action") == "REJECT"), "vision")
        .when(c("vision_used") & (c("is_stock_photo") | c("is_screenshot") | c("is_ai_generated")), "fake photo"))


def rule_signals(claims: DataFrame) -> DataFrame:
    """Add rule_points and rule_flags: ten signals on amount, account, time and device."""
    c = F.col
    earning = F.coalesce(c("avg_daily_earning"), F.lit(500.0))
    score = truthy_or("trust_score", 50.0)
    age = F.coalesce(c("account_age_days"), F.lit(0))
    past = F.coalesce(c("past_claims_count"), F.lit(0))
    flagged = F.coalesce(c("fraudulent_flags"), F.lit(0))
    amount = c("amount")
    vague = ~mentions_any(F.coalesce("reason", F.lit("")), DISRUPTION_WORDS)
    rules = [
        (amount > earning * 0.90, "HIGH_CLAIM_RATIO", F.lit(20)),
        ((age < 14) & (amount > 300), "NEW_ACCOUNT_HIGH_CLAIM", F.lit(25)),
        (flagged > 0, "FRAUD_HISTORY", F.least(flagged * 18, F.lit(54))),
        ((score < 35) & (amount > 500), "LOW_SCORE_HIGH_CLAIM", F.lit(18)),
        (past > 8, "HIGH_FREQUENCY", F.lit(12)),
        (is_odd_hour("created_at"), "ODD_HOURS", F.lit(10)),
        ((amount > 100) & (amount % 500 == 0), "ROUND_AMOUNT", F.lit(8)),
        ((c("trigger_type") == "manual") & (amount > earning * 0.50) & vague, "REASON_MISMATCH", F.lit(8)),
        (~F.coalesce("has_delivery_history", F.lit(False)) & (past > 0), "CLAIM_WITHOUT_HISTORY", F.lit(22)),
        (F.coalesce("others_on_device", F.lit(0)) > 0, "DEVICE_FARM", F.lit(35)),
    ]
    points = sum((F.when(cond, n).otherwise(0) for cond, _, n in rules), F.lit(0))
    return claims.withColumns({
        "rule_points": points, "rule_flags": flag_list(*[(cond, name) for cond, name, _ in rules])})


def network_signals(claims: DataFrame) -> DataFrame:
    """(claim_sk, prior_hour, zones_before, others_on_device) for claims outside trap zones.

    Claims from trap pincodes are blocked before they enter the history. The
    five columns the signals read are written once, since each signal scans
    them more than once.
    """
    known = materialized(
        claims.where(~F.col("pincode").isin(HONEYPOT_PINCODES)).select(
            "claim_sk", "worker_id", "device_id", "pincode", "created_at"), "network")
    burst = signals.zone_burst(known, "pincode", "created_at", "claim_sk")
    zones = signals.zones_before(known, "worker_id", "pincode", "created_at", "claim_sk")
    device = signals.others_on_device(known, "device_id", "worker_id", "created_at", "claim_sk")
    return burst.join(zones, "claim_sk").join(
        device.withColumnRenamed("others", "others_on_device"), "claim_sk", "left")


def network_points(df: DataFrame) -> DataFrame:
    flags = flag_list(
        (F.col("prior_hour") > signals.BURST_CLAIMS, "ZONE_BURST"),
        (F.col("zones_before") > signals.MULTI_ZONES, "MULTI_ZONE"),
        (F.col("others_on_device") > 0, "SHARED_DEVICE"))
    return df.withColumn("network_flags", flags).withColumn("network_points", F.size("network_flags") * 15)


def ml_features(df: DataFrame) -> DataFrame:
    """Add the six anomaly features, each in [0, 1]."""
    c = F.col
    earning = F.coalesce(c("avg_daily_earning"), F.lit(500.0))
    return df.withColumns({
        "f_amount": F.least(c("amount") / F.greatest(earning, F.lit(1.0)), F.lit(1.0)),
        "f_hour": F.hour("created_at") / 23.0,
        "f_weekday": F.weekday("created_at") / 6.0,
        "f_claims": F.least(F.coalesce("past_claims_count", F.lit(0)) / 10.0, F.lit(1.0)),
        "f_score": truthy_or("trust_score", 50.0) / 100.0,
        "f_age": F.least(F.coalesce("account_age_days", F.lit(0)) / 365.0, F.lit(1.0)),
    })


ML_FEATURES = ["f_amount", "f_hour", "f_weekday", "f_claims", "f_score", "f_age"]


def assemble(claims: DataFrame, workers: DataFrame, photos: DataFrame | None = None,
             coords: DataFrame | None = None, weather: DataFrame | None = None,
             vision: DataFrame | None = None, traces: DataFrame | None = None,
             network: DataFrame | None = None, narrow: bool = False) -> DataFrame:
    """One wide row per claim with everything the layers read; absent inputs are null.

    ``network`` holds precomputed history signals (a stream brings its own);
    otherwise they are computed over ``claims`` itself. ``narrow`` cuts every
    input to the keys of ``claims`` first: a micro-batch is small, so its keys
    can be broadcast and the large inputs are filtered where they are read,
    which an outer join against them would not allow.
    """
    if narrow:
        ids, owners = claims.select("claim_sk"), claims.select("worker_id").distinct()
        days = claims.select(day_text("created_at").alias("day")).distinct()
        workers = workers.join(owners, "worker_id", "left_semi")
        photos = photos if photos is None else photos.join(ids, "claim_sk", "left_semi")
        vision = vision if vision is None else vision.join(ids, "claim_sk", "left_semi")
        weather = weather if weather is None else weather.join(days, "day", "left_semi")
        traces = traces if traces is None else traces.join(
            owners.withColumnRenamed("worker_id", "trace_id"), "trace_id", "left_semi")
    if network is None:
        located = claims.join(workers.select("worker_id", "pincode"), "worker_id")
        network = network_signals(located)
    # Joins on one key stand together, so that wide claim rows are shuffled once per key.
    rows = claims.join(network, "claim_sk", "left")
    if photos is not None:
        meta = photos.select("claim_sk", "photo_ts", "exif_stripped", "gps_lat", "gps_lon",
                             F.lit(True).alias("has_photo_meta"))
        rows = rows.join(meta, "claim_sk", "left")
    if vision is not None:
        rows = rows.join(vision.select("claim_sk", "authentic", "verdict", "recommended_action", "score_adjustment",
                                       "vision_used"), "claim_sk", "left")
    account = account_integrity(workers.select(*WORKER_COLUMNS))
    if traces is not None:
        account = account.join(traces.where("spoofed").select(
            F.col("trace_id").alias("worker_id"), F.col("confidence").alias("gps_confidence"),
            F.lit(True).alias("gps_spoofed")), "worker_id", "left")
    rows = rows.join(account, "worker_id", "left")
    if weather is not None:
        rows = rows.withColumn("day", day_text("created_at")).join(
            weather.select("pincode", "day", "had_rain"), ["pincode", "day"], "left")
    if photos is not None:
        known = coords.select("pincode", "lat", "lon")
        rows = rows.join(known, "pincode", "left")
    have = set(rows.columns)

    def given(name, kind, default=None):
        value = F.col(name) if name in have else F.lit(None)
        value = value.cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default))

    distance = haversine_km("lat", "lon", "gps_lat", "gps_lon") if photos is not None else F.lit(None).cast("double")
    return rows.withColumns({
        "photo_km": distance,
        "photo_ts": given("photo_ts", "timestamp_ntz"), "exif_stripped": given("exif_stripped", "boolean", False),
        "has_photo_meta": given("has_photo_meta", "boolean", False), "had_rain": given("had_rain", "boolean"),
        "authentic": given("authentic", "boolean", True), "verdict": given("verdict", "string"),
        "recommended_action": given("recommended_action", "string"),
        "score_adjustment": given("score_adjustment", "int", 0),
        "has_vision": F.coalesce(F.col("photo_submitted") & given("vision_used", "boolean").isNotNull(), F.lit(False)),
        "gps_confidence": given("gps_confidence", "double", 0.0), "gps_spoofed": given("gps_spoofed", "boolean", False),
    })


def is_honeypot(pincode="pincode") -> Column:
    return F.coalesce(as_col(pincode).isin(HONEYPOT_PINCODES), F.lit(False))


def is_ghost(pincode="pincode") -> Column:
    return F.coalesce(as_col(pincode).isin(GHOST_PINCODES), F.lit(False))


def layer_points(rows: DataFrame) -> DataFrame:
    """Add every layer's points and the rule score built from them in order."""
    c = F.col
    df = network_points(rule_signals(photo_evidence(rows)))
    score0 = F.coalesce(c("integrity_score"), F.lit(0))
    listed = F.coalesce(F.size("integrity_flags"), F.lit(0)) > 0
    df = df.withColumns({
        "ghost_points": F.when(is_ghost(), 55).otherwise(0),
        "integrity_points": F.when(~c("passes_gate"), (score0 * 0.5).cast("int"))
        .when(listed, (score0 * 0.25).cast("int")).otherwise(0),
        "evidence_points": F.when(~c("evidence_valid"), c("evidence_penalty"))
        .otherwise((c("evidence_penalty") * 0.5).cast("int")),
        "gps_points": F.when(c("gps_spoofed"), (c("gps_confidence") * 40.0).cast("int")).otherwise(0),
    })
    before = c("ghost_points") + c("integrity_points") + c("evidence_points")
    # An authentic, verified photo may lower the score, but not below zero.
    seen = (
        F.when(c("has_vision") & ~c("authentic"), before + F.greatest(F.lit(0), c("score_adjustment")))
        .when(c("has_vision") & (c("verdict") == "VERIFIED"), F.greatest(F.lit(0), before + c("score_adjustment")))
        .otherwise(before))
    df = df.withColumn("evidence_score", seen).withColumn(
        "vision_points", c("evidence_score") - before)
    ruled = F.least(c("evidence_score") + c("gps_points") + c("rule_points"), F.lit(100))
    return df.withColumn("rule_score", F.least(ruled + c("network_points"), F.lit(100)))


def combine(df: DataFrame, ml_score: str | None = None) -> DataFrame:
    """Final score, level, decision and action; trap zones and the vision veto override."""
    c = F.col
    trap = is_honeypot()
    blended = c("rule_score").cast("double")
    if ml_score:
        blended = F.when(c(ml_score).isNull(), blended).otherwise(
            round_to(c("rule_score") * 0.65 + c(ml_score) * 0.35, 1))
    df = df.withColumn("score", F.when(trap, 100.0).otherwise(clip(blended, 0.0, 100.0)))
    s = c("score")
    veto = c("has_vision") & F.coalesce(c("recommended_action") == "REJECT", F.lit(False))
    return df.withColumns({
        "risk_level": F.when(trap, "CRITICAL").when(veto, "HIGH").when(s >= 75, "CRITICAL").when(s >= 50, "HIGH")
        .when(s >= 25, "MEDIUM").otherwise("LOW"),
        "approved": ~trap & ~veto & (s < 50),
        "action": F.when(trap, "REJECT — honeypot triggered").when(veto, "REJECT — vision check")
        .when(s >= 75, "REJECT — high confidence fraud").when(s >= 50, "HOLD — manual review required")
        .when(s >= 25, "APPROVE with monitoring").otherwise("APPROVE — clean"),
    })


# Parts of flag names that mark the rule layer as triggered.
RULE_MARKS = ["HIGH_CLAIM", "NEW_ACCOUNT", "FRAUD_HISTORY", "LOW_SCORE", "HIGH_FREQ", "ODD_HOURS", "ROUND",
              "REASON", "HISTORY", "DEVICE_FARM"]


def _tagged(tag: str, flags) -> Column:
    return F.transform(as_col(flags), lambda f: F.concat(F.lit(tag + " "), f))


def with_flags(df: DataFrame, ml_anomaly: str | None = None) -> DataFrame:
    """Add the ordered flag list and the layers it stands for."""
    c = F.col
    none = F.array().cast("array<string>")
    vision = F.when(c("has_vision") & ~c("authentic"), F.array(F.concat(F.lit("[VISION] Verdict: "), c("verdict")))) \
        .when(c("has_vision") & (c("verdict") == "VERIFIED"), F.array(F.lit("[VISION] Photo verified"))).otherwise(none)
    flags = F.concat(
        F.when(is_ghost(), F.array(F.lit("GHOST_ZONE"))).otherwise(none),
        F.coalesce(_tagged("[L0]", "integrity_flags"), none), _tagged("[L4]", "evidence_flags"), vision,
        F.when(c("gps_spoofed"), F.array(F.lit("[GPS] SPOOFED"))).otherwise(none),
        c("rule_flags"), _tagged("[L2]", "network_flags"))
    df = df.withColumn("flags", F.when(is_honeypot(), F.array(F.lit("HONEYPOT"))).otherwise(flags))
    text = F.array_join("flags", " ")
    anomaly = F.coalesce(c(ml_anomaly), F.lit(False)) if ml_anomaly else F.lit(False)
    layers = flag_list(
        (text.contains("[L0]"), "Layer 0 Account Integrity"), (text.rlike("|".join(RULE_MARKS)), "Layer 1 Rules"),
        (text.contains("[L2]"), "Layer 2 Network Graph"), (anomaly, "Layer 3 Isolation Forest"),
        (text.rlike(r"\[L4\]|\[GPS\]|\[VISION\]"), "Layer 4 Vision+Evidence"))
    return df.withColumn("layers", F.when(is_honeypot(), F.array(F.lit("Layer 3 Proactive")))
                         .when(F.size(layers) == 0, F.array(F.lit("None — clean"))).otherwise(layers))


def score_claims(rows: DataFrame, ml_score: str | None = None, ml_anomaly: str | None = None) -> DataFrame:
    """All layers over assembled rows, with per-layer scores for the claim fact."""
    c = F.col
    scored = with_flags(combine(layer_points(rows), ml_score), ml_anomaly)
    trap = is_honeypot()

    def unless_trap(value):
        return F.when(~trap, value.cast("double"))

    return scored.withColumns({
        "layer0_score": unless_trap(c("integrity_points")), "layer1_score": unless_trap(c("rule_points")),
        "layer2_score": unless_trap(c("network_points")),
        "layer3_score": unless_trap(c(ml_score)) if ml_score else F.lit(None).cast("double"),
        "layer4_score": unless_trap(c("evidence_points") + c("vision_points") + c("gps_points")),
    })


