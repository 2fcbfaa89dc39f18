"""Trust score, grades and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.constants import DEFAULT_ZONE, GRADES
from parasol.functions.collections import flag_list
from parasol.functions.numeric import as_col, clip, round_to, truthy_or


def score_label(score) -> Column:
    s = as_col(score)
    return F.when(s >= 82, "Excellent").when(s >= 68, "Good").when(s >= 52, "Fair").otherwise("Building")


def seed_risk_level(score) -> Column:
    """Risk label the seed loader gives a stored fraud score (critical from 70)."""
    s = as_col(score)
    return F.when(s < 25, "LOW").when(s < 50, "MEDIUM").when(s < 70, "HIGH").otherwise("CRITICAL")


def _graded(score, position: int) -> Column:
    s = as_col(score)
    out = F.lit(GRADES[-1][position])
    for row in reversed(GRADES[:-1]):
        out = F.when(s >= row[0], F.lit(row[position])).otherwise(out)
    return out


def grade(score) -> Column:
    return _graded(score, 1)


def payout_speed(score) -> Column:
    return _graded(score, 2)


def recommendation(score) -> Column:
    return _graded(score, 3)


def premium_modifier(score) -> Column:
    """4% off per ten points above 50, 5% on per ten below, between 0.65 and 1.40."""
    s = as_col(score)
    above = F.lit(1.0) - ((s - 50.0) / 10.0) * 0.04
    below = F.lit(1.0) + ((F.lit(50.0) - s) / 10.0) * 0.05
    return round_to(clip(F.when(s >= 50, above).otherwise(below), 0.65, 1.40), 3)


def with_zone_profile(df: DataFrame, zone_risk: DataFrame) -> DataFrame:
    """Left join of the pincode's risk profile, each missing value defaulted."""
    defaults = [F.coalesce(c, F.lit(d)).alias(c) for c, d in DEFAULT_ZONE.items()]
    return df.join(zone_risk, "pincode", "left").select(*df.columns, *defaults)


def _age_capped(score: Column, age) -> Column:
    age = as_col(age)
    return (
        F.when(age < 21, F.least(score, F.lit(65.0))).when(age < 60, F.least(score, F.lit(80.0)))
        .otherwise(score)
    )


def _zone_inverse() -> Column:
    weekly = F.col("disruption_days_per_year") / 52.0
    return clip(F.lit(100.0) - weekly * 80.0 - F.col("flood_frequency") * 20.0, 20.0, 100.0)


def simple_trust_score() -> Column:
    """Trust score of a zoned worker row from four weighted parts."""
    delivery = F.col("delivery_consistency") * 100.0
    location = F.col("location_honesty") * 100.0
    penalty = F.least(F.col("fraudulent_flags") * 25, F.lit(100))
    streak = F.least(F.col("claim_free_weeks") * 2, F.lit(15))
    claims = clip(F.col("claim_history_score") * 100.0 - penalty + streak, 0.0, 100.0)
    total = delivery * 0.30 + location * 0.25 + claims * 0.25 + _zone_inverse() * 0.20
    return round_to(_age_capped(clip(total, 0.0, 100.0), "account_age_days"), 1)


def full_trust_score(df: DataFrame) -> DataFrame:
    """Trust score from all sixteen signals, with sub-scores, strengths and flags.

    Input columns: active_days, deliveries_per_day, streak_days, tenure_days,
    gps_consistency, zone_adherence, tower_match, total_claims, approved_claims,
    fraudulent_flags, claim_free_weeks, false_positives, disruption_days_per_year,
    flood_frequency, behaviour (nullable), pan_verified, account_age_days.
    """
    c = F.col
    active = F.least(c("active_days") / 22.0, F.lit(1.0))
    delivery = (
        active * 0.40 + F.least(c("deliveries_per_day") / 20.0, F.lit(1.0)) * 0.30
        + F.least(c("streak_days") / 14.0, F.lit(1.0)) * 0.15
        + F.least(c("tenure_days") / 180.0, F.lit(1.0)) * 0.15
    ) * 100.0
    gate = F.when(c("pan_verified"), 1.0).otherwise(0.40)
    located = (c("gps_consistency") * 0.35 + c("zone_adherence") * 0.35 + c("tower_match") * 0.30) * gate * 100.0
    location = F.when(c("behaviour").isNull(), located).otherwise(
        clip(located + (c("behaviour") - 0.5) * 10.0, 0.0, 100.0))
    none_yet = c("total_claims") == 0
    approval = F.when(none_yet, 1.0).otherwise(
        clip((c("approved_claims") - c("false_positives")) / F.greatest(c("total_claims"), F.lit(1)), 0.0, 1.0))
    trust = F.when(none_yet, 0.85).otherwise(
        approval * (F.lit(1.0) - F.least(c("fraudulent_flags") * 0.25, F.lit(1.0))))
    claims = clip((trust + F.least(c("claim_free_weeks") * 0.02, F.lit(0.15))) * 100.0, 0.0, 100.0)
    scored = df.select(
        "*", active.alias("_active"), approval.alias("_approval"), delivery.alias("_c1"),
        location.alias("_c2"), claims.alias("_c3"), _zone_inverse().alias("_c4"))
    total = clip(c("_c1") * 0.30 + c("_c2") * 0.25 + c("_c3") * 0.25 + c("_c4") * 0.20, 0.0, 100.0)
    scored = scored.withColumn("_total", _age_capped(total, "account_age_days"))
    strengths = flag_list(
        (c("_active") > 0.85, F.concat(F.lit("Works "), c("active_days").cast("string"), F.lit("/30 days consistently"))),
        (c("streak_days") >= 7, F.concat(c("streak_days").cast("string"), F.lit("-day delivery streak"))),
        (c("tower_match") > 0.90, "Location signals consistent across GPS and cell tower"),
        (F.coalesce(c("behaviour") > 0.85, F.lit(False)), "Behavioral biometrics consistent (trusted device)"),
        (c("claim_free_weeks") >= 4, F.concat(c("claim_free_weeks").cast("string"), F.lit("-week claim-free streak"))),
        ((c("total_claims") > 0) & (c("_approval") > 0.95),
         F.concat(F.lit("Clean claim history ("), c("approved_claims").cast("string"), F.lit("/"),
                  c("total_claims").cast("string"), F.lit(" approved)"))),
        (c("flood_frequency") < 0.2, "Low flood-risk zone"),
    )
    flags = flag_list(
        (c("_active") < 0.50, "Low activity in last 30 days"),
        (~c("pan_verified"), "PAN not verified — location honesty capped"),
        (c("zone_adherence") < 0.70, "Frequently operates outside registered zone"),
        (c("fraudulent_flags") > 0, F.concat(c("fraudulent_flags").cast("string"), F.lit(" fraud flag(s) on record"))),
        (c("flood_frequency") > 0.7, "High flood-risk zone — premium adjusted accordingly"),
        (c("account_age_days") < 21, "New account — score capped at 65 until 21-day mark"),
    )
    kept = [n for n in df.columns]
    return scored.select(
        *kept, round_to("_total", 1).alias("total_score"), grade("_total").alias("grade"),
        payout_speed("_total").alias("payout_speed"), premium_modifier("_total").alias("premium_modifier"),
        round_to("_c1", 1).alias("delivery_score"), round_to("_c2", 1).alias("location_score"),
        round_to("_c3", 1).alias("claim_score"), round_to("_c4", 1).alias("zone_score"),
        strengths.alias("strengths"), flags.alias("flags"), recommendation("_total").alias("recommendation"))


# Routing cut-offs (lowest score, status, payout speed, note) per profile.
ROUTING = {
    "trigger": [
        (85, "approved", "Instant", "Auto-approved by trigger"),
        (62, "approved", "2hr auto", "Auto-approved by trigger"),
        (50, "approved", "6hr hold", "Auto-approved by trigger"),
        (None, "approved", "24hr review", "Auto-approved by trigger"),
    ],
    "consumer": [
        (85, "approved", "Instant", "Auto-approved — grade A+"),
        (75, "approved", "2hr auto", "Auto-approved — grade A"),
        (50, "approved", "6hr hold", "Auto-approved — grade B"),
        (None, "pending_review", "24hr review", "Manual review — grade C/D"),
    ],
    "manual": [
        (85, "approved", "Instant", "Auto-approved — grade A/A+"),
        (75, "approved", "2hr auto", "Auto-approved — grade A/A+"),
        (50, "approved", "6hr hold", "Auto-approved — grade B/B+, 6hr processing"),
        (None, "pending_review", "24hr review", "Manual review required — grade C/D"),
    ],
}


def route(score, profile: str) -> Column:
    """struct(status, payout_speed, review_note) for a trust score.

    A null score counts as 50; a zero does too, except for manual claims.
    """
    s = F.coalesce(as_col(score), F.lit(50.0)) if profile == "manual" else truthy_or(score, 50.0)

    def outcome(row):
        return F.struct(F.lit(row[1]).alias("status"), F.lit(row[2]).alias("payout_speed"),
                        F.lit(row[3]).alias("review_note"))

    rows = ROUTING[profile]
    out = outcome(rows[-1])
    for row in reversed(rows[:-1]):
        out = F.when(s >= row[0], outcome(row)).otherwise(out)
    return out
