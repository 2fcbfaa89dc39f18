"""Golden cases and cut-off boundaries of scoring, pricing, triggers and fraud."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parasol.functions import numeric as num, temporal as tm, text as tx
from parasol.operators import documents as docs, fraud, pricing, scoring, signals, triggers, warehouse as wh
from parasol.sources import feeds, files

NOON = dt.datetime(2026, 8, 1, 14, 30)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_date_key_and_monday_first(spark):
    got = values(spark, [(NOON,)], "ts timestamp_ntz", tm.date_key("ts"), *tm.date_attributes("ts"))
    assert got == [(20260801, 20260801, "2026-08-01", "Sat", 6, 8, "Aug", 3, 2026, True, True)]


def test_risk_segments(spark):
    got = values(spark, [(90.0,), (75.0,), (55.0,), (30.0,)], "s double", wh.risk_segment("s"))
    assert [g[0] for g in got] == ["LOW", "MEDIUM", "HIGH", "VERY_HIGH"]


def test_flatten_fills_missing_fields(spark):
    schema = ("worker_id bigint, name string, pincode string, plan string, pan_number string, pan_verified boolean, "
              "policy_paused boolean, platform_links array<string>, "
              "delivery_profile struct<total_deliveries:int,has_delivery_history:boolean,account_age_days:int,"
              "delivery_consistency:double,avg_daily_earning:double>, risk_profile struct<claim_free_weeks:int,"
              "past_claims_count:int,location_honesty:double,claim_history_score:double,fraudulent_flags:int,trust_score:double>")
    row = (1, "Alice", "560034", "pro", None, None, False, None, (None, None, 200, None, 800.0),
           (None, None, None, None, 0, 88.5))
    flat = docs.flatten_worker(spark.createDataFrame([row], schema)).first().asDict()
    assert flat["avg_daily_earning"] == 800.0 and flat["account_age_days"] == 200 and flat["trust_score"] == 88.5
    assert flat["delivery_consistency"] == 0.80 and flat["location_honesty"] == 0.85 and flat["platform_links"] == []
    assert flat["pan_verified"] is False and flat["total_deliveries"] == 0


@pytest.mark.parametrize("score,grade", [(85.0, "A+"), (84.9, "A"), (75.0, "A"), (74.9, "B+"), (62.0, "B+"), (61.9, "B"),
                                         (50.0, "B"), (49.9, "C"), (35.0, "C"), (34.9, "D")])
def test_grades(spark, score, grade):
    assert values(spark, [(score,)], "s double", scoring.grade("s")) == [(grade,)]


def test_routing_profiles_differ(spark):
    rows = [(85.0,), (75.0,), (62.0,), (50.0,), (49.9,), (0.0,), (None,)]
    cols = [scoring.route("s", p) for p in ("trigger", "consumer", "manual")]
    got = [[(c.status, c.payout_speed) for c in r] for r in values(spark, rows, "s double", *cols)]
    assert got[2] == [("approved", "2hr auto"), ("approved", "6hr hold"), ("approved", "6hr hold")]
    assert got[4] == [("approved", "24hr review"), ("pending_review", "24hr review"), ("pending_review", "24hr review")]
    # A zero counts as missing, except for manual claims.
    assert got[5] == [("approved", "6hr hold"), ("approved", "6hr hold"), ("pending_review", "24hr review")]
    assert got[6] == [("approved", "6hr hold"), ("approved", "6hr hold"), ("approved", "6hr hold")]


def test_null_is_not_clipped_to_the_bound(spark):
    assert values(spark, [(None,), (200.0,)], "x double", num.clip("x", 0.0, 100.0)) == [(None,), (100.0,)]


def test_rounding_half_up_and_half_even(spark):
    got = values(spark, [(2.5, 1.005), (3.5, 0.125)], "a double, b double", num.round_even("a"), num.round_to("b", 2))
    assert got == [(2.0, 1.0), (4.0, 0.13)]


READING = "rain_mm_hr double, duration_min int, aqi int, wind_kmh double, gust_kmh double, curfew_active boolean, waterlogging_score double"


@pytest.mark.parametrize("reading,fired", [
    ((7.5, 90, 150, 60.0, 80.0, False, 0.65), []),
    ((7.6, 45, 150, 0.0, 0.0, False, 0.5), []),
    ((7.6, 46, 150, 0.0, 0.0, False, 0.7), ["heavy_rain"]),  # waterlogging stands back
    ((6.1, 10, 150, 0.0, 0.0, False, 0.66), ["waterlogging"]),
    ((6.0, 10, 151, 0.0, 0.0, False, 0.66), ["aqi_spike"]),
    ((0.0, 0, 0, 60.1, 0.0, False, 0.0), ["cyclone_wind"]),
    ((0.0, 0, 0, 0.0, 80.1, True, 0.0), ["cyclone_wind", "strike_curfew"]),
])
def test_trigger_cutoffs(spark, reading, fired):
    out = triggers.fired(triggers.evaluate(spark.createDataFrame([reading], READING)))
    assert [r.trigger_type for r in out.collect()] == fired


def test_rain_payout(spark):
    rows = [(720.0, 10.0, 60, "plus"), (720.0, 10.0, 60, "none"), (500.0, 5.0, 30, None), (900.0, 7.5, 50, "pro")]
    got = values(spark, rows, "e double, r double, d int, p string", triggers.rain_payout("e", "r", "d", "p"))
    assert [g[0] for g in got] == [432.0, 288.0, 50.0, 450.0]


def test_payout_totals_equal_the_claims_themselves(spark):
    zoned = spark.createDataFrame(
        [(i, "Z" if i % 3 else "Y", dt.datetime(2024, 1, 1, i), 8.0 + i % 3, 46 + i % 5, 100 + 40 * (i % 6), 70.0 * (i % 2), 0.0, i % 4 == 0, 0.7)
         for i in range(24)],
        "reading_id bigint, pincode string, ts timestamp_ntz, " + READING)
    workers = spark.createDataFrame(
        [(i, f"w{i}", "Z", ["basic", "plus", "pro"][i % 3], 400.0 + 37 * (i % 4), 60.0) for i in range(15)] + [(99, "w99", "Y", "plus", 512.5, 60.0)],
        "worker_id bigint, worker_name string, pincode string, plan string, avg_daily_earning double, trust_score double")
    fired = triggers.fired(triggers.evaluate(zoned))
    paid = triggers.auto_claims(fired, workers).groupBy("trigger_type").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    totals = triggers.payout_totals(fired, workers, ["trigger_type"])
    assert {(r.trigger_type, r.n, r.a) for r in paid.collect()} == {(r.trigger_type, r.claims_count, r.payout_total) for r in totals.collect()}
    events = triggers.trigger_events(fired, workers).groupBy("trigger_type").agg(F.sum("claims_count").alias("n"), F.sum("payout_total").alias("a"))
    assert {(r.trigger_type, r.n, r.a) for r in events.collect()} == {(r.trigger_type, r.n, r.a) for r in paid.collect()}


ACCOUNT = ("worker_id bigint, pan_number string, pan_verified boolean, has_delivery_history boolean, total_deliveries int, "
           "account_age_days int, past_claims_count int, platforms_csv string")


@pytest.mark.parametrize("row,score,passes", [
    ((1, "ABCPK1234R", True, True, 60, 200, 0, "swiggy"), 0, True),       # the bonus stops at zero
    ((1, None, False, True, 60, 200, 0, "swiggy"), 35, True),
    ((1, "BAD", True, False, 0, 2, 1, ""), 100, False),
    ((1, "BAD", False, True, 4, 6, 0, "swiggy"), 60, False),
    ((1, "abcpk1234r", True, True, 10, 2, 0, "swiggy"), 20, True),
])
def test_account_integrity(spark, row, score, passes):
    out = fraud.account_integrity(spark.createDataFrame([row], ACCOUNT)).first()
    assert (out.integrity_score, out.passes_gate) == (score, passes)


def test_risky_worker_is_not_waved_through(spark):
    workers = spark.createDataFrame(
        [(1, "Risky", "560034", "plus", "ABCPK1234R", True, "swiggy", 20, True, 30, 500.0, 2, 10, 15.0),
         (2, "Trap", "999999", "plus", "ABCPK1234R", True, "swiggy", 20, True, 300, 500.0, 0, 0, 90.0),
         (3, "Good", "560034", "plus", "ABCPK1234R", True, "swiggy", 200, True, 300, 900.0, 0, 0, 90.0)],
        "worker_id bigint, worker_name string, pincode string, plan string, pan_number string, pan_verified boolean, "
        "platforms_csv string, total_deliveries int, has_delivery_history boolean, account_age_days int, "
        "avg_daily_earning double, past_claims_count int, fraudulent_flags int, trust_score double")
    claims = spark.createDataFrame(
        [(i, f"CLM-20260801-000{i}", i, 5000.0 if i == 1 else 120.0, "manual", "heavy rain", f"d{i}", False, NOON) for i in (1, 2, 3)],
        "claim_sk bigint, claim_id string, worker_id bigint, amount double, trigger_type string, reason string, "
        "device_id string, photo_submitted boolean, created_at timestamp_ntz")
    out = {r.claim_sk: r for r in fraud.score_claims(fraud.assemble(claims, workers)).collect()}
    assert out[1].score >= 75 and not out[1].approved
    assert out[2].score == 100 and out[2].risk_level == "CRITICAL" and out[2].layers == ["Layer 3 Proactive"]
    assert out[3].score == 0 and out[3].approved and out[3].layers == ["None — clean"]


def test_vision_answers(spark):
    rows = [('{"authentic": true, "verdict": "VERIFIED", "score_adjustment": -99}',),
            ('```json\n{"authentic": false, "verdict": "REJECTED", "score_adjustment": 99}\n```',), ("sorry",)]
    out = feeds.parse_vision(spark.createDataFrame(rows, "response string")).collect()
    assert [(r.authentic, r.verdict, r.score_adjustment, r.vision_used) for r in out] == [
        (True, "VERIFIED", -30, True), (False, "REJECTED", 40, True), (True, "UNVERIFIED", 0, False)]


def test_escalation_and_static_trace(spark):
    rejected = spark.createDataFrame([(0, 90.0), (1, 90.0), (2, 90.0), (3, 90.0), (9, 90.0)], "false_before bigint, s double")
    out = signals.escalation(rejected, "s").collect()
    assert [(r.penalty, r.score_after) for r in out] == [(8, 82.0), (10, 72.0), (15, 57.0), (15, 42.0), (15, 10.0)]
    pings = spark.createDataFrame(
        [(1, 1, NOON, 12.9, 77.5), (1, 2, NOON + dt.timedelta(minutes=5), 12.90001, 77.5), (2, 3, NOON, 12.9, 77.5)],
        "trace_id bigint, ping_id bigint, ts timestamp_ntz, lat double, lon double")
    verdicts = {r.trace_id: r for r in signals.trace_verdict(signals.gps_hops(pings)).collect()}
    assert verdicts[1].static and verdicts[1].n_flags == 1 and verdicts[1].confidence == 0.35
    assert verdicts[2].insufficient and not verdicts[2].spoofed


def test_premium_bounds_and_reconciled_sum(spark, tables):
    quoted = pricing.quote(tables.workers, tables.zone_risk, 7)
    wrong = quoted.where("premium < greatest(20, base_premium * 0.6) - 0.006 or premium > base_premium * 2.2 + 0.006")
    assert wrong.count() == 0
    priced = pricing.premium_features(pricing.zoned_scored(tables.workers, tables.zone_risk), 7).withColumn("premium", F.lit(44.4))
    lines = pricing.long_breakdown(pricing.breakdown(priced, model_used=True), "worker_id")
    signed = F.when(F.col("direction") == "discount", -F.abs("amount")).otherwise(F.col("amount"))
    off = lines.groupBy("worker_id").agg(F.sum(signed).alias("s")).where("abs(s - 44.4) > 0.011")
    assert off.count() == 0


def test_ids_and_text(spark):
    got = values(spark, [("Ravi Kumar Rao", NOON, 7)], "n string, ts timestamp_ntz, i int", tx.upi_handle("n"), tx.initials("n"),
                 tx.claim_id("ts", "i", 4), tx.idempotency_key(F.lit("CLM-1")))
    assert got == [("ravi.kumar.rao@upi", "RK", "CLM-20260801-0007", "PAY-CLM-1")]
    assert values(spark, [("2026-08-01T14:30:00Z",), ("x",)], "s string", tm.parse_iso("s")) == [(NOON,), (None,)]


def test_state_object_over_many_lines(spark, tmp_path):
    (tmp_path / "state.json").write_text(
        '{\n "workers": [{"name": "A", "pincode": "560034"}],\n "policies": [],\n "claims": [{"claim_id": "CLM-1", "amount": 5.0}]\n}')
    state = files.read_state(spark, str(tmp_path), whole_files=True)
    assert [r.name for r in state["workers"].collect()] == ["A"] and state["policies"].count() == 0
