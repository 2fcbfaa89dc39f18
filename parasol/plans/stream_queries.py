"""The event flow, run as streams over landed files."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from parasol.constants import OUTBOX_BATCH, TTL_SECONDS
from parasol.functions.temporal import micros
from parasol.operators import matching
from parasol.plans.fraud_queries import LAYERS_SQL, assembled, side_inputs
from parasol.plans.registry import query
from parasol.plans.signal_queries import snapshots
from parasol.session import materialized, scratch_path
from parasol.sources import topics
from parasol.sources.store import BatchTable
from parasol.streaming import burst, dedup, outbox, ttl
from parasol.streaming.envelope import dead_letters, envelope, opened, unreadable
from parasol.streaming.fraud_job import FraudJob, apply_to_claims
from parasol.streaming.payout_job import PayoutJob
from parasol.streaming.runs import append_to_files, run_batches

_RUNS = {}
ROWS_OF_STATE = 25_000  # rows of input per state partition


def once(t, name, user, build):
    """Result of ``build``, shared by different queries of a session and folder; a query that asks again gets a new one."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    result, users = _RUNS.get(key, (None, set()))
    if not users or user in users:
        result, users = build(), set()
    _RUNS[key] = (result, users | {user})
    return result


@contextmanager
def state_partitions(spark, *inputs):
    """The number of state partitions is fixed when a stream first starts: two for small tables, several a core for large ones."""
    rows = sum(df.count() for df in inputs)
    n = max(2, min(4 * spark.sparkContext.defaultParallelism, rows // ROWS_OF_STATE))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(rows, order, cuts, folder, drain, redeliver=False):
    """Land the rows in order of time, one slice per cut, and let the stream catch up each time.

    With ``redeliver`` each slice comes again with the next one, and all come once more at the end.
    """
    low, last = None, None
    for cut in [*cuts, None]:
        part = rows if low is None else rows.where(F.col(order) > F.lit(low).cast("timestamp_ntz"))
        if cut is not None:
            part = part.where(F.col(order) <= F.lit(cut).cast("timestamp_ntz"))
        (part if last is None or not redeliver else part.unionAll(last)).write.mode("append").parquet(folder)
        drain()
        low, last = cut, part
    if redeliver:
        rows.write.mode("append").parquet(folder)
        drain()


MONTH_CUTS = ["2024-01-11", "2024-01-21"]
YEAR_CUTS = ["1997-03-01", "1999-06-01"]


def seconds_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def enveloped(t):
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    value = envelope(F.col("event_type"), F.struct("user_id", k), "event_ts", "event_id", "user_id")
    return t.event_log.select("event_id", "event_type", "event_ts", "arrival_ts", value.alias("value"))


@query("k1_envelope_round_trip", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 1 AS event_version, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
 CAST(user_id AS VARCHAR) AS correlation_id, 'api' AS producer, '{"user_id":' || user_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS payload FROM event_log
""")
def k1(t):
    return opened(enveloped(t).select("value")).drop("value")


@query("k2_duplicate_suppression", "SELECT DISTINCT event_id, event_type FROM event_log")
def k2(t):
    root = scratch_path(t.spark, "dedup")
    rows = t.event_log.select("event_id", "event_type", F.col("event_ts").cast("timestamp").alias("event_ts"), "arrival_ts")
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")

    def drain():
        kept = dedup.within_horizon(source, ["event_id"], "event_ts", "10 minutes")
        append_to_files(kept.select("event_id", "event_type"), f"{root}/kept", f"{root}/checkpoint")

    feed(rows, "arrival_ts", MONTH_CUTS, f"{root}/landed", drain)
    return t.spark.read.parquet(f"{root}/kept")


@query("k2_handled_once_per_consumer", "SELECT DISTINCT event_id, event_type FROM event_log")
def k2b(t):
    root = scratch_path(t.spark, "handled")
    rows = t.event_log.select("event_id", "event_type", "arrival_ts")
    processed = BatchTable(t.spark, f"{root}/processed", dedup.PROCESSED)
    done = BatchTable(t.spark, f"{root}/done", "event_id bigint, event_type string")

    def handle(batch, batch_id):
        fresh = dedup.handle_once(batch, batch_id, processed, "fraud-processor")
        done.write(fresh.select("event_id", "event_type"), batch_id)
        dedup.mark_processed(done.read_batch(batch_id), batch_id, processed, "fraud-processor")

    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
    feed(rows, "arrival_ts", MONTH_CUTS, f"{root}/landed", lambda: run_batches(source, handle, f"{root}/checkpoint"))
    return done.read()


def fraud_run(t, redeliver=False):
    root = scratch_path(t.spark, "fraud")
    # Aggregated once; every batch reads the written result.
    sides = [materialized(df, name) for df, name in zip(side_inputs(t), ("weather", "traces"))]
    job = FraudJob(t.spark, root, t.workers, lambda claims, network: assembled(t, claims, network, sides, narrow=True),
                   period="yyyy")  # the landed slices span years
    t.spark.createDataFrame([], t.claims.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(t.claims.schema).parquet(f"{root}/landed")
    feed(t.claims, "created_at", YEAR_CUTS, f"{root}/landed", lambda: run_batches(source, job.handle, f"{root}/checkpoint"), redeliver)
    return job


ROUTED_SQL = """
routed AS (SELECT l.*, CASE WHEN NOT approved THEN 'rejected_fraud' WHEN coalesce(nullif(trust_score, 0), 50) >= 50 THEN 'approved' ELSE 'pending_review' END AS new_status,
 CASE WHEN NOT approved THEN NULL WHEN coalesce(nullif(trust_score, 0), 50) >= 85 THEN 'Instant' WHEN coalesce(nullif(trust_score, 0), 50) >= 75 THEN '2hr auto'
  WHEN coalesce(nullif(trust_score, 0), 50) >= 50 THEN '6hr hold' ELSE '24hr review' END AS speed FROM lay l)
"""


DECIDED_SQL = f"""
WITH {LAYERS_SQL}, {ROUTED_SQL} SELECT claim_sk, new_status AS status, speed AS payout_speed, CAST(trunc(score) AS INT) AS fraud_score, risk_level,
 CASE WHEN approved THEN 'claim.approved' ELSE 'claim.rejected' END AS topic FROM routed
"""


def decided(job):
    sent = opened(job.events.read()).select(
        F.get_json_object("payload", "$.claim_sk").cast("bigint").alias("claim_sk"), "topic")
    return job.decisions.read().join(sent, "claim_sk").select(
        "claim_sk", "status", "payout_speed", "fraud_score", "risk_level", "topic")


@query("k3_fraud_job", DECIDED_SQL)
def k3(t):
    return decided(once(t, "fraud", "k3", lambda: fraud_run(t)))


@query("k3_redelivery", DECIDED_SQL)
def k3_redelivery(t):
    """Every claim is delivered two or three times, in different batches."""
    return decided(fraud_run(t, redeliver=True))


@query("k3_claim_and_flag_updates", f"""
WITH {LAYERS_SQL}, {ROUTED_SQL}, f AS (SELECT worker_id, count(*) AS n FROM routed WHERE new_status = 'rejected_fraud' GROUP BY 1)
SELECT r.claim_sk, r.new_status AS status, coalesce(f.n, 0) AS new_flags FROM routed r LEFT JOIN f ON f.worker_id = r.worker_id
""")
def k3b(t):
    job = once(t, "fraud", "k3b", lambda: fraud_run(t))
    flags = job.flags.read().groupBy("worker_id").agg(F.sum("new_flags").alias("new_flags"))
    return apply_to_claims(t.claims, job.statuses.read()).join(flags, "worker_id", "left").select(
        "claim_sk", "status", F.coalesce("new_flags", F.lit(0)).alias("new_flags"))


@query("k13_history_across_batches", """
SELECT device_id, worker_id, claim_sk FROM (SELECT c.*, row_number() OVER (PARTITION BY device_id, c.worker_id ORDER BY created_at, claim_sk) AS rn
 FROM claims c JOIN workers w USING (worker_id) WHERE w.pincode <> '999999') q WHERE rn = 1
""")
def k13(t):
    return once(t, "fraud", "k13", lambda: fraud_run(t)).history.devices.read().select("device_id", "worker_id", "claim_sk")


def payout_run(t, replay=False):
    root = scratch_path(t.spark, "payouts")
    job = PayoutJob(t.spark, root)
    known = t.claims_with_zone.select("claim_sk", "claim_id", "worker_name", "status")
    rows = t.payout_requests.join(known, "claim_sk", "left")  # unknown claims are the job's to report
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")

    def handle(batch, batch_id):
        job.handle(batch, batch_id)
        if replay:  # the same batch again, as after a failure between sink and commit
            job.handle(batch, batch_id)

    feed(rows, "requested_at", YEAR_CUTS, f"{root}/landed", lambda: run_batches(source, handle, f"{root}/checkpoint"))
    if replay:  # a consumer that lost its offsets reads everything again
        run_batches(source, lambda b, i: job.handle(b, i + 100), f"{root}/checkpoint-lost")
    return job


PAID_SQL = """
WITH first_req AS (SELECT *, row_number() OVER (PARTITION BY claim_sk ORDER BY requested_at, attempt, amount, mode) AS rn FROM payout_requests)
SELECT p.claim_sk, c.claim_id, p.amount, CAST(trunc(p.amount * 100) AS BIGINT) AS amount_paise, replace(lower(worker_name), ' ', '.') || '@upi' AS upi,
 'PAY-' || c.claim_id AS idempotency_key, p.mode FROM first_req p JOIN claims c USING (claim_sk) LEFT JOIN workers USING (worker_id) WHERE rn = 1 AND c.status = 'approved'
"""


@query("k4_payout_job", PAID_SQL)
def k4(t):
    return once(t, "payouts", "k4", lambda: payout_run(t)).payouts.read().select(
        "claim_sk", "claim_id", "amount", "amount_paise", "upi", "idempotency_key", "mode")


@query("k5_idempotency_under_replay", f"SELECT idempotency_key, 1::BIGINT AS payouts, 1::BIGINT AS events FROM ({PAID_SQL}) q")
def k5(t):
    job = once(t, "replayed", "k5", lambda: payout_run(t, replay=True))
    paid = job.payouts.read().groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("payouts"))
    sent = opened(job.events.read()).groupBy(
        F.get_json_object("payload", "$.idempotency_key").alias("idempotency_key")).agg(F.count(F.lit(1)).alias("events"))
    return paid.join(sent, "idempotency_key", "full_outer")


@query("k6_dead_letters", """
SELECT CASE WHEN event_type = 'error' THEN 'dead' ELSE 'valid' END AS kind, CASE WHEN event_type = 'error' THEN 'unknown' ELSE CAST(event_id AS VARCHAR) END AS key,
 CASE WHEN event_type = 'error' THEN 'unreadable envelope' END AS reason FROM event_log
""")
def k6(t):
    # Every 'error' event arrives cut off in the middle.
    root = scratch_path(t.spark, "dlq")
    broken = F.when(F.col("event_type") == "error", F.substring("value", 1, 20)).otherwise(F.col("value"))
    rows = enveloped(t).select(broken.alias("value"), "arrival_ts")
    valid = BatchTable(t.spark, f"{root}/valid", "event_id string")
    dead = BatchTable(t.spark, f"{root}/dead", "topic string, key string, original string, consumer_name string, "
                      "failure_reason string, retry_count int, dlq_timestamp string, correlation_id string")

    def handle(batch, batch_id):
        read = opened(batch)
        valid.write(read.where(~unreadable()).select("event_id"), batch_id)
        dead.write(dead_letters(read.where(unreadable()), "fraud-processor", F.lit("unreadable envelope"), F.lit(0),
                                "arrival_ts", "claim.processing.dlq"), batch_id)

    rows.write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
    run_batches(source, handle, f"{root}/checkpoint")
    return (valid.read().select(F.lit("valid").alias("kind"), F.col("event_id").alias("key"), F.lit(None).cast("string").alias("reason"))
            .unionAll(dead.read().select(F.lit("dead"), "key", "failure_reason")))


@query("k7_retries_and_error_classes", """
SELECT event_id, CAST(CASE WHEN w.worker_id IS NULL THEN 0 ELSE least(event_id % 7, 4) END AS INT) AS attempt,
 CASE WHEN w.worker_id IS NULL OR event_id % 7 > 4 THEN 'dead' ELSE 'done' END AS outcome,
 CASE WHEN w.worker_id IS NULL THEN 'worker not found' WHEN event_id % 7 > 4 THEN 'service timeout' END AS error
FROM events e LEFT JOIN workers w ON e.user_id * 20 = w.worker_id
""")
def k7(t):
    known = t.workers.select((F.col("worker_id")).alias("target"), F.lit(True).alias("known"))

    def attempt_once(events):
        # A service answers an event from its (event_id % 7)-th retry on.
        tried = events.join(known, F.col("user_id") * 20 == F.col("target"), "left")
        lost, late = F.col("known").isNull(), F.col("event_id") % 7 > F.col("attempt")
        return tried.withColumns({
            "error_class": F.when(lost, "permanent").when(late, "transient"),
            "error": F.when(lost, "worker not found").when(late, "service timeout")})

    table = BatchTable(t.spark, scratch_path(t.spark, "retries"), "event_id bigint, user_id bigint, " + outbox.RETRY_FIELDS)
    done = outbox.process_attempts(t.events.select("event_id", "user_id"), attempt_once, table)
    return done.select("event_id", "attempt", "outcome", "error")


@query("k8_outbox_drain", """
SELECT event_id, CASE WHEN status <> 'pending' THEN status WHEN retry_count >= 10 THEN 'failed' WHEN event_id % 13 <> 0 THEN 'published' ELSE 'pending' END AS status,
 CAST(retry_count + CASE WHEN status = 'pending' AND retry_count < 10 AND event_id % 13 = 0 THEN 1 ELSE 0 END AS INT) AS retry_count FROM outbox
""")
def k8(t):
    # The broker refuses every thirteenth event.
    return outbox.drain(t.outbox, delivered=F.col("event_id") % 13 != 0).select("event_id", "status", "retry_count")


@query("k8_outbox_cycle", f"""
WITH picked AS (SELECT event_id FROM outbox WHERE status = 'pending' ORDER BY created_at, event_id LIMIT {OUTBOX_BATCH})
SELECT o.event_id, CASE WHEN p.event_id IS NULL THEN status WHEN retry_count >= 10 THEN 'failed' WHEN o.event_id % 13 <> 0 THEN 'published' ELSE 'pending' END AS status,
 CAST(retry_count + CASE WHEN p.event_id IS NOT NULL AND retry_count < 10 AND o.event_id % 13 = 0 THEN 1 ELSE 0 END AS INT) AS retry_count
FROM outbox o LEFT JOIN picked p ON p.event_id = o.event_id
""")
def k8_cycle(t):
    """One cycle takes the oldest pending events, as many as a poll does."""
    done = outbox.drain(t.outbox, delivered=F.col("event_id") % 13 != 0, limit=OUTBOX_BATCH)
    return done.select("event_id", "status", "retry_count")


@query("k9_outbox_rows", """
SELECT sha256(claim_id || '|claim.created') AS event_id, claim_id AS aggregate_id, 'claim.created' AS topic, 'pending' AS status, 0 AS retry_count,
 trigger_type AS sent_trigger FROM claims
""")
def k9(t):
    rows = opened(outbox.outbox_rows(t.claims_with_zone).select(
        F.col("event_id").alias("eid"), "aggregate_id", F.col("topic").alias("to"), "status", "retry_count", "payload")
        .withColumnRenamed("payload", "value"))
    return rows.select(F.col("eid").alias("event_id"), "aggregate_id", F.col("to").alias("topic"), "status", "retry_count",
                       F.get_json_object("payload", "$.trigger_type").alias("sent_trigger"))


@query("k10_zone_burst_stream", """
SELECT pincode, strftime(time_bucket(INTERVAL 5 MINUTES, ts) - i * INTERVAL 5 MINUTES, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS claims, count(*) > 8 AS burst
FROM zone_claims, range(0, 12) r(i) GROUP BY 1, 2
""")
def k10(t):
    root = scratch_path(t.spark, "burst")
    rows = t.zone_claims.select("pincode", "ts")
    table = BatchTable(t.spark, f"{root}/windows", burst.WINDOWS)
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed").withColumn("at", F.col("ts").cast("timestamp"))
    feed(rows, "ts", MONTH_CUTS, f"{root}/landed", lambda: run_batches(
        burst.burst_windows(source, "at"), burst.keep_latest(table), f"{root}/checkpoint", "update"))
    now = burst.current_windows(table)
    return now.select("pincode", seconds_text("window_start").alias("window_start"), "claims",
                      (F.col("claims") > burst.BURST_CLAIMS).alias("burst"))


@query("k11_late_data", """
WITH d AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN ts + INTERVAL 2 DAYS ELSE ts END AS arrival FROM events),
 s AS (SELECT *, CASE WHEN arrival <= TIMESTAMP '2024-01-11' THEN 0 WHEN arrival <= TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS slice FROM d),
 m AS (SELECT slice, max(ts) AS newest FROM s GROUP BY 1)
SELECT event_id FROM s WHERE ts > coalesce((SELECT max(newest) FROM m WHERE m.slice < s.slice) - INTERVAL 5 MINUTES, TIMESTAMP '1900-01-01')
""")
def k11(t):
    # 'error' events arrive two days late; those of an earlier slice's days are past the grace.
    root = scratch_path(t.spark, "late")
    arrival = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts"))
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("at"), arrival.alias("arrival"))
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
    feed(rows, "arrival", MONTH_CUTS, f"{root}/landed", lambda: append_to_files(
        dedup.on_time(source, ["event_id"], "at", "5 minutes").select("event_id"), f"{root}/kept", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/kept")


@query("k12_ttl_lookups", """
WITH snaps AS (SELECT r.pincode, r.ts, r.reading_id AS snapshot_id FROM readings r JOIN events e ON e.event_id = r.reading_id AND e.event_type = 'view')
SELECT r.reading_id, CASE WHEN age < 300000000 THEN snapshot_id END AS weather, CASE WHEN age < 120000000 THEN snapshot_id END AS trigger_result,
 CASE WHEN age < 86400000000 THEN snapshot_id END AS zone
FROM (SELECT r.reading_id, s.snapshot_id, epoch_us(r.ts) - epoch_us(s.ts) AS age FROM readings r ASOF LEFT JOIN snaps s ON r.pincode = s.pincode AND r.ts >= s.ts) r
""")
def k12(t):
    # One as-of pass; each time to live is a condition on the age it yields.
    found = matching.with_zone_snapshot(t.readings.select("reading_id", "pincode", "ts"), snapshots(t), ["snapshot_id"],
                                        max(TTL_SECONDS.values()), "snapshot_id")
    age = (micros("ts") - F.col("known_at")) / 1e6
    return found.select("reading_id", *[
        F.when(age < TTL_SECONDS[kind], F.col("snapshot_id")).alias(name)
        for kind, name in (("weather", "weather"), ("trigger", "trigger_result"), ("zone", "zone"))])


@query("k12_ttl_state_stream", """
SELECT r.reading_id, CASE WHEN epoch_us(r.ts) - epoch_us(s.ts) < 86400000000 THEN s.snapshot_id END AS snapshot_id
FROM readings r ASOF LEFT JOIN (SELECT r.pincode, r.ts, r.reading_id AS snapshot_id FROM readings r JOIN events e ON e.event_id = r.reading_id AND e.event_type = 'view') s
 ON r.pincode = s.pincode AND r.ts >= s.ts
""")
def k12b(t):
    root = scratch_path(t.spark, "ttl")
    kinds = t.events.select(F.col("event_id").alias("reading_id"), "event_type")
    rows = t.readings.select("reading_id", "pincode", "ts").join(kinds, "reading_id")
    lookup = ttl.LatestLookup(t.spark, root, key="pincode", fact="reading_id", seconds=TTL_SECONDS["zone"])
    t.spark.createDataFrame([], rows.schema).write.parquet(f"{root}/landed")
    source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed")

    def handle(batch, batch_id):
        lookup.handle(batch.select("pincode", "ts", "reading_id"),
                      batch.where("event_type = 'view'").select("pincode", "ts", "reading_id"), batch_id)

    feed(rows, "ts", MONTH_CUTS, f"{root}/landed", lambda: run_batches(source, handle, f"{root}/checkpoint"))
    return lookup.answers.read().select(F.col("probe_id").alias("reading_id"), F.col("fact_id").alias("snapshot_id"))


def topic_rows(t):
    return topics.keyed(enveloped(t), F.concat(F.lit("events."), F.col("event_type")), "event_id", F.col("value"))


@query("s6_topic_source", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'events.purchase' AS topic FROM event_log WHERE event_type = 'purchase'
""")
def s6(t):
    root = scratch_path(t.spark, "topics")
    topics.land(topic_rows(t), root)
    stream = opened(topics.read_topic(t.spark, "events.purchase", folder=root))
    append_to_files(stream.select("event_id", "event_type", "topic"), f"{root}-out", f"{root}-checkpoint")
    return t.spark.read.parquet(f"{root}-out")


@query("s7_topic_sink", "SELECT 'events.' || event_type AS topic, CAST(event_id AS VARCHAR) AS key FROM event_log")
def s7(t):
    root = scratch_path(t.spark, "sink")
    rows = topic_rows(t)
    rows.write.parquet(f"{root}/landed")
    topics.publish(t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed"), f"{root}/checkpoint", folder=f"{root}/topics")
    return t.spark.read.parquet(f"{root}/topics").select(F.col("topic").cast("string").alias("topic"), "key")

