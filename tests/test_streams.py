"""Stream joins keep bounded state; retries over polls survive replays."""

import datetime as dt
import json

from pyspark.sql import functions as F

from parasol.streaming import joins, keyed
from parasol.streaming.retries import RetryJob
from parasol.streaming.runs import run_batches

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_join_state_is_dropped_behind_the_watermark(spark, tmp_path):
    keyed.use_rocksdb(spark)
    claims, fired = "claim_sk long, pincode string, claimed_at timestamp", "pincode string, fired_at timestamp"
    for name, schema in (("claims", claims), ("fired", fired)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    pairs = joins.disruptions_of_claims(*[spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("claims", claims), ("fired", fired))])
    held = []
    for day in range(6):
        at = START + dt.timedelta(days=day)
        spark.createDataFrame([(100 * day + k, f"p{k % 4}", at + dt.timedelta(hours=k)) for k in range(20)], claims).write.mode("append").parquet(f"{tmp_path}/claims")
        spark.createDataFrame([(f"p{k % 4}", at + dt.timedelta(hours=k)) for k in range(0, 20, 3)] * 2, fired).write.mode("append").parquet(f"{tmp_path}/fired")
        query = (pairs.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held.append(sum(op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"]))
    assert max(held[2:]) <= max(held[:2]) + 5  # what is held does not grow with the days
    found = {r.claim_sk: r.disrupted_at for r in joins.latest_disruption(spark.read.parquet(f"{tmp_path}/out")).collect()}
    for day in range(5):  # the last day is still waiting
        for k in range(20):
            near = [h for h in range(0, 20, 3) if h % 4 == k % 4 and k - 6 <= h <= k]
            want = START + dt.timedelta(days=day, hours=max(near)) if near else None
            assert found[100 * day + k] == (want and want.replace(tzinfo=None)), (day, k)


def test_retries_over_polls_and_replays(spark, tmp_path):
    def attempt_once(events):  # event n answers at its n-th retry; event 99 never can
        late, lost = F.col("n") > F.col("attempt"), F.col("n") == 99
        return events.withColumns({"error_class": F.when(lost, "permanent").when(late, "transient"), "error": F.when(lost, "lost").when(late, "busy")})

    job = RetryJob(spark, f"{tmp_path}/job", "n bigint", attempt_once, max_retries=4, longest=2)
    spark.createDataFrame([], "n bigint").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("n bigint").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 5, 99)], "n bigint").write.mode("append").parquet(f"{tmp_path}/in")
    calls = []

    def handle(batch, batch_id):
        job.handle(batch, batch_id)
        job.handle(batch, batch_id)  # again, as after a failure before the commit
        calls.append(batch_id)

    for _ in range(10):
        run_batches(job.stream(source), handle, f"{tmp_path}/checkpoint")
    found = sorted((r.n, r.attempt, r.outcome, r.error) for r in job.finished().collect())
    assert found == [(0, 0, "done", None), (1, 1, "done", None), (3, 3, "done", None), (4, 4, "done", None), (5, 4, "dead", "busy"), (99, 0, "dead", "lost")]
    tried = job.tried.read()
    assert tried.where("n = 4 and outcome <> 'wait'").count() == 5 and tried.where("n = 4 and outcome = 'wait'").count() > 0  # backed off
    assert job.pending(calls[-1]).count() == 0
