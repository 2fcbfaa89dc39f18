"""Jobs redone, split differently, or interrupted give the same tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parasol.operators import change, fraud, warehouse as wh
from parasol.operators.iforest import fit_forest, tree_samples
from parasol.plans.warehouse import Warehouse, run_full_etl
from parasol.session import scratch_path
from parasol.sources.store import BatchTable, MergedTable, VersionedTable
from parasol.streaming.fraud_job import FraudJob
from parasol.streaming.history import ClaimHistory
from parasol.streaming.payout_job import PayoutJob


def test_uncommitted_folders_do_not_count(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", "x bigint")
    table.write(spark.range(3).toDF("x"), 0)
    table.write(spark.range(5).toDF("x"), 1)
    (tmp_path / "t" / "batch_id=1" / "_SUCCESS").unlink()
    assert table.read().count() == 3
    table.write(spark.range(4).toDF("x"), 1)
    assert table.read().count() == 7 and table.read(before=1).count() == 3


def test_versions_and_merges(spark, tmp_path):
    versions = VersionedTable(spark, f"{tmp_path}/v")
    assert versions.read() is None
    versions.write(spark.range(2))
    versions.write(spark.range(3))
    assert versions.read().count() == 3
    merged = MergedTable(spark, f"{tmp_path}/m", ["k"], "p")
    merged.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k int, s string, p int"))
    again = spark.createDataFrame([(2, "B", 1), (4, "d", 1)], "k int, s string, p int")
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "m" / "data" / "merge=1" / "p=2").iterdir()}
    for _ in range(2):
        merged.merge(again)
    assert sorted((r.k, r.s) for r in merged.read().collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "m" / "data" / "merge=1" / "p=2").iterdir()} == before  # untouched


def test_merge_cut_short_leaves_the_table(spark, tmp_path):
    table = MergedTable(spark, f"{tmp_path}/m", ["k"], "p")
    table.merge(spark.createDataFrame([(1, "a", 10, 1), (2, "b", 20, 1)], "k int, s string, n int, p int"))
    change_rows = spark.createDataFrame([(2, "B", 99, 1), (3, "c", 30, 2)], "k int, s string, n int, p int")
    switch, table.manifest.write = table.manifest.write, lambda df: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.merge(change_rows, matched=["s"])
    assert sorted(tuple(r) for r in table.read().select("k", "s", "n").collect()) == [(1, "a", 10), (2, "b", 20)]
    table.manifest.write = switch
    table.merge(change_rows, matched=["s"])  # only s of a known key changes
    assert sorted(tuple(r) for r in table.read().select("k", "s", "n").collect()) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]


def test_upsert_replaces_nulls_and_keeps_missing_columns(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    got = sorted(tuple(r) for r in change.upsert(base, new, ["k"]).collect())
    assert got == [(1, "a", 5), (2, None, 6), (3, "c", None)]


def test_etl_in_any_number_of_runs(spark, tables):
    payouts = wh.payouts_from_requests(tables.payout_requests)

    def loaded(cuts):
        house = Warehouse(spark, scratch_path(spark, "etl"), period_digits=4)
        for cut in cuts:
            stop = F.lit(cut).cast("timestamp_ntz")
            run_full_etl(house, tables.claims.where(F.col("updated_at") <= stop), tables.workers,
                         payouts.where(F.col("requested_at") <= stop), dt.datetime(1995, 1, 15))
        facts = house.claims.read().drop("period")
        return facts, house.payouts.read().select("claim_sk", "amount", "gateway_mode", "worker_key")

    one, many = loaded(["2002-01-01"]), loaded(["1997-01-01", "1997-01-01", "2000-05-05", "2002-01-01"])
    for a, b in zip(one, many):
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(*a.columns)).count() == 0


def test_history_split_into_batches_equals_one_pass(spark, tables):
    # Two devices shared by everyone, so that every batch meets the history.
    located = tables.claims_with_zone.where("pincode is not null").withColumn(
        "device_id", F.concat(F.lit("dev-"), (F.col("claim_sk") % 2).cast("string"))).withColumn(
        "created_at", F.expr("cast('2024-01-01' as timestamp_ntz) + (claim_sk * 37 % 50000) * interval '1' second"))
    whole = {r.claim_sk: (r.prior_hour, r.zones_before, r.others_on_device) for r in fraud.network_signals(located).collect()}
    history, split = ClaimHistory(spark, scratch_path(spark, "history")), {}
    edges = ["2024-01-01", "2024-01-01 03:00:00", "2024-01-01 09:30:00", "2024-01-02"]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = located.where((F.col("created_at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(b).cast("timestamp_ntz")))
        for _ in range(2):  # each batch is handed over twice
            history.file(part, i)
            rows = history.signals(i).collect()
            history.append_pairs(i)
        split.update({r.claim_sk: (r.prior_hour, r.zones_before, r.others_on_device) for r in rows})
    assert split == whole and max(v[0] for v in whole.values()) > 8 and max(v[2] for v in whole.values()) > 50


def test_payouts_do_not_depend_on_batches(spark, tables):
    known = tables.claims_with_zone.select("claim_sk", "claim_id", "worker_name", "status")
    rows = tables.payout_requests.join(known, "claim_sk")

    def paid(cuts):
        job, low = PayoutJob(spark, scratch_path(spark, "pay")), "1900-01-01"
        for i, cut in enumerate(cuts):
            job.handle(rows.where((F.col("requested_at") > low) & (F.col("requested_at") <= cut)), i)
            low = cut
        return sorted(tuple(r) for r in job.payouts.read().collect())

    assert paid(["2003-01-01"]) == paid(["1996-01-01", "1998-06-01", "2000-01-01", "2003-01-01"])


def test_requests_of_unknown_claims_are_dead_letters_once(spark):
    schema = "claim_sk long, claim_id string, worker_name string, status string, amount double, attempt int, mode string, requested_at timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "C1", "Ann Lee", "approved", 5.0, 1, "UPI", at), (2, None, None, None, 7.0, 1, "UPI", at),
                                  (2, None, None, None, 7.0, 2, "UPI", at)], schema)
    job = PayoutJob(spark, scratch_path(spark, "dead"))
    for i in (0, 0, 1):
        job.handle(rows, i)
    assert [r.claim_id for r in job.payouts.read().collect()] == ["C1"]
    assert [(r.key, r.topic) for r in job.dead.read().collect()] == [("2", "payout.processing.dlq")]
    job.handle(rows.where("claim_sk = 2").fillna({"claim_id": "C2", "worker_name": "Bo", "status": "approved"}), 2)
    assert sorted(r.claim_id for r in job.payouts.read().collect()) == ["C1", "C2"]


@pytest.fixture(scope="module")
def features(tables):
    rows = tables.claims.join(tables.workers.select(*fraud.WORKER_COLUMNS), "worker_id")
    return fraud.ml_features(rows).select("claim_sk", *fraud.ML_FEATURES)


@pytest.mark.parametrize("n", [100, 300, 500, 20_000])
def test_every_tree_gets_its_whole_sample(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 97).alias("a"), (F.col("id") % 13).alias("b"))
    seats, size = tree_samples(rows, "id", ["a", "b"], n_trees=120, sample=256)
    by_tree = seats.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).collect()
    assert size == min(256, n) and len(by_tree) == 120
    assert all(r.n == size and r["keys"] == size for r in by_tree)


def test_forest_does_not_depend_on_partitions(spark, features):
    def scores(df):
        forest = fit_forest(df, "claim_sk", fraud.ML_FEATURES, n_trees=20, sample=64)
        return {r.claim_sk: r.ml_score for r in forest.with_scores(features).collect()}

    one, many = scores(features.coalesce(1)), scores(features.repartition(7))
    assert one == many and all(0 <= s <= 100 for s in one.values())


def test_forest_finds_the_odd_rows(spark, features):
    odd = spark.createDataFrame([(-i, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0) for i in range(1, 6)], features.schema)
    forest = fit_forest(features.unionByName(odd), "claim_sk", fraud.ML_FEATURES, n_trees=100)
    scored = forest.with_scores(features.unionByName(odd))
    flagged = scored.agg(F.avg(F.col("ml_anomaly").cast("int"))).first()[0]
    assert 0.03 < flagged < 0.15
    low = scored.where("claim_sk >= 0").agg(F.percentile("raw", F.lit(0.5))).first()[0]
    assert all(r.raw < low for r in scored.where("claim_sk < 0").collect())


def test_a_load_touches_its_own_periods(spark, tables, tmp_path):
    """A late score rewrites the claim's period and its sums, nothing else; a merge done again changes nothing."""
    house = Warehouse(spark, str(tmp_path / "house"), period_digits=4)
    payouts = wh.payouts_from_requests(tables.payout_requests)
    run_full_etl(house, tables.claims, tables.workers, payouts, dt.datetime(1995, 1, 15))

    def files(table):
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "house" / table / "data").rglob("*.parquet")}

    before = {t: (files(t), getattr(house, a)._folders()) for t, a in (("fact_claims", "claims"), ("claim_sums", "claim_sums"), ("fact_payouts", "payouts"))}
    late = tables.claims.where("year(created_at) = 1996 and claim_sk % 2 = 0").withColumns(
        {"fraud_score": F.lit(77), "updated_at": F.expr("updated_at + interval 30 years")})
    for _ in range(2):
        house.load_claims(late, tables.workers)
    for name, table in (("fact_claims", house.claims), ("claim_sums", house.claim_sums), ("fact_payouts", house.payouts)):
        old, now = before[name][1], table._folders()
        assert {p for p in now if now[p] != old[p]} == ({"1996"} if name != "fact_payouts" else set())
        assert all(files(name)[f] == at for f, at in before[name][0].items())  # old folders are left as they are
    assert house.claims.read().where("fraud_score = 77").count() >= late.count() > 0
    older = late.withColumns({"fraud_score": F.lit(5), "updated_at": F.expr("updated_at - interval 40 years"), "status": F.lit("stale")})
    house.load_claims(older, tables.workers)  # lands after, but is older than what is known
    assert house.claims.read().where("fraud_score = 5 and claim_status = 'stale'").count() == 0
    city = {r.pincode: r.total_claims for r in house.views()["city"].collect()}
    assert sum(city.values()) == tables.claims_with_zone.where("pincode is not null").count()


def test_workers_absent_from_a_load_stay(spark, tables, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"), period_digits=4)
    stamped = tables.claims.select(F.col("created_at").alias("at"))
    house.load_dimensions(tables.claims, tables.workers, stamped)
    changed = tables.workers.where("worker_id % 3 = 0").withColumn("trust_score", F.lit(99.0))
    house.load_dimensions(tables.claims, changed, stamped)
    held = house.dims["worker"].read()
    assert held.count() == tables.workers.count()
    assert held.where("worker_id % 3 = 0 and risk_segment <> 'LOW'").count() == 0 and held.where("risk_segment <> 'LOW'").count() > 0


def test_loads_read_payouts_that_are_worked_out_once(spark, tables):
    """A load reads them twice, for their dates and for the facts; neither may aggregate all requests again."""
    from parasol.plans import warehouse_queries

    once = warehouse_queries._payouts(tables)
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(once.collect()) == sorted(wh.payouts_from_requests(tables.payout_requests).collect())


def test_a_batch_of_claims_is_worked_out_once(spark, tables, tmp_path):
    """The layers read the batch's claims from what is written, not from its deduplication over again."""
    class Stop(Exception):
        pass

    plans = []

    def assemble(claims, network):
        plans.append(claims._jdf.queryExecution().optimizedPlan().toString())
        raise Stop

    job = FraudJob(spark, str(tmp_path), tables.workers, assemble)
    with pytest.raises(Stop):
        job.handle(tables.claims.unionAll(tables.claims), 0)
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]


def test_forest_scores_follow_the_trees_and_many_rows_are_dealt_out(spark, monkeypatch):
    from parasol.operators import iforest
    nan = float("nan")
    rows = [(i, (i * 37 % 101) / 7.0, (i * 53 % 97) / 5.0 if i % 50 else nan) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    monkeypatch.setattr(iforest, "ROWS_PER_TASK", 200)
    assert iforest.spread(df, ["id"], 900).rdd.getNumPartitions() == 5 and iforest.spread(df, ["id"], 200).rdd.getNumPartitions() == 1
    forest = fit_forest(df.fillna(0.0), "id", ["a", "b"], n_trees=7, sample=64)
    norm = float(iforest.expected_path(64))

    def walked(point):
        total = 0.0
        for tree in forest.trees:
            at = 0
            while tree["feature"][at] >= 0:
                at = tree["left" if point[tree["feature"][at]] < tree["threshold"][at] else "right"][at]
            total += tree["path"][at]
        return -(2.0 ** -(total / 7 / norm))

    got = {r.id: r.raw for r in forest.with_scores(df).collect()}
    assert all(abs(got[i] - (walked((a, b)) - forest.offset)) < 1e-12 for i, a, b in rows)
