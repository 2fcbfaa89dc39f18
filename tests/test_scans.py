"""The two-level scans against plain loops, with one key holding over a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from parasol.operators import extensions, scans


def events(seed, n=240, span=40):
    """(key, at, id, v): a hot key, two ordinary ones, many ties, a few instants on cell edges."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", "c", "d"]
    return [(rng.choice(keys), rng.choice([rng.randrange(span), 10 * rng.randrange(span // 10)]), i, rng.randrange(-3, 9))
            for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 10, 1000])
def test_prior_sum(spark, width):
    rows = events(1)
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, v bigint").repartition(5)
    got = {r.id: r.before for r in scans.prior_sum(df, ["key"], "at", "id", "v", "before", width).collect()}
    want = {i: sum(v2 for k2, a2, i2, v2 in rows if k2 == k and (a2, i2) < (a, i)) for k, a, i, v in rows}
    assert got == want


@pytest.mark.parametrize("edge", [True, False])
@pytest.mark.parametrize("width", [3, 10, 1000])
def test_trailing_sum(spark, width, edge):
    rows = events(2)
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, v bigint")
    out = scans.trailing_sum(df, ["key"], "at", "v", "recent", span=10, include_edge=edge, width=width, also=["id"])
    got = {r.id: r.recent for r in out.collect()}

    def inside(age):
        return 0 <= age <= 10 if edge else 0 <= age < 10

    want = {i: sum(v2 for k2, a2, _, v2 in rows if k2 == k and inside(a - a2)) for k, a, i, v in rows}
    assert got == want


@pytest.mark.parametrize("ttl", [None, 5])
@pytest.mark.parametrize("width", [2, 10, 1000])
def test_last_known(spark, width, ttl):
    probes, facts = events(3, 150), events(4, 60)
    p = spark.createDataFrame(probes, "key string, at bigint, id bigint, v bigint")
    f = spark.createDataFrame(facts, "key string, f_at bigint, f_id bigint, known bigint")
    out = scans.last_known(p, f, ["key"], "at", "f_at", "f_id", ["f_id", "known"], ttl=ttl, width=width)
    got = {r.id: (r.f_id, r.known) for r in out.collect()}
    want = {}
    for k, a, i, _ in probes:
        earlier = [(a2, i2, v2) for k2, a2, i2, v2 in facts if k2 == k and a2 <= a]
        best = max(earlier, default=None)
        want[i] = (best[1], best[2]) if best and (ttl is None or a - best[0] < ttl) else (None, None)
    assert got == want


@pytest.mark.parametrize("width", [2, 10, 1000])
def test_with_previous(spark, width):
    rows = events(5)
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, v bigint")
    got = {r.id: r.prev_v for r in scans.with_previous(df, ["key"], "at", "id", ["v"], width).collect()}
    want = {}
    for k, a, i, _ in rows:
        earlier = [(a2, i2, v2) for k2, a2, i2, v2 in rows if k2 == k and (a2, i2) < (a, i)]
        want[i] = max(earlier)[2] if earlier else None
    assert got == want


def test_first_seen(spark):
    rows = events(6)
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, v bigint")
    got = {r.id for r in scans.first_seen(df, ["key", "v"], "at", "id").where("is_first").collect()}
    want = {min((a, i) for k2, a, i, v2 in rows if (k2, v2) == kv)[1] for kv in {(k, v) for k, _, _, v in rows}}
    assert got == want


def test_negative_instants_fall_into_the_right_cell(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (-10,)], "at bigint")
    got = {r.at: r.c for r in df.select("at", scans.cell_start("at", 10).alias("c")).collect()}
    assert got == {-1: -10, 0: 0, 9: 0, 10: 10, -10: -10}


def test_rings_against_union_find(spark):
    rng = random.Random(7)
    pairs = [(f"d{rng.randrange(60)}", rng.randrange(80)) for _ in range(90)]
    pairs += [(f"chain{i}", w) for i in range(40) for w in (1000 + i, 1001 + i)]  # a long thin chain
    pairs += [("hub", w) for w in range(2000, 2060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, w in pairs:
        parent[find(d)] = find(w)
    members = {}
    for _, w in pairs:
        members.setdefault(find(w), set()).add(w)
    want = {w: (min(m), len(m)) for m in members.values() for w in m}
    df = spark.createDataFrame(pairs, "device_id string, worker_id bigint")
    got = {r.worker_id: (r.ring, r.ring_size) for r in extensions.device_rings(df).collect()}
    assert got == want


def test_outage_needs_three_low_buckets_in_a_row(spark):
    quiet = {(8, b) for b in (20, 21, 22, 30)}
    rows = [("p", d * 86400 + b * 1800 + i) for d in range(10) for b in range(48) for i in range(10 if (d, b) not in quiet else 3)]
    df = spark.createDataFrame(rows, "platform string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    out = extensions.outages(df, "platform", "ts").where("outage").collect()
    assert [r.bucket for r in out] == [8 * 86400 + 22 * 1800]


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), (None, 1, 2, 7), (None, 2, 3, 7), ("a", 2, 4, 1)],
                               "key string, at bigint, id bigint, v bigint")
    sums = {r.id: r.s for r in scans.prior_sum(df, ["key"], "at", "id", "v", "s").collect()}
    assert sums == {1: 0, 4: 5, 2: None, 3: None}
    recent = scans.trailing_sum(df, ["key"], "at", "v", "s", 10, True, also=["id"])
    assert {r.id: r.s for r in recent.collect()} == {1: 5, 4: 6, 2: None, 3: None}
    facts = df.select("key", F.col("at").alias("f_at"), F.col("id").alias("f_id"))
    known = scans.last_known(df, facts, ["key"], "at", "f_at", "f_id", ["f_id"])
    assert {r.id: r.f_id for r in known.collect()} == {1: 1, 4: 4, 2: None, 3: None}
    previous = scans.with_previous(df, ["key"], "at", "id", ["v"])
    assert {r.id: r.prev_v for r in previous.collect()} == {1: None, 4: 5, 2: None, 3: None}


def test_zone_consensus_reads_scored_rows_once(spark):
    """Counts equal brute force, and the claims are scored once, not once for each table joined."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["560034", "400001", None]), rng.choice([1, 2, 3, None]), f"2024-01-0{rng.randint(1, 2)} 10:00:00",
             rng.choice([["NO_PAN"], []])) for i in range(60)]
    scorings = spark.sparkContext.accumulator(0)

    def score(flags):
        scorings.add(1)
        return flags

    claims = spark.createDataFrame(rows, "claim_sk long, pincode string, worker_id long, at string, raw array<string>")
    scored = claims.select("claim_sk", "pincode", "worker_id", F.col("at").cast("timestamp_ntz").alias("created_at"),
                           F.udf(score, "array<string>")("raw").alias("flags"))
    found = extensions.zone_consensus(scored, neighbours=2).collect()
    assert scorings.value == len(rows)

    def neighbours(zone, worker, at):
        return len({w for _, z, w, a, flags in rows if z == zone and a[:10] == at[:10] and w != worker and not flags})
    assert sorted((r.claim_sk, r.clean_neighbours, r.consensus) for r in found) == sorted(
        (i, n, n >= 2) for i, zone, worker, at, _ in rows if zone and worker for n in [neighbours(zone, worker, at)])
    counted = scored.select("claim_sk", "pincode", "worker_id", "created_at", F.size("flags").alias("n"))
    again = extensions.zone_consensus(counted, neighbours=2, n_flags="n").collect()
    assert sorted((r.claim_sk, r.consensus) for r in again) == sorted((r.claim_sk, r.consensus) for r in found)
