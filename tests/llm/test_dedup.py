"""Exact and near copies against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from odd import TEXTS, documents, nothing

from parasol.llm import exact_dedup, simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups_of_odd_rows(spark):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(UP)].append(i)
    want = []
    for i, t in TEXTS:
        norm = (t or "").translate(UP)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_exact_survivors_are_whole_rows_and_unique(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 7, 8, 9, 10]
    assert exact_dedup.drop_exact_duplicates(nothing(spark)).count() == 0
    assert exact_dedup.exact_duplicates(nothing(spark)).count() == 0


def test_buckets_double_until_none_is_overfull(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id) as hash")
    buckets, owners = exact_dedup.split_buckets(hashes, 100, 12)
    rows = buckets.collect()
    assert sum(r.n_hashes for r in rows) == 5000 and all(r.n_hashes <= 100 for r in rows)
    # A bucket's parent was overfull, and every cell has one owner.
    counts = defaultdict(int)
    for (h,) in hashes.collect():
        for d in range(13):
            counts[d, (h % (1 << 64)) >> (64 - d)] += 1
    assert all(counts[r.depth, r.prefix] == r.n_hashes and counts[r.depth - 1, r.prefix >> 1] > 100 for r in rows)
    assert owners.count() == owners.select("cell").distinct().count() == len({(h % (1 << 64)) >> 52 for (h,) in hashes.collect()})


def test_colliding_hashes_are_chained(spark):
    index = exact_dedup.build_index(documents(spark))
    slots = index.records.groupBy("hash").count().collect()
    assert all(r["count"] == 1 for r in slots) and index.records.where("slot <> 0").count() == 0


def brute_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    nodes = sorted(set(prints))
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    array = np.array(nodes, np.uint64)
    for i, n in enumerate(nodes):
        near = np.bitwise_count(array ^ np.uint64(n)) <= bits
        for j in np.flatnonzero(near):
            parent[root(n)] = root(nodes[int(j)])
    return {n: root(n) for n in nodes}


def test_spark_hash_is_the_contract_hash(spark):
    assert spark.sql("select xxhash64('a b c d') as h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
def test_links_of_fingerprints_lose_none(spark, bits):
    pick = random.Random(bits)
    prints = [pick.getrandbits(64) for _ in range(150)] + [0]
    for _ in range(8):  # clouds around a centre, chains, and prints that share segments
        centre = pick.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in pick.sample(range(64), pick.randint(0, 5)):
                p ^= 1 << b
            prints.append(p)
    walk = prints[0]
    for _ in range(40):
        walk ^= 1 << pick.randrange(64)
        prints.append(walk)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    roots = {r.node: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
    want = brute_components([p % (1 << 64) for p in signed], bits)
    classes = defaultdict(set)
    for p in signed:
        classes[want[p % (1 << 64)]].add(roots.get(p, p))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    prints = [(i, brute_fingerprint(t, 4)) for i, t in TEXTS]
    roots = brute_components([p for _, p in prints], 4)
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[roots[p]].append(i)
    want = sorted(str((i, p, min(least[roots[p]], default=None))) for i, p in prints)
    assert want == sorted(str((r.id, r.fp % (1 << 64), r.component_id)) for r in got)
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({min(v) for v in least.values()})
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


def sent_out(plan, sides):
    chosen = plan._jdf.queryExecution().sparkPlan().toString()
    return [line for line in chosen.splitlines() if f"BroadcastHashJoin [{sides}" in line]


def test_exploded_fingerprints_are_not_sent_out(spark, monkeypatch):
    """Spark sizes exploded rows by the rows before, so a few megabytes of fingerprints went to the driver 64 times over."""
    plans, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges, name: plans.append(edges) or found(edges, name))
    nodes = spark.range(3000).selectExpr("xxhash64(id div 3) + id % 3 AS fp", "id AS least").localCheckpoint()
    assert simhash.link_fingerprints(nodes, 4).count() > 0
    assert len(plans) == 2 and not any(sent_out(p, "key") for p in plans)


def test_exploded_paths_are_not_sent_out(spark):
    _, owners = exact_dedup.split_buckets(spark.range(500).selectExpr("xxhash64(id) AS hash").localCheckpoint(), 4, 8)
    assert not [line for line in sent_out(owners, "depth") if "above" not in line]
