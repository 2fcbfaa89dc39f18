"""The trie of conversation prefixes and tree contraction, held to plain recursion."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from parasol.llm import conversation_trie
from parasol.llm.tree_sums import subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def test_subtree_sums_of_chains_stars_and_random_trees(spark):
    pick = random.Random(2)
    parents = {0: None} | {i: i - 1 for i in range(1, 70)} | {i: 0 for i in range(70, 200)} | {i: pick.randrange(i) for i in range(200, 350)}
    parents |= {1000: None, 1001: 1000, 2000: None}
    values = {k: (pick.randint(-5, 50), 1) for k in parents}
    rows = [(str(k), None if p is None else str(p), *values[k]) for k, p in parents.items()]
    found = {int(r.key): (r.a, r.b) for r in subtree_sums(spark.createDataFrame(rows, "key string, parent string, a long, b long"), ["a", "b"]).collect()}
    want = {k: [0, 0] for k in parents}
    for k in parents:
        at = k
        while at is not None:
            want[at][0] += values[k][0]
            want[at][1] += values[k][1]
            at = parents[at]
    assert found == {k: tuple(v) for k, v in want.items()}


def by_hand(rows, family=5, most=9):
    """The trie as a dictionary of prefixes, children found by looking at all of them."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            original.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    original = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in original.items()}
    convs = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        convs[c] = original.get(base, [])[:h] + original[c][h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    found = []
    for prefix, inside in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(1 for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(prefix))))
        found.append((min(inside), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(inside), len(children), leaves, saved,
                      hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def nodes(spark, rows):
    talks = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("depth", F.lit("x")).withColumn("n", F.lit(2)).repartition(3)
    found = conversation_trie.prefix_trie(*conversation_trie.rebuilt(talks))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CELL", 4)
    monkeypatch.setattr(conversation_trie, "RUN", 3)
    pick = random.Random(12)
    says = ["hi", "Hi", "", None, "漢字", "a:b", "long " * 3000]
    rows = []
    for c in [*range(30), 1006, 1007, -3, -4, -5, 2**40]:
        if c in (5, 10):
            continue  # families without their first conversation
        for turn in range(pick.choice([1, 2, 3, 6, 9, 13])):
            rows.append((c, pick.choice([turn, turn, turn, None]), pick.choice(["user", "user", None, ""]), pick.choice(says) if pick.random() < 0.3 else "go on"))
    rows += [(c, t, "user", "same") for c in range(3000, 3030) for t in range(3)]
    rows += [(7, 1, "user", "again")] * 2 + [(None, 1, "user", "nobody's")]
    rows += [(4000 + k, t, "a", f"turn {t}" if t < 37 + k else f"{k}") for k in (0, 5, 10) for t in range(45)]
    assert nodes(spark, rows) == by_hand(rows)


def test_no_conversations_no_root(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []
