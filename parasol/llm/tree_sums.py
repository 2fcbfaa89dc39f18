"""Subtree totals of a forest by parallel tree contraction.

A round has two steps. *Rake*: leaves hand their totals to their parents, added up
inside map tasks first, and go. *Compress*: of the nodes left with one child, an
independent set (those that outrank their neighbours by a hash of key and round) is
taken out; the child moves up to its grandparent and brings along what it now also
stands for. Both shrink the tree by a share whatever its shape, so the rounds
grow with the logarithm of the nodes, not with the depth. Then the rounds are gone
through backwards: a node taken out gets its child's total and its own.

Joins within a round are between keys that occur once on either side, so a node with
very many children is no hot key. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parasol.session import materialized


def _rake(alive: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that had children, with the totals of those that were leaves; ``only`` is a remaining child."""
    leaf = F.col("n") == 0
    handed = alive.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(
        *[F.sum(F.when(leaf, F.col(v) + F.col(f"{v}_extra")).otherwise(0)).alias(f"{v}_got") for v in values],
        F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("key"))).alias("only"))
    kept = alive.where("n > 0").join(handed, F.col("key") == F.col("at"))
    return kept.select("key", "parent", F.col("left").alias("n"), "only", *[(F.col(v) + F.col(f"{v}_got")).alias(v) for v in values],
                       *[f"{v}_extra" for v in values])


def _taken_out(rest: DataFrame, values: list[str], nth: int) -> DataFrame:
    """An independent set of the nodes with one child; roots stay."""
    chain = rest.where("n = 1 and parent is not null").withColumn("rank", F.struct(F.xxhash64("key", F.lit(nth)), "key"))
    above = chain.select(F.col("only").alias("below"), F.col("rank").alias("rank_above"), F.col("key").alias("key_above"))
    loser = F.when(F.col("rank_above") > F.col("rank"), F.col("key")).otherwise(F.col("key_above"))
    losers = chain.join(above, F.col("key") == F.col("below")).select(loser.alias("key")).distinct()
    return chain.join(losers, "key", "left_anti").drop("rank", "n")


def _spliced(rest: DataFrame, out: DataFrame, values: list[str]) -> DataFrame:
    """``rest`` without the nodes taken out, their children under their parents."""
    gone = out.select(F.col("key").alias("gone"))
    moved = out.select(F.col("only").alias("moved"), F.col("parent").alias("up"),
                       *[(F.col(v) + F.col(f"{v}_extra")).alias(f"{v}_up") for v in values])
    left = rest.join(gone, F.col("key") == F.col("gone"), "left_anti").join(moved, F.col("key") == F.col("moved"), "left")
    return left.select("key", F.coalesce("up", "parent").alias("parent"), "n", *values,
                       *[(F.col(f"{v}_extra") + F.coalesce(f"{v}_up", F.lit(0))).alias(f"{v}_extra") for v in values])


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(key, values): each node's totals over its subtree, itself included.

    ``tree`` has key (unique), parent (null for a root) and the values, which are numbers and not null.
    """
    tree = tree.select("key", "parent", *values)
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("kids"))
    alive = materialized(tree.join(children, F.col("key") == F.col("at"), "left").select(
        "key", "parent", F.coalesce("kids", F.lit(0)).alias("n"), *[F.col(v).cast("bigint").alias(v) for v in values],
        *[F.lit(0).cast("bigint").alias(f"{v}_extra") for v in values]), "trie-nodes")
    rounds = []
    while not alive.where("n > 0").isEmpty():
        rest = materialized(_rake(alive, values), "trie-raked")
        out = materialized(_taken_out(rest, values, len(rounds)), "trie-out")
        rounds.append((alive, rest, out))
        alive = materialized(_spliced(rest, out, values), "trie-alive")
    known = alive.select("key", *values)
    for leaves, rest, out in reversed(rounds):
        extras = rest.select(F.col("key").alias("at"), *[F.col(f"{v}_extra").alias(f"{v}_below") for v in values])
        totals = known.select(F.col("key").alias("known"), *[F.col(v).alias(f"{v}_total") for v in values])
        found = out.join(extras, F.col("only") == F.col("at")).join(totals, F.col("only") == F.col("known"))
        found = materialized(found.select("key", *[(F.col(v) + F.col(f"{v}_below") + F.col(f"{v}_total")).alias(v) for v in values]), "trie-totals")
        known = known.unionByName(found).unionByName(leaves.where("n = 0").select("key", *values))
    return known
