"""The trie of conversation prefixes, with totals of every subtree.

*Order.* Turns get their place by one range sort of narrow rows (texts are reduced
to digests first) and the counts of each conversation in each sorted partition, so
a conversation of very many turns is spread over tasks. Turns of equal number stand
in the order of their digests.
*Keys.* A prefix's key is a digest chained turn by turn inside cells of ``CELL``
turns; what the cells before hand over is combined by doubling, in as many rounds
as the logarithm of the cells. Which digests a key is made of depends on its depth
alone, so equal prefixes have equal keys.
*Nodes* are the distinct keys. Subtree totals come from parallel tree contraction
(``tree_sums``): rake of leaves and compress of unary chains, then re-expansion.
*Ends.* The ids that end at a node are sorted, joined in short runs, and the runs
hashed one after another, so a node where very many end needs little memory.
*Parents.* A node finds its parent under the parent's key and a salt, so a parent
of very many children is no hot key.

Null role or text count as empty, a null turn stands first, rows without conv_id
belong to no conversation. Rows that repeat one another are turns of their own. A
very long text is one digest. Empty tables give no row, not even a root. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.tree_sums import subtree_sums
from parasol.session import materialized

CELL = 64
RUN = 400  # ids hashed as one row
SALTS = 16
PARTITION_BITS = 33  # of monotonically_increasing_id
ROOT = bytearray()  # the key of the prefix without turns
NOTHING = hashlib.sha256(b"").hexdigest()

ship_by_value(__name__)


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, at, digest, n_bytes) and runs (conv_id, part, start, before, n): a row of a run has place at - start + before + 1.

    A run is what one sorted partition holds of a conversation; ``n`` is the whole conversation's turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"))
    rows = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "digest").select(
        "conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("at"))
    rows = materialized(rows, "trie-turns").withColumn("part", F.shiftright("at", PARTITION_BITS))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("held"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, materialized(runs.select("conv_id", "part", "start", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"),
                                          F.sum("held").over(whole).alias("n")), "trie-runs")


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (conv_id, depth, digest, n_bytes, last) and (conv_id, length).

    Conversation c takes the first h turns of c - c % family, then its own after its first h, where h is
    crc32(c in decimal) % most.
    """
    rows, runs = ordered_turns(conversations)
    c = F.col("conv_id")
    ids = runs.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns(
        {"base": c - c % family, "h": F.crc32(c.cast("string").cast("binary")) % most})
    bases = ids.where(c % family == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    ids = materialized(ids.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
                       "trie-conversations")
    place = (F.col("at") - F.col("start") + F.col("before") + 1).alias("place")
    placed = runs.join(ids, "conv_id").drop("n").join(rows, ["conv_id", "part"]).select("*", place)
    own = placed.where("place > h").withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    heads = runs.where((c % family == 0) & (F.col("before") < most)).drop("n").join(rows, ["conv_id", "part"]).select("*", place)
    heads = heads.where(F.col("place") < most).select(c.alias("base"), F.col("place").alias("depth"), "digest", "n_bytes")
    heads = heads.join(ids, "base").where("depth <= h")
    columns = ["conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("length")).alias("last")]
    return own.select(*columns).unionByName(heads.select(*columns)), ids.select("conv_id", "length")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, n_bytes, last): the key of every prefix and of the prefix one turn shorter."""
    cell = F.floor((F.col("depth") - 1) / CELL)
    turn = F.struct("depth", "digest", "n_bytes", "last")
    cells = materialized(turns.groupBy("conv_id", cell.alias("cell")).agg(F.sort_array(F.collect_list(turn)).alias("turns")), "trie-cells")
    digests = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    full = cells.where(F.size("turns") == CELL).select("conv_id", "cell", F.unhex(F.sha2(digests, 256)).alias("sum"))
    deepest, step = cells.agg(F.max("cell")).first()[0] or 0, 1
    while step <= deepest:  # sums of the cells up to each, over twice as many in each round
        before = full.select("conv_id", (F.col("cell") + step).alias("cell"), F.col("sum").alias("sum_before"))
        both = F.when(F.col("sum_before").isNull(), F.col("sum")).otherwise(_sha(F.col("sum_before"), F.col("sum")))
        full = materialized(full.join(before, ["conv_id", "cell"], "left").select("conv_id", "cell", both.alias("sum")), "trie-sums")
        step *= 2
    starts = full.select("conv_id", (F.col("cell") + 1).alias("cell"), F.col("sum").alias("start"))
    joined = cells.join(starts, ["conv_id", "cell"], "left").join(full, ["conv_id", "cell"], "left")
    chain = F.aggregate("turns", F.array(F.coalesce("start", F.lit(ROOT))),
                        lambda keys, t: F.concat(keys, F.array(_sha(F.element_at(keys, -1), t["digest"]))))
    rows = joined.select("conv_id", "sum", chain.alias("keys"), "turns").select("conv_id", "sum", "keys", F.posexplode("turns").alias("i", "turn"))
    key = F.when(F.col("i") == CELL - 1, F.col("sum")).otherwise(F.col("keys")[F.col("i") + 1])
    return rows.select("conv_id", "turn.depth", key.alias("key"), F.col("keys")[F.col("i")].alias("parent"), "turn.n_bytes", "turn.last")


def id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as (key, first, ids): up to ``RUN`` ids in one row, joined by commas."""
    for batch in batches:
        found, at, ids = [], None, []
        for key, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
            if key != at or len(ids) == RUN:
                ids = []
                at = key
                found.append((key, conv, ids))
            ids.append(str(conv))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()),
                                          pa.array([",".join(f[2]) for f in found], pa.string())], ["key", "first", "ids"])


def hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as (key, digest of all ids of the key), holding one state at a time."""
    at, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
            if key != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations (key, conv_id) that end at each node."""
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(id_runs, "key binary, first bigint, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed_runs, "key binary, ends_sha256 string")


def with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``nodes`` with the parent's conv_id. ``children`` has each parent's key, n_children and, if it has one child, that."""
    parents = nodes.select("key", F.col("conv_id").alias("parent_conv_id")).join(children, "key")
    single = parents.where("n_children = 1").select(F.col("only").alias("key"), F.col("parent_conv_id").alias("of_one"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    many = parents.where("n_children > 1").select(F.col("key").alias("parent"), F.col("parent_conv_id").alias("of_many"), salts.alias("salt"))
    salted = nodes.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).join(many, ["parent", "salt"], "left")
    return salted.join(single, "key", "left").withColumn("parent_conv_id", F.coalesce("of_many", "of_one")).drop("salt", "of_many", "of_one")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (as ``rebuilt`` gives them) and the root of all ``members``."""
    rows = materialized(prefix_keys(turns), "trie-prefixes")
    nodes = rows.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                    F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
        F.lit(0).cast("bigint").alias("n_bytes"))
    nodes = materialized(nodes.unionByName(root), "trie-distinct")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.min("key").alias("only"))
    children = materialized(children, "trie-children")
    weighed = nodes.join(children.select("key", "n_children"), "key", "left").select(
        "key", "parent", F.col("n_children").isNull().cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    ends = rows.where("last").select("key", "conv_id").unionByName(members.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    parts = [children.select("key", "n_children"), totals, ends_digests(ends)]
    found = reduce(lambda df, part: df.join(part, "key", "left"), parts, with_parents(nodes, children))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
