"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

1. *Heap file.* Every row's normalised text, its 64-bit hash and its SHA-256 are
   written once to the shared folder. Later steps read the columns they need.
2. *Chains.* Rows meet by (hash, bytes): Spark compares the text itself, so two
   texts that collide on the hash become two links of that hash's chain. Copies
   are counted inside each map task first, so a group that holds a third of all
   rows sends one row per map task.
3. *Directory.* The distinct hashes are counted by their leading bits. Starting
   with one bucket, every bucket with more than ``capacity`` hashes splits on
   the next bit (the directory doubles) until none is overfull or
   ``directory_bits`` are used. Buckets are ranges of the hash.
4. *Owners.* A chain's rows are sent to the task owning their bucket, which
   numbers the links of each chain and writes the bucket's index records.

Null texts count as empty. Repeated rows (same id and text) are members of their
group like any other; each bears the same verdict. A null id never wins over
another id. An empty table gives an empty index. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from parasol.llm.common import ROW_KEY, ascii_lower, keep_rows, row_key
from parasol.session import materialized

CAPACITY = 4096
DIRECTORY_BITS = 16


@dataclass
class HashIndex:
    heap: DataFrame       # one row per document: id, hash, digest, row key (and the text, on disk)
    directory: DataFrame  # one row per bucket: depth, prefix, n_hashes
    records: DataFrame    # one row per distinct text: bucket, hash, slot, digest, keep_id, group_size


def split_buckets(hashes: DataFrame, capacity: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Buckets, and the bucket of each cell of ``bits`` leading bits, from a column ``hash``.

    Every cell is counted at each depth of its path. A node is a bucket if it is
    not overfull, or at full depth, and its parent was overfull: what doubling
    the directory bit by bit arrives at, in one aggregation of at most
    ``bits * 2**bits`` rows.
    """
    cell = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    cells = hashes.groupBy(cell.alias("cell")).agg(F.count_distinct("hash").alias("n"))
    paths = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    # expr: the shift differs by row
    paths = paths.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    nodes = paths.groupBy("depth", "prefix").agg(F.sum("n").alias("n_hashes"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("n_hashes").alias("n_above"))
    leaves = (
        nodes.withColumn("above", F.shiftright("prefix", 1))
        .join(parents, ["depth", "above"], "left")
        .where(((F.col("n_hashes") <= capacity) | (F.col("depth") == bits))
               & ((F.col("depth") == 0) | (F.col("n_above") > capacity)))
        .select("depth", "prefix", "n_hashes")
    )
    # Merged: Spark takes the exploded paths for one row a cell and would send them out.
    owners = paths.join(leaves.select("depth", "prefix").hint("merge"), ["depth", "prefix"]).select("cell", "depth", "prefix")
    return leaves, owners


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, directory_bits: int = DIRECTORY_BITS) -> HashIndex:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *row_key(id_col, text_col))
    heap = materialized(rows.select("*", F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("digest")), "dedup-heap")
    texts = heap.groupBy("hash", "digest", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = materialized(
        texts.select("hash", "digest", F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size"),
        "dedup-chains")
    directory, owners = split_buckets(chains.select("hash"), capacity, directory_bits)
    owners = materialized(owners, "dedup-directory")
    owned = (
        chains.withColumn("cell", F.shiftrightunsigned("hash", 64 - directory_bits).cast("int"))
        .join(owners, "cell")
        .withColumn("bucket", F.struct("depth", "prefix"))
        .repartition("bucket")
    )
    slot = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest")) - 1
    records = owned.select("bucket", "hash", slot.alias("slot"), "digest", "n_bytes", "keep_id", "group_size")
    return HashIndex(heap.select("id", "hash", "digest", *ROW_KEY), directory, materialized(records, "dedup-records"))


def members(index: HashIndex) -> DataFrame:
    """One row per document with its group: id, hash, slot, digest, keep_id, group_size, kept."""
    found = index.heap.join(index.records.drop("bucket"), ["hash", "digest"])
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id that stays for its text, the number of rows with that text, whether this is it."""
    return members(build_index(docs, id_col, text_col)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"),
        F.col("slot").alias("chain_slot"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per text: that of the largest id; of repeated rows, one."""
    kept = members(build_index(docs, id_col, text_col)).where("kept")
    first = F.min(F.struct(*ROW_KEY)).alias("row")  # rows of one id whose texts differ in case
    return keep_rows(docs, kept.groupBy("hash", "digest").agg(first).select("row.*"), id_col, text_col)
