"""SimHash near-dedup with deletion-variant signatures.

*Fingerprints.* Every text's word shingles are hashed (XXH64, seed 42) and each
bit of the 64-bit fingerprint is 1 if set in over half the hashes.

*Candidates.* Fingerprints that differ in at most ``k`` bits, cut into
``k // 2 + 1`` segments, have a segment that differs in at most one bit. So each
fingerprint is indexed under the variants of each segment with one bit left out
(64 in all, whatever ``k``); two fingerprints with a segment at most one bit
apart share a variant. Variants are joined by equality and verified by counting
the differing bits inside the join, so only true links leave it.

*Groups of copies.* Equal fingerprints are one node. Among the rest, a variant
key that thousands share must not be paired off. So links are found in two steps:

1. Of each key only its smallest and largest fingerprint are linked to the
   others (two aggregates with map-side combine), and components are formed.
2. Keys that still hold more than one component are searched, unless they hold
   three fingerprints or fewer: step 1 has compared all of those. Their rows
   outside the key's largest component are joined with all its rows. Every link
   between two components has such an end, so none is lost, and pairs inside a
   component are never formed.

Nulls count as empty texts. A text without words has fingerprint zero and links
like any other. Repeated rows are copies. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.common import ROW_KEY, keep_rows, row_key, ship_by_value
from parasol.llm.graph import components
from parasol.session import materialized

SEED = 42
TALLY_ROWS = 1 << 15  # hashes whose bits are counted at once

ship_by_value(__name__)


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of one text, unsigned. Words are runs without ASCII white space; A-Z are lower-cased."""
    import numpy as np
    import xxhash

    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    ends = ends[words - 1:] or [len(norm)]
    hashes = np.array([digest(norm[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), TALLY_ROWS):
        part = hashes[at:at + TALLY_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, the row key and the fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch["text"]]
            signed = pa.array([f - (1 << 64) if f >> 63 else f for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("id", *ROW_KEY)] + [signed], ["id", *ROW_KEY, "fp"])

    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {ROW_KEY[0]} bigint, {ROW_KEY[1]} bigint, fp bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the fewest segments of which one differs in at most one bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: Column, max_bits: int) -> Column:
    """The 64 one-wildcard segment variants of a fingerprint: (wildcard bit, segment without it) in one long."""
    found = []
    for first, size in segments(max_bits):
        for bit in range(first, first + size):
            mask = ((1 << size) - 1) << first & ~(1 << bit)
            part = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            # squeeze: the bits above the segment are zero, so a shift and the wildcard's number make a key
            key = F.shiftrightunsigned(part, first)
            found.append(F.shiftleft(key, 6).bitwiseOR(F.lit(bit)) if size <= 57 else F.xxhash64(key, F.lit(bit)))
    return F.array(*found)


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _edges(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def link_fingerprints(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(node, root) for the distinct fingerprints ``fp`` of ``nodes`` that are not their component's root."""
    keyed = nodes.select(F.explode(variants(F.col("fp"), max_bits)).alias("key"), "fp")
    ends = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last")
    to_first = (F.col("fp") != F.col("first")) & _near("fp", "first", max_bits)
    to_last = (F.col("fp") != F.col("last")) & _near("fp", "last", max_bits)
    # Spark takes the exploded rows for a 64th of what they are and would send them out, so it is told to sort and merge.
    stars = keyed.alias("k").join(ends.hint("merge").alias("e"), (F.col("k.key") == F.col("e.key")) & (to_first | to_last))
    both = F.explode(F.array("first", "last")).alias("end")
    stars = stars.select("fp", both).where((F.col("fp") != F.col("end")) & _near("fp", "end", max_bits))
    coarse = components(stars.select(*_edges("fp", "end")).distinct(), "simhash-stars")

    # A number for each component, larger for larger ones: log2 of its size, then any order. Written, so it stays.
    rooted = nodes.select("fp").join(coarse, F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", F.coalesce("root", "fp").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("size"))
    rank = F.shiftleft(F.least(F.floor(F.log2("size")), F.lit(31)).cast("long"), 57)
    numbered = materialized(sizes.select("root", (rank + F.monotonically_increasing_id()).alias("class")), "simhash-classes")
    rooted = materialized(rooted.join(numbered, "root"), "simhash-rooted")

    keyed = rooted.select(F.explode(variants(F.col("fp"), max_bits)).alias("key"), "fp", "root", "class")
    mixed = keyed.groupBy("key").agg(F.max("class").alias("pivot"), F.min("class").alias("low"), F.count("*").alias("n"))
    mixed = mixed.where("pivot <> low AND n > 3").select("key", "pivot")
    rest = keyed.alias("k").join(mixed.hint("merge").alias("m"), (F.col("k.key") == F.col("m.key")) & (F.col("class") < F.col("pivot")))
    rest = rest.select(F.col("k.key").alias("key"), F.col("fp").alias("fp_a"), F.col("root").alias("root_a"))
    cross = rest.alias("a").join(
        keyed.hint("merge").alias("b"),
        (F.col("a.key") == F.col("b.key")) & (F.col("root_a") != F.col("root")) & _near("fp_a", "fp", max_bits))
    bridges = cross.select(*_edges("root_a", "root")).distinct()
    return components(coarse.select(F.col("node").alias("hi"), F.col("root").alias("lo")).unionAll(bridges), "simhash-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 4, max_bits: int = 4) -> DataFrame:
    """Per document: id, row key, fingerprint ``fp`` (signed) and component_id, the smallest id reachable by links."""
    prints = materialized(with_fingerprints(docs, id_col, text_col, words), "simhash-prints")
    nodes = materialized(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = link_fingerprints(nodes, max_bits)
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row per component: that of the smallest id; of several rows of that id, one."""
    found = near_duplicates(docs, id_col, text_col, words, max_bits).where(F.col("id").eqNullSafe(F.col("component_id")))
    # Rows without an id have no component id to meet by; equal fingerprints still do.
    by = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    keys = found.groupBy(by.alias("by")).agg(F.min(F.struct(*ROW_KEY)).alias("row")).select("row.*")
    return keep_rows(docs, keys, id_col, text_col)
