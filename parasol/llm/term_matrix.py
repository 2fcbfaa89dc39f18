"""A sparse document-term matrix in CSR shards over one global dictionary of words.

*Shards.* A task cuts its documents into runs of a few megabytes. Each becomes a
shard: a CSR matrix over the shard's own distinct words, written once.
*Dictionary.* The shards' distinct words go to hash buckets (one row a shard and
bucket), where equal words get one number: the word's rank in its bucket, times the
buckets, plus the bucket. It depends on the set of words alone, so a task done
again gives the same. A word arrives at most once per shard, however frequent it
is in the texts, so no word is hot.
*Columns.* Each shard meets its words' numbers again and replaces its own columns.

A shard's row: ``shard``, ``rows`` (the kept columns of its documents, in order),
``indptr`` and ``indices`` (little-endian 64-bit) and ``counts`` (32-bit) of the CSR
matrix, where ``indices`` are the dictionary's numbers.

Null text counts as empty, a row of the matrix without entries. A very long text is
a shard of its own. Repeated rows are rows of their own. No documents, no shards.
Columns not kept are ignored, kept ones may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.word_arrays import batch_words, byte_class, slices
from parasol.session import scratch_path

BUCKETS = 1024  # of the dictionary; a bucket is numbered by one sort
SHARD_BYTES = 16 << 20
READ_BYTES = 4 << 20  # of text whose words are found at once
SHARDS_A_TASK = 1 << 24
WHITE = " \t\n\x0b\x0c\r"
CSR = "indptr binary, indices binary, counts binary"

ship_by_value(__name__)


def shard_words(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes in text order, the distinct words, and the number of words of each text."""
    parts, lengths = [], []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", READ_BYTES):
        codes, words, bounds = batch_words(part["text"], word_bytes)
        parts.append(pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), words))
        lengths.append(np.diff(bounds))
    whole = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
    return whole.indices.to_numpy(), whole.dictionary, np.concatenate(lengths)


def local_shards(docs: DataFrame, text_col: str, keep: list[Column], buckets: int) -> DataFrame:
    """Shards over their own words: column k is the k-th word of ``words``, which lists the words of each bucket; ``starts`` has each list's first k."""
    word_bytes = byte_class(lambda c: c not in WHITE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() * SHARDS_A_TASK
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                n = part.num_rows
                codes, words, lengths = shard_words(part["text"], word_bytes)
                bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words.to_pylist()], np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                width = max(len(words), 1)
                cells = place[codes]
                cells += np.repeat(np.arange(n) * width, lengths)
                cells, counts = np.unique(cells, return_counts=True)
                indptr = np.searchsorted(cells, np.arange(n + 1) * width)
                starts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(starts, words.take(pa.array(order)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.ListArray.from_arrays([0, n], part["row"]), pa.ListArray.from_arrays([0, buckets], lists),
                     pa.ListArray.from_arrays([0, buckets], pa.array(starts[:-1])), pa.array([indptr.astype("<i8").tobytes()]), pa.array([(cells % width).astype("<i4").tobytes()]),
                     pa.array([counts.astype("<i4").tobytes()])], ["shard", "rows", "words", "starts", "indptr", "indices", "counts"])
                shard += 1

    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"shard bigint, rows array<{kind}>, words array<array<string>>, starts array<int>, {CSR}")


def numbered_words(shards: DataFrame, buckets: int) -> DataFrame:
    """(shard, place, word, number) of every distinct word of every shard."""
    lists = shards.select("shard", "starts", F.posexplode("words").alias("bucket", "list"))
    packed = lists.where(F.size("list") > 0).select("shard", "bucket", F.col("starts")[F.col("bucket")].alias("start"), "list")
    words = packed.repartition("bucket").select("shard", "bucket", "start", F.posexplode("list").alias("nth", "word"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("bigint")
    return words.select("shard", (F.col("start") + F.col("nth")).alias("place"), "word",
                        ((rank - 1) * buckets + F.col("bucket")).alias("number"))


def over_shards(docs: DataFrame, text_col: str, keep: list[Column] | None, buckets: int, fn, schema) -> DataFrame:
    """``fn`` of every shard, a table of one row, in the task that gives it its global columns. ``schema`` follows from that of the rows."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if keep is None else keep
    path = scratch_path(docs.sparkSession, "term-shards")
    local = local_shards(docs, text_col, keep, buckets)
    local.write.option("compression", "zstd").parquet(path)
    shards = docs.sparkSession.read.schema(local.schema).parquet(path)

    def renumbered(shard: pa.Table, words: pa.Table) -> pa.Table:
        number = np.empty(words.num_rows, np.int64)
        number[words["place"].to_numpy()] = words["number"].to_numpy()
        indices = np.frombuffer(shard["indices"][0].as_py(), "<i4")
        at = shard.schema.get_field_index("indices")
        return fn(shard.set_column(at, "indices", pa.array([number[indices].astype("<i8").tobytes()])))

    numbers = numbered_words(shards, buckets).select("shard", "place", "number")
    left = shards.select("shard", "rows", "indptr", "indices", "counts").groupBy("shard")
    return left.cogroup(numbers.groupBy("shard")).applyInArrow(renumbered, schema(shards.schema["rows"].dataType))


def document_term_matrix(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """CSR shards of all documents over global columns. ``keep`` are the columns the rows carry, all but the text unless given."""
    return over_shards(docs, text_col, keep, buckets, lambda shard: shard, lambda rows: f"shard bigint, rows {rows.simpleString()}, {CSR}")


def row_measures(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The kept columns of every document with n_words (its row's sum in the matrix) and n_distinct (its row's entries)."""
    def measured(shard: pa.Table) -> pa.Table:
        rows = shard["rows"].combine_chunks()
        indptr, counts = (np.frombuffer(shard[c][0].as_py(), kind) for c, kind in (("indptr", "<i8"), ("counts", "<i4")))
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[indptr]
        names = [f.name for f in rows.type.value_type]
        return pa.Table.from_arrays([*rows.flatten().flatten(), pa.array(np.diff(sums)), pa.array(np.diff(indptr))], [*names, "n_words", "n_distinct"])

    return over_shards(docs, text_col, keep, buckets, measured, lambda rows: ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.elementType.fields) + ", n_words bigint, n_distinct bigint")


def dictionary(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(word, number) of every distinct word, as in the matrix."""
    return numbered_words(local_shards(docs, text_col, [F.lit(1)], buckets), buckets).select("word", "number").distinct()
