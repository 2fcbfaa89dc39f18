"""Benchmark decontamination with a distributed positional inverted index.

*Index.* Training texts are tokenised in segments of a few megabytes. A segment
is one row of a table in the shared folder: its documents, its terms and, for
each term, the ascending positions at which it stands (stored as differences).
Documents lie one after the other in the segment's position space with one
position left free between them, so no run of words crosses documents. Every
token of every text is posted. Segments are bounded by bytes, not by terms, so
a very common word never gathers in one place.

*Search.* Test texts are cut into phrases (``window`` words, or the whole text
if shorter). In each segment, phrases with a term the segment lacks are out at
once. For the others the posting lists are intersected from the rarest term of
the phrase on: its positions, less the term's offset in the phrase, are the
candidate starts, and each further term, in order of rarity, keeps the starts
at which it stands at its own offset. With ``slop`` the words must stand in
order with at most that many other words between them in all. Segments are
searched independently; nothing is shuffled.

*Test set.* It is sent to the tasks in parts of about ``PART_BYTES`` of text; a
larger set is searched part after part and the spans found are merged.

Null texts have no words. Documents without words are returned with zeros, also
repeated rows, each for itself. Test rows without words match nothing; a null
item id is reported as ``null``; equal ids are one item. Further columns are
ignored. Ids of items are compared and reported as strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import ROW_KEY, ascii_lower, by_place, row_key, ship_by_value
from parasol.llm.word_arrays import batch_words, byte_class, slices
from parasol.session import scratch_path

ship_by_value(__name__)

WINDOW = 13
SEGMENT_BYTES = 8 << 20
FILE_SEGMENTS = 4  # Spark's Parquet reader holds up to 4,096 rows of a file at once, a whole file of segments
PART_BYTES = 2 << 20
WORD_BYTES = byte_class(lambda c: c.islower() or c.isdigit())


def _planes(deltas: np.ndarray) -> bytes:
    """Small numbers byte by byte: all lowest bytes, then all next ones, which compress to almost nothing."""
    return deltas.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all texts, written to the shared folder: one row per segment."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["segment", "id", *ROW_KEY, "starts", "n_words", "terms", "counts", "postings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                codes, terms, bounds = batch_words(part["text"], WORD_BYTES)
                n_words = np.diff(bounds)
                starts = bounds[:-1] + np.arange(part.num_rows)
                positions = np.arange(len(codes)) + np.repeat(np.arange(part.num_rows), n_words)
                counts = np.bincount(codes, minlength=len(terms))
                listed = positions[np.argsort(codes, kind="stable")]
                firsts = np.cumsum(counts) - counts
                deltas = np.diff(listed, prepend=0)
                deltas[firsts] = listed[firsts]
                lists = [part[c] for c in ("id", *ROW_KEY)] + [pa.array(starts), pa.array(n_words), terms.cast(pa.string()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex])]
                    + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                    + [pa.array([_planes(deltas)], pa.binary())], names)

    schema = (f"segment string, id array<{kind}>, {ROW_KEY[0]} array<bigint>, {ROW_KEY[1]} array<bigint>, "
              "starts array<bigint>, n_words array<bigint>, terms array<string>, counts array<bigint>, postings binary")
    path = scratch_path(docs.sparkSession, "positional-index")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_SEGMENTS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def cut_phrases(items: list[str], texts: pa.Array, window: int) -> SimpleNamespace:
    """The phrases of a part of the test set as arrays: terms by offset (-1 past the end), and their items."""
    codes, terms, bounds = batch_words(texts, WORD_BYTES)
    names = sorted(set(items))
    number = {item: i for i, item in enumerate(names)}
    found: dict[tuple, set[int]] = {}
    for item, a, b in zip(items, bounds, bounds[1:]):
        words = codes[a:b].tolist()
        for at in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[at:at + window]), set()).add(number[item])
    table = np.full((len(found), window), -1, np.int32)
    for i, phrase in enumerate(found):
        table[i, :len(phrase)] = phrase
    return SimpleNamespace(
        terms=terms.cast(pa.string()), words=table, size=np.array([len(p) for p in found], np.int64), items=names,
        item_ends=np.cumsum([0] + [len(v) for v in found.values()]),
        item_of=np.array([i for v in found.values() for i in sorted(v)], np.int64))


class Segment:
    """One segment's postings as one ascending array of (term, position)."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, postings: bytes, starts: np.ndarray):
        deltas = _from_planes(postings)
        ends = np.cumsum(counts)
        self.terms, self.counts, self.firsts, self.starts = terms, counts, ends - counts, starts
        running = np.cumsum(deltas)
        base = (running - deltas)[self.firsts] if len(counts) else running
        self.positions = running - np.repeat(base, counts)
        self.keys = np.repeat(np.arange(len(counts)), counts) << 32 | self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term << 32 | np.maximum(position, 0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (position >= 0)

    def following(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first position of a term after ``position``; a far one if there is none."""
        at = np.searchsorted(self.keys, term << 32 | position, side="right")
        near = np.minimum(at, len(self.keys) - 1)
        return np.where((at < len(self.keys)) & (self.keys[near] >> 32 == term), self.positions[near], 1 << 31)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def matches(self, phrases: SimpleNamespace, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, end) of every match; end is past the last word."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(phrases.size):
            return none, none, none
        own = pc.index_in(phrases.terms, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)
        used = phrases.words >= 0
        term = np.where(used, own[phrases.words], 0)
        alive = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
        term, used = term[alive], used[alive]
        rarity = np.where(used, self.counts[term], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")  # offsets of each phrase, the rarest term first
        row = np.arange(len(alive))
        n = self.counts[term[row, order[:, 0]]]
        phrase = np.repeat(row, n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.firsts[term[row, order[:, 0]]], n)
        start = self.positions[posting] - order[phrase, 0]
        if slop:
            return self._near(phrases.size[alive], alive, term, phrase, start, slop)
        for rank in range(1, order.shape[1]):
            offset = order[phrase, rank]
            keep = ~used[phrase, offset] | self.has(term[phrase, offset], start + offset)
            phrase, start = phrase[keep], start[keep]
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        return alive[phrase], start, start + phrases.size[alive][phrase]

    def _near(self, size, alive, term, phrase, latest, slop):
        """Matches with up to ``slop`` words between: from every first word near enough to a rarest word, greedily."""
        first = term[phrase, 0]
        a = np.searchsorted(self.keys, first << 32 | np.maximum(latest - slop, 0))
        b = np.searchsorted(self.keys, first << 32 | np.maximum(latest, 0), side="right")
        n = np.where(latest >= 0, b - a, 0)
        phrase = np.repeat(phrase, n)
        start = self.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        pair = np.unique(phrase << 32 | start)
        phrase, start = pair >> 32, pair & 0xFFFFFFFF
        last = start.copy()
        for offset in range(1, term.shape[1]):
            more = offset < size[phrase]
            last = np.where(more, self.following(term[phrase, offset], last), last)
            keep = last - start <= offset + slop
            phrase, start, last = phrase[keep], start[keep], last[keep]
        keep = self.document(start) == self.document(last)
        return alive[phrase[keep]], start[keep], last[keep] + 1


def _search_part(index: DataFrame, phrases: SimpleNamespace, slop: int) -> DataFrame:
    shipped = index.sparkSession.sparkContext.broadcast(phrases)
    kind = index.schema["id"].dataType.elementType.simpleString()
    names = ["segment", "nth", "id", *ROW_KEY, "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                lists = {c: row[c].values for c in ("id", *ROW_KEY, "starts", "n_words", "terms", "counts")}
                starts, n_docs = lists["starts"].to_numpy(), len(lists["starts"])
                segment = Segment(lists["terms"], lists["counts"].to_numpy(), row["postings"].as_buffer(), starts)
                phrase, begin, end = segment.matches(test, slop)
                covered = np.zeros(len(segment.positions) + n_docs + 2, np.int32)
                np.add.at(covered, begin, 1)
                np.add.at(covered, end, -1)
                covered = np.cumsum(covered) > 0
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                runs = edges.reshape(-1, 2)
                owner = segment.document(runs[:, 0])
                within = runs - starts[owner][:, None]
                n_items = np.diff(test.item_ends)[phrase]
                flat = np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items) + np.repeat(test.item_ends[phrase], n_items)
                pairs = np.unique(np.repeat(segment.document(begin), n_items) << 32 | test.item_of[flat]) if len(phrase) else np.zeros(0, np.int64)
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(n_docs + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(within[:, 0]), pa.array(within[:, 1])], ["start", "end"]))
                items = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(pairs >> 32, np.arange(n_docs + 1)), pa.int32()),
                    pa.array(test.items, pa.string()).take(pa.array(pairs & 0xFFFFFFFF)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"].as_py()] * n_docs, pa.string()), pa.array(np.arange(n_docs))]
                    + [lists[c] for c in ("id", *ROW_KEY, "n_words")] + [spans, items], names)

    return index.mapInArrow(
        run, f"segment string, nth bigint, id {kind}, {ROW_KEY[0]} bigint, {ROW_KEY[1]} bigint, n_words bigint, "
             "spans array<struct<start: bigint, end: bigint>>, items array<string>")


def search(index: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, slop: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every indexed document with the spans of its words that match test phrases, and the items these belong to.

    Spans are [start, end) in words, ascending, and do not touch one another.
    """
    tests = tests.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                         ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    n_parts = 1 + int(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes
    found = None
    for part in range(n_parts):
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == part).toArrow()
        phrases = cut_phrases(rows["item"].to_pylist(), rows["text"].combine_chunks(), window)
        hits = _search_part(index, phrases, slop)
        found = hits if found is None else found.unionAll(hits)
    if n_parts == 1:
        return found.drop("segment", "nth")
    merged = found.groupBy("segment", "nth").agg(
        *[F.first(c).alias(c) for c in ("id", *ROW_KEY, "n_words")],
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = """aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).end >= s.start,
           concat(slice(done, 1, size(done) - 1),
                  array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))"""
    return merged.withColumn("spans", F.expr(joined)).drop("segment", "nth")


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Per document: id, row key, n_words, n_hit, n_items, items (sorted) and whether at least one word in ``one_in`` is hit."""
    found = search(build_index(docs, id_col, text_col), tests, window=window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("id", *ROW_KEY, "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))
    return found.select("*", F.size("items").cast("bigint").alias("n_items"),
                        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows. A row's verdict depends on its text alone, so repeated rows share it."""
    bad = contamination(docs, tests, id_col, text_col, window, one_in).where("contaminated").select(*ROW_KEY).distinct()
    rows, of = by_place(docs, id_col, text_col)
    kept = rows.select("*", *row_key(*of)).join(bad, ROW_KEY, "left_anti")
    return kept.select(*rows.columns).toDF(*docs.columns)
