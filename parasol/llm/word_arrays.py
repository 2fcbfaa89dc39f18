"""Words of a whole Arrow batch at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parasol.llm.common import ship_by_value

ship_by_value(__name__)


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans: the bytes that belong to words. Bytes from 0x80 on are parts of other characters."""
    return np.array([b >= 0x80 or keep(chr(b)) for b in range(256)])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each text starts in them (one more entry than texts)."""
    texts = pa.concat_arrays([texts])
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]).astype(np.int64)


def _coded(raw: np.ndarray, kept: np.ndarray, begins: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    starts = np.flatnonzero(begins)
    rank = np.zeros(len(kept) + 1, np.int32 if len(kept) < 1 << 31 else np.int64)  # of each byte among those kept
    np.cumsum(kept, out=rank[1:])
    offsets = np.append(rank[starts], rank[-1]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kept].tobytes())).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, np.searchsorted(starts, bounds)


def batch_words(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes in text order, the distinct words, and where each text's words start (one more entry than texts).

    Words are runs of ``word_bytes`` in the UTF-8 text; null texts have none.
    """
    raw, bounds = _raw(texts)
    inside = word_bytes[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    begins[cuts] = inside[cuts]  # a word never runs on into the next text
    return _coded(raw, inside, begins, bounds)


def batch_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Like ``batch_words`` for the pieces that texts fall into when cut before each space that is followed by a
    character certain not to be white space."""
    raw, bounds = _raw(texts)
    lead = np.zeros(256, bool)
    lead[0x21:0x7F] = lead[0xC3:0xF5] = True
    lead[[0xE1, 0xE2, 0xE3]] = False  # with 0xC2 the first bytes of all white space beyond ASCII
    begins = np.zeros(len(raw), bool)
    begins[:-1] = (raw[:-1] == 0x20) & lead[raw[1:]]
    begins[bounds[1:-1][bounds[1:-1] < len(raw)] - 1] &= False  # the space that ends a text has nothing after it
    begins[bounds[:-1][bounds[:-1] < len(raw)]] = True
    return _coded(raw, np.ones(len(raw), bool), begins, bounds)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about ``most_bytes``; one longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
