"""Token counts with a whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each by itself. Most
pre-tokens are vocabulary strings. Which of those encode alone as just their own
one token is proven beforehand by encoding every vocabulary string with the
library (a merge order can make a vocabulary string unreachable; such strings
fail the proof). Texts are cut into pieces where a pre-token always begins, before a
space that a character other than white space follows. Each distinct piece of a
few megabytes of text is split by the public pattern once; proven pre-tokens
count one each, and only the others are merged by the library, and kept in a
bounded table.

A text with special strings goes to the library whole, which by default takes
each as one token; so does a piece with a character that the two pattern engines
class differently. Null counts as empty. Ties and repeated rows need no
care: every row is counted by itself. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.word_arrays import batch_pieces, slices

REMEMBERED = 200_000  # merged pre-tokens a task keeps; above that it starts anew
LONGEST_REMEMBERED = 64

ship_by_value(__name__)


def byte_strings() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


def vocabulary_texts(tokenizer) -> dict[int, str]:
    """The text of every vocabulary entry whose bytes are valid UTF-8."""
    by_char, found = byte_strings(), {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            found[number] = bytes(by_char[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
    return found


def whole_tokens(tokenizer) -> frozenset[str]:
    """The vocabulary strings that encode, alone, as exactly their own token."""
    texts = vocabulary_texts(tokenizer)
    encoded = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    return frozenset(t for (number, t), e in zip(texts.items(), encoded) if e.ids == [number])


@cache
def _unsafe_ranges(tokenizer_path: str, pattern: str) -> list[tuple[int, int]]:
    """Code points that ``pattern`` may not class as the library's splitter does, as ranges.

    Every assigned character is tried beside a letter, a digit and a space; those
    this interpreter knows no class for are taken as unsafe.
    """
    import regex
    from tokenizers import Tokenizer

    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    lines = [f"a{c}1{c} {c}x" for c in known]
    probe = "\n".join(lines)
    pre = Tokenizer.from_file(tokenizer_path).pre_tokenizer
    theirs = {span for _, span in pre.pre_tokenize_str(probe)}
    ours = {m.span() for m in regex.finditer(pattern, probe)}
    begins = list(accumulate((len(line) + 1 for line in lines), initial=0))
    disputed = {bisect_right(begins, a) - 1 for a, _ in theirs ^ ours}
    safe = [ord(c) for i, c in enumerate(known) if i not in disputed]
    return [(a + 1, b - 1) for a, b in zip([-1, *safe], [*safe, 0x110000]) if b - a > 1]


def unsafe_characters(tokenizer_path: str, pattern: str) -> str:
    """A character class of ``_unsafe_ranges`` without the surrogates, which no text holds."""
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _unsafe_ranges(tokenizer_path, pattern)) + "]"


class PieceCounter:
    """Tokens of pieces: one for each proven pre-token, the library's count for the others."""

    def __init__(self, tokenizer, pattern: str, whole: frozenset[str], unsafe: str):
        import regex

        self.tokenizer, self.split, self.odd = tokenizer, regex.compile(pattern).findall, re.compile(unsafe).search
        self.whole, self.known = whole, dict.fromkeys(whole, 1)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece; pieces hold no special string."""
        odd = {p for p in pieces if not p.isascii() and self.odd(p)}
        split = [[p] if p in odd else self.split(p) for p in pieces]
        if len(self.known) - len(self.whole) > REMEMBERED:
            self.known = dict.fromkeys(self.whole, 1)
        known = self.known
        rest = list({t for tokens in split for t in tokens if t not in known})
        found = dict(zip(rest, self.encoded(rest)))
        known.update(found)
        sums = [sum(map(known.__getitem__, tokens)) for tokens in split]
        for t in rest:
            if len(t) > LONGEST_REMEMBERED:
                del known[t]
        return sums


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row.

    ``tokenizer_path`` is a byte-level BPE file every executor can read, ``pattern`` its splitting pattern.
    The proven set has at most one entry per vocabulary string, so it is shipped whole.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(tokenizer_path)
    added = json.load(open(tokenizer_path))["added_tokens"]
    if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings that take in their surroundings are not supported")
    specials = [a["content"] for a in added]
    shipped = spark.sparkContext.broadcast((whole_tokens(tokenizer), unsafe_characters(tokenizer_path, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        counter = PieceCounter(Tokenizer.from_file(tokenizer_path), pattern, *shipped.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part["text"]
                special = np.zeros(len(texts), bool)
                for s in specials:
                    special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
                plain = pc.if_else(pa.array(special), "", texts)
                codes, pieces, bounds = batch_pieces(plain)
                tokens = np.array(counter.counts(pieces.to_pylist()), np.int64)
                running = np.concatenate([[0], np.cumsum(tokens[codes])]) if len(codes) else np.zeros(1, np.int64)
                n = running[bounds[1:]] - running[bounds[:-1]]
                at = np.flatnonzero(special)
                n[at] = counter.encoded([texts[int(i)].as_py() for i in at])
                yield pa.RecordBatch.from_arrays([part["id"], part["n_bytes"], pa.array(n)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
