"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

*States.* Merging by rank, leftmost first, leaves every adjacent pair of tokens
as it would be left alone: a token sequence is the encoding of its string exactly
if each token alone encodes as itself and each two neighbours encode as those
two. A word's encoding is therefore the encoding of the word without its last
token, and that token. So one number describes any prefix: the last token of its
encoding. Of the vocabulary entries that end a prefix, exactly one fits behind the
state of the shorter prefix it leaves.

*Trie.* Distinct words, spelt in the vocabulary's symbols (a word's final symbol
carries the end-of-word mark), are inserted into a trie in sorted order, which is a
depth-first traversal of it. It gives each new node its state from its ancestors',
so the encoding of a shared prefix is computed once, whatever number of words begin with it. A word's tokens
are read off by stepping back from its last node.

*Texts.* Texts are cut at ASCII white space, which no pre-token spans. Each
distinct piece of a few megabytes of text goes through the library's own
normaliser and pre-tokenizer once, its words through the trie once. The trie with
its words and the remembered pieces of a task start anew above a stated number of
entries, so memory is bounded; words longer than ``LONGEST_WORD`` are walked by themselves
and not kept. Nothing is shuffled, and no group of documents meets in one task.

*Decoding* joins the strings of the ids, as the library does for a tokenizer
without a decoder.

A special string in a text is one token, what stands around it is encoded by
itself, as the library does by default. Null counts as empty: no token, empty
text. Very long texts are sliced by whole pieces only, never cut. Repeated rows
and ties are each encoded by themselves; an empty table gives no row. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.word_arrays import batch_words, byte_class, slices

ENDED = 0x10000  # added to the code point of a word's last symbol
MOST_NODES = 800_000  # of a task's trie
MOST_PIECES = 300_000  # of text, and words of the trie, whose encodings a task remembers
MOST_PAIRS = 1_000_000  # of tokens whose fit a task remembers
LONGEST_WORD = 256
Encoded = tuple[int, str, str]  # number of tokens, ids and decoded strings, as text joined by blanks
WHITE = " \t\n\r\x0b\x0c"

ship_by_value(__name__)


class Merges:
    """Rank merges over symbols, and which two tokens stand side by side unmerged.

    A symbol is one character: a byte's stand-in, moved up by ``ENDED`` if it ends its word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], mark: str):
        self.ranks = {(self.spelling(a, mark), self.spelling(b, mark)): rank for rank, (a, b) in enumerate(merges)}
        self.made = {a + b: (rank, a, b) for (a, b), rank in self.ranks.items()}
        if len(self.made) < len(merges) or any(self.made.get(x, (-1,))[0] > rank for pair, rank in self.ranks.items() for x in pair):
            raise ValueError("this needs merges that each make one new string, of strings made before")
        spelt = {self.spelling(token, mark): number for token, number in vocab.items()}
        self.ids = {s: number for s, number in spelt.items() if len(s) == 1 or s in self.made}
        self.spelt = {number: s for s, number in self.ids.items()}
        starts = {"": -1} | self.ids
        self.grown = {starts[s[:-1]] << 21 | ord(s[-1]): number for s, number in self.ids.items() if s[:-1] in starts}  # token, symbol -> token
        self.tails = {s[k:] for s in self.ids for k in range(len(s))}
        self.fit: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}

    @staticmethod
    def spelling(token: str, mark: str) -> str:
        ended = mark and token.endswith(mark) and token != mark
        return ended_word(token.removesuffix(mark)) if ended else token

    def merged(self, symbols: str) -> list[str]:
        """The strings left when the pair of lowest rank, the leftmost of equals, is merged until none has a rank."""
        parts, ranks = list(symbols), self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(ranks):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The strings that stand at a token's edge (0 left, 1 right) while it is made, each with the rank that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            part, rank = token, len(self.ranks)
            found = self.edges[token, side] = [(part, rank)]
            while part in self.made:
                rank, *halves = self.made[part]
                part = halves[side]
                found.append((part, rank))
        return found

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` keeps its form behind ``before``, itself a state (-1: at a word's begin).

        It does if it encodes as itself, and no pair across the border has a rank at which both parts stand there;
        of equal ranks the left pair goes first.
        """
        if before < 0:
            return self.merged(self.spelt[token]) == [self.spelt[token]]
        if not self.fitting(-1, token):
            return False
        get, left = self.ranks.get, self.edge(self.spelt[token], 0)
        for a, a_ends in self.edge(self.spelt[before], 1):
            for b, b_ends in left:
                rank = get((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def fitting(self, before: int, token: int) -> bool:
        """``fits``, remembered."""
        known = self.fit.get((before, token))
        if known is None:
            if len(self.fit) >= MOST_PAIRS:
                self.fit.clear()
            known = self.fit[before, token] = self.fits(before, token)
        return known


def ended_word(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + ENDED)


class Trie:
    """Words as paths of symbols; each node knows its prefix's last token and the node that token starts from."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.steps: dict[int, int] = {}  # node and symbol, packed -> node
        self.last, self.back = [-1], [0]

    def traverse(self, words: list[str]) -> list[int]:
        """The last node of each of ``words``, which are sorted, so that the walk is depth first: a word goes on where it
        leaves the one before. Nodes that are new are inserted on the way and get their state.

        Of the tokens that end a node's prefix, the one that fits the state before it is taken; only one does. The last token
        of the shorter prefix with the new symbol is tried first.
        """
        last, back, ends = self.last, self.back, []
        step_to, known_fit, id_of, grow = self.steps.get, self.merges.fit.get, self.merges.ids.get, self.merges.grown.get
        tails, fitting = self.merges.tails, self.merges.fitting
        path, before = [0], ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            node, depth = path[-1], shared
            for symbol in word[shared:]:
                depth += 1
                shorter, code = node, ord(symbol)
                step = shorter << 21 | code
                node = step_to(step)
                if node is None:
                    root, token = back[shorter], grow(last[shorter] << 21 | code)
                    fits = False
                    if token is not None:
                        fits = known_fit((last[root], token))
                        if fits is None:
                            fits = fitting(last[root], token)
                    if not fits:
                        start = depth - 1
                        while start and word[start - 1:depth] in tails:
                            start -= 1
                        for at in range(start, depth):
                            token = id_of(word[at:depth])
                            if token is not None:
                                root = path[at]
                                fits = known_fit((last[root], token))
                                if fits is None:
                                    fits = fitting(last[root], token)
                                if fits:
                                    break
                        else:
                            raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")
                    node = self.steps[step] = len(last)
                    last.append(token)
                    back.append(root)
                path.append(node)
            ends.append(node)
            before = word
        return ends

    def tokens(self, node: int) -> list[int]:
        found = []
        while node:
            found.append(self.last[node])
            node = self.back[node]
        return found[::-1]


class Encoder:
    """Token ids of pieces of text, by the library's normaliser and pre-tokenizer and a trie of this task."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        written = json.load(open(tokenizer_path))
        model = written["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"] or written["decoder"]:
            raise ValueError("this needs plain BPE over a whole byte alphabet, without a decoder")
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in written["added_tokens"]):
            raise ValueError("special strings that take in their surroundings are not supported")
        library = Tokenizer.from_file(tokenizer_path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.specials = {a["content"]: a["id"] for a in written["added_tokens"]}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        mark = model["end_of_word_suffix"] or ""
        self.merges, self.ended = Merges(model["vocab"], pairs, mark), ended_word if mark else str
        self.plain = self._ascii_split(written)
        self.special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)").search
        self.strings = {number: token for token, number in (model["vocab"] | self.specials).items()}
        self.alone = {number: self.written([number]) for number in self.specials.values()}
        self.trie, self.known, self.seen = Trie(self.merges), {}, dict(self.alone)

    @staticmethod
    def _ascii_split(written: dict):
        """For the known normaliser and splitter, their effect on printable ASCII as one expression; else None."""
        lowers = [n["type"] for n in (written["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        first, *rest = (written["pre_tokenizer"] or {}).get("pretokenizers", [{"type": None}])
        if not lowers or first["type"] != "Split" or not first["invert"] or [r["type"] for r in rest] != ["ByteLevel"]:
            return None
        pattern = first["pattern"]["Regex"].replace("\\p{L}", "a-z").replace("\\p{N}", "0-9")
        return None if "\\p" in pattern or rest[0]["use_regex"] or rest[0]["add_prefix_space"] else re.compile(pattern).findall

    def words(self, piece: str) -> list[str | int]:
        """The pre-tokens of a piece, and the ids of special strings, the earliest and then longest first."""
        if self.plain and piece.isascii() and piece.isprintable() and not self.special(piece):
            return self.plain(piece.lower())
        if not self.special(piece):
            return [w for w, _ in self.split(self.normal(piece))]
        hits = [(piece.find(s), -len(s), s) for s in self.specials if s in piece]
        at, _, special = min(hits)
        rest = [piece[:at], piece[at + len(special):]]
        before, after = (self.words(r) if r else [] for r in rest)
        return [*before, self.specials[special], *after]

    def worded(self, words: set[str | int]) -> Mapping[str | int, Encoded]:
        """The encoding of each of ``words`` and others seen before. New ones are inserted together and walked in one traversal."""
        if len(self.trie.last) > MOST_NODES or len(self.seen) > MOST_PIECES:
            self.trie, self.seen = Trie(self.merges), dict(self.alone)
        new = sorted(w for w in words if w not in self.seen)
        short = [w for w in new if len(w) <= LONGEST_WORD]
        for w, end in zip(short, self.trie.traverse([self.ended(w) for w in short])):
            self.seen[w] = self.written(self.trie.tokens(end))
        if len(short) == len(new):
            return self.seen
        long = {}
        for w in new:
            if len(w) > LONGEST_WORD:
                trie = Trie(self.merges)
                long[w] = self.written(trie.tokens(trie.traverse([self.ended(w)])[0]))
        return ChainMap(long, self.seen)

    def written(self, ids: list[int]) -> Encoded:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.strings.__getitem__, ids))

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        return [list(map(int, ids.split())) for _, ids, _ in self.encodings(pieces)]

    def encodings(self, pieces: list[str]) -> list[Encoded]:
        """The encoding of each piece, put together from those of its words."""
        split = [self.words(p) for p in pieces]
        known = self.worded(set(chain.from_iterable(split)))
        answers = []
        for words in split:
            if len(words) == 1:
                answers.append(known[words[0]])
            else:
                parts = [known[w] for w in words]
                answers.append((sum(n for n, _, _ in parts), " ".join([ids for _, ids, _ in parts]), " ".join([s for _, _, s in parts])))
        return answers

    def remembered(self, pieces: list[str]) -> dict[str, Encoded]:
        """The encoding of each piece and of others seen before."""
        if len(self.known) > MOST_PIECES:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.encodings(new)))
        return self.known

    def forget(self, pieces: list[str]) -> None:
        for piece in pieces:
            if len(piece) > LONGEST_WORD:
                self.known.pop(piece, None)


@contextmanager
def uncollected():
    """No search for reference cycles meanwhile: the trie and the pieces are many small objects without any, freed by their counts."""
    searching = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if searching:
            gc.enable()


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_tokens, ids (array) and decoded text of every row; with ``digests`` the SHA-256 of both instead.

    ``tokenizer_path`` is a BPE file every executor can read. ids_sha256 is of the decimal ids joined by one space.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            yield from answers(batches)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        encoder = Encoder(tokenizer_path)
        piece_bytes = byte_class(lambda c: c not in WHITE)
        for batch in batches:
            for part in slices(batch, "text"):
                codes, pieces, bounds = batch_words(part["text"], piece_bytes)
                pieces = pieces.to_pylist()
                known = encoder.remembered(pieces)
                here = [known[p] for p in pieces]
                count = np.array([n for n, _, _ in here], np.int64)
                held = np.flatnonzero(count)  # a piece may be white space beyond ASCII and hold no token
                texts = [np.array([h[k] for h in here], object) for k in (1, 2)]
                n, columns = np.zeros(part.num_rows, np.int64), ([], [])
                solid = np.zeros(len(pieces), bool)
                solid[held] = True
                for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    mine = codes[a:b]
                    mine = mine[solid[mine]]
                    n[row] = count[mine].sum()
                    for text, out in zip(texts, columns):
                        joined = " ".join(text[mine].tolist())
                        out.append(hashlib.sha256(joined.encode()).hexdigest() if digests else joined)
                encoder.forget(pieces)
                ids = columns[0] if digests else [[int(x) for x in s.split()] for s in columns[0]]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n), pa.array(ids, None if digests else pa.list_(pa.int32())),
                                                  pa.array(columns[1], pa.string())], names)

    names = ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, {names[2]} {'string' if digests else 'array<int>'}, {names[3]} string")
    return found.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text of every row of ids: their strings joined by blanks. Null ids decode to the empty text.

    Ids outside the vocabulary are passed over, as the library does. The vocabulary has a fixed size, so it is shipped whole.
    """
    strings = Encoder(tokenizer_path).strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(strings[i] for i in ids or () if i in strings) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
