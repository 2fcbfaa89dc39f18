"""BPE encoding over a trie, held to the library and to merging by hand."""

import gc
import hashlib
import random

import pytest
from odd import LONG, TEXTS, documents, nothing
from pyspark.sql import functions as F

from parasol.llm import bpe_trie

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def random_texts(n):
    pick = random.Random(13)
    parts = ["the", "inging", "aaaa", "ha" * 9, "THE", " ", "\n", "\x0b", "\x1c", "\x85", "　", "'s", "'ll", "''", "é", "é", "İ", "ΑΣ", "ß",
             "Ⅷ", "²", "12", "½", "漢字", "😀", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "</w>", "=" * 30, "́", "—", "_", "\x00", "ᾳ"]
    letters = "abcdeinthrsABC'.,"
    return ["".join(pick.choice(parts) if pick.random() < 0.5 else "".join(pick.choices(letters, k=pick.randint(1, 12)))
                    for _ in range(pick.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    encoder = bpe_trie.Encoder(PATH)
    pieces = [p for t in random_texts(800) for p in t.split()] + ["a" * n for n in range(1, 700)] + [chr(c) + "x" + chr(c) for c in range(33, 0x3000)]
    pieces = [p for p in pieces if p.strip(bpe_trie.WHITE)]
    assert encoder.encode(pieces) == [e.ids for e in library.encode_batch(pieces, add_special_tokens=False)]


def test_states_are_last_tokens_of_prefixes():
    """Each node of the trie holds the last token that merging its prefix by hand leaves."""
    encoder = bpe_trie.Encoder(PATH)
    merges, pick = encoder.merges, random.Random(7)
    words = sorted({"".join(pick.choices("intherao", k=pick.randint(1, 14))) for _ in range(400)} | {"a" * 20, "ha" * 10})
    ends = encoder.trie.traverse(words)
    nodes = len(encoder.trie.last)
    for word, end in zip(words, ends):
        assert [merges.spelt[t] for t in encoder.trie.tokens(end)] == merges.merged(word)
    prefixes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert encoder.trie.traverse(prefixes) and len(encoder.trie.last) == nodes == len(prefixes) + 1  # each prefix once
    for prefix, end in zip(prefixes, encoder.trie.traverse(prefixes)):
        assert merges.spelt[encoder.trie.last[end]] == merges.merged(prefix)[-1]


def test_bounded_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "MOST_NODES", 50)
    monkeypatch.setattr(bpe_trie, "MOST_PIECES", 20)
    monkeypatch.setattr(bpe_trie, "MOST_PAIRS", 30)
    encoder = bpe_trie.Encoder(PATH)
    for text in random_texts(60):
        pieces = text.replace("\x00", "").split()
        known = encoder.remembered(pieces)
        assert [known[p][1] for p in pieces] == [" ".join(map(str, e.ids)) for e in library.encode_batch(pieces, add_special_tokens=False)]
        encoder.forget(pieces)


def test_whole_texts_and_round_trip_equal_the_library(spark, library):
    texts = random_texts(500) + [t for _, t in TEXTS] + [LONG, "x" * 3000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit("a"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    found = bpe_trie.encoded(docs, PATH)
    rows = found.collect()
    assert {r.doc_id: r.ids for r in rows} == want and all(r.n_tokens == len(r.ids) for r in rows)
    plain = {i: library.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    assert {r.doc_id: r.decoded for r in rows} == plain
    assert {r.doc_id: r.decoded for r in bpe_trie.decoded(found, PATH).collect()} == plain
    digest = {i: (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain[i].encode()).hexdigest()) for i, ids in want.items()}
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe_trie.encoded(docs, PATH, digests=True).collect()} == digest


def test_query_on_all_documents(spark, library):
    from parasol.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe_trie"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark, library):
    found = bpe_trie.encoded(documents(spark), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == sorted(
        (i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert bpe_trie.encoded(nothing(spark), PATH).count() == 0
    assert bpe_trie.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("decoded").distinct().collect()[0][0] == ""


def test_no_search_for_cycles_while_a_task_encodes():
    """The search goes on after the task, also one that fails; a task leaves no cycles behind that it would have found."""
    assert gc.isenabled()
    with pytest.raises(KeyError), bpe_trie.uncollected():
        assert not gc.isenabled()
        raise KeyError
    assert gc.isenabled()
    encoder = bpe_trie.Encoder(PATH)
    gc.collect()
    with bpe_trie.uncollected():
        for n in range(20):
            encoder.forget([*encoder.remembered([f"word{n}{k}, <|endoftext|>é{k}" for k in range(200)])])
        assert gc.collect() < 100


def test_known_words_are_not_walked_again(library, monkeypatch):
    """A word met in another piece is taken from memory, whatever stands around it; only new words reach the trie."""
    walked, traverse = [], bpe_trie.Trie.traverse
    monkeypatch.setattr(bpe_trie.Trie, "traverse", lambda trie, words: (walked.extend(words), traverse(trie, words))[1])
    encoder = bpe_trie.Encoder(PATH)
    long = "z" * 300
    for pieces in (["unheard", "of", "<|endoftext|>"], ["Unheard,", "(of)", "unheard<|endoftext|>of", long], ["\u3000", long, "of."]):
        known = encoder.remembered(pieces)
        for p, e in zip(pieces, library.encode_batch(pieces, add_special_tokens=False)):
            assert known[p] == (len(e.ids), " ".join(map(str, e.ids)), " ".join(e.tokens))
        encoder.forget(pieces)
    assert [walked.count(encoder.ended(w)) for w in ("unheard", "of", ",", ".", long)] == [1, 1, 1, 1, 2]  # long words are not kept


def test_grown_tokens_are_the_vocabulary_s():
    """A token and a symbol name the entry that spells both, from the empty text (-1) on."""
    merges = bpe_trie.Encoder(PATH).merges
    assert all(merges.spelt[n] == (merges.spelt[k >> 21] if k >= 0 else "") + chr(k & 0x1FFFFF) for k, n in merges.grown.items())
    assert sum(k < 0 for k in merges.grown) == sum(len(s) == 1 for s in merges.ids)
