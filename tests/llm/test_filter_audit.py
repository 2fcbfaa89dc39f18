"""The document-term matrix and the audit of filters, held to plain counting."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from odd import TEXTS, documents, nothing
from pyspark.sql import functions as F

from parasol.llm import filter_audit, term_matrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_rows():
    pick = random.Random(11)
    words = ["the", "The", "über", "漢字", "A", "B$", "x\x00", "a b", "CAPS", *[f"w{i}" for i in range(300)]]
    texts = [pick.choice([" ", "\n", "\t ", "  "]).join(pick.choices(words, k=pick.choice([0, 1, 5, 60, 120, 300]))) for _ in range(120)]
    texts += texts[:40] + [texts[0]] * 30 + [t for _, t in TEXTS]
    return [(pick.choice([None, i, i, i, i // 2]), t) for i, t in enumerate(texts)]


def test_matrix_counts_each_word_of_each_document(spark, monkeypatch):
    monkeypatch.setattr(term_matrix, "SHARD_BYTES", 2000)
    rows = random_rows()
    docs = documents(spark, rows).withColumn("at", F.monotonically_increasing_id()).repartition(3)
    texts = {r["at"]: r["text"] for r in docs.select("at", "text").collect()}
    shards = term_matrix.document_term_matrix(docs, keep=[F.col("at")], buckets=7).collect()
    assert len(shards) > 5 and len({s.shard for s in shards}) == len(shards)
    numbers = {}
    for word, number in term_matrix.dictionary(docs, buckets=7).collect():
        assert numbers.setdefault(number, word) == word
    assert len(numbers) == len(set(numbers.values())) == len({w for t in texts.values() for w in WORD.findall(t or "")})
    seen = {}
    for s in shards:
        indptr, indices, counts = np.frombuffer(s.indptr, "<i8"), np.frombuffer(s.indices, "<i8"), np.frombuffer(s.counts, "<i4")
        for k, row in enumerate(s.rows):
            a, b = indptr[k:k + 2]
            seen[row["at"]] = {numbers[i]: c for i, c in zip(indices[a:b].tolist(), counts[a:b].tolist())}
    assert seen == {i: dict(Counter(WORD.findall(t or ""))) for i, t in texts.items()}


def by_hand(rows, labels):
    """The audit, one document and order at a time."""
    marks = {}
    for doc, quality, toxic in labels:
        good, bad = marks.get(doc, (False, False))
        marks[doc] = good or quality == 1, bad or toxic == 1
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failed = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        failed.append((part or "", {f for f, yes in fails.items() if yes}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    found, shares = {}, Counter()
    for part in {p for p, *_ in failed}:
        mine = [f for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                found[part, "".join(order), step] = (len(left), len(gone), redundant, sum(d[1] == {f} for d in mine),
                                                     sum(d[2] for d in gone), sum(d[3] for d in gone))
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audited(docs, labels):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_counting_by_hand(spark):
    pick = random.Random(5)
    rows = [(i, t, pick.choice(["en", "de", None, ""])) for i, t in random_rows()]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in [*range(150), 3, 3, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit(0)).withColumn("digest", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("good", F.lit(1))
    assert audited(docs, marks) == by_hand(rows, labels)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, t, "en") for i, t in TEXTS]
    assert audited(documents(spark), labels) == by_hand(rows, [(1, 1, 0), (7, 0, 1)])
    assert audited(documents(spark), labels.limit(0)) == by_hand(rows, [])
    assert audited(nothing(spark), labels) == {}
    assert term_matrix.document_term_matrix(nothing(spark)).count() == 0
