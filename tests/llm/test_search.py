"""Decontamination against brute force: exact phrases, phrases with gaps, several parts of the test set."""

import random

import pytest
from odd import TEXTS, documents, nothing
from pyspark.sql import functions as F

from parasol.llm import decontaminate
from parasol.llm.queries import op1


def brute(docs, tests, window, slop):
    out = []
    for i, t in docs:
        words, hit, items = (t or "").split(), set(), set()
        for item, text in tests:
            text = (text or "").split()
            for k in range(max(1, len(text) - window + 1) if text else 0):
                phrase = text[k:k + window]
                for start in range(len(words)):
                    if words[start] != phrase[0]:
                        continue
                    at = start
                    for word in phrase[1:]:
                        at = next((z for z in range(at + 1, len(words)) if words[z] == word), None)
                        if at is None:
                            break
                    if at is not None and at - start - (len(phrase) - 1) <= slop:
                        hit.update(range(start, at + 1))
                        items.add("null" if item is None else str(item))
        out.append(str((i, len(words), len(hit), sorted(items))))
    return sorted(out)


@pytest.mark.parametrize("window,slop,part_bytes", [(4, 0, 1 << 20), (4, 2, 1 << 20), (3, 0, 20), (3, 1, 20)])
def test_matches_are_those_of_brute_force(spark, window, slop, part_bytes):
    pick = random.Random(window + slop)
    docs = [(i, " ".join(pick.choice("abcdef") for _ in range(pick.randint(0, 60)))) for i in range(60)]
    docs += [(7, None), (None, "a b c"), (9, ""), (9, "")]
    tests = [(i, " ".join(pick.choice("abcdef") for _ in range(pick.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)]
    tests += [(None, "a b"), (3, None)]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = decontaminate.search(index, spark.createDataFrame(tests, "item_id long, text string"), window=window, slop=slop,
                                 part_bytes=part_bytes).collect()
    got = sorted(str((r.id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"]))) for r in found)
    assert got == brute(docs, tests, window, slop)


def test_odd_rows_and_empty_tables(spark):
    tests = spark.createDataFrame([(1, "quick BROWN fox"), (2, "word " * 13), (3, None)], "item_id long, text string")
    found = decontaminate.contamination(documents(spark), tests).collect()
    assert len(found) == len(TEXTS)
    by = {(r.id, r.n_words): r for r in found}
    assert by[(1, 10)].n_hit == 3 and by[(1, 10)].contaminated and by[(1, 10)]["items"] == ["1"]
    assert by[(6, 40_001)].n_hit == 40_000 and by[(3, 0)].n_hit == 0 and not by[(3, 0)].contaminated
    kept = decontaminate.drop_contaminated(documents(spark), tests)
    assert kept.columns == documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 4, 5, 8, 9, 10]))
    assert decontaminate.contamination(nothing(spark), tests).count() == 0
    assert decontaminate.contamination(documents(spark), tests.limit(0)).where("n_hit > 0").count() == 0


def test_query_has_one_row_per_document(spark):
    found = op1(spark, "/root/testdata/sf0.001")
    assert found.count() == 200 and found.where("contaminated and n_items = 0").count() == 0


def test_a_file_of_the_index_holds_few_segments(spark, monkeypatch):
    """Spark reads up to 4,096 rows of a file at once, so a file must not hold all segments of a large task."""
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 100)
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 20) AS text").coalesce(1)
    index = decontaminate.build_index(docs).select("segment", "id", F.input_file_name().alias("file"))
    held = index.groupBy("file").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) > 20 and max(r.n for r in held) <= decontaminate.FILE_SEGMENTS
    assert sorted(x for r in index.collect() for x in r.id) == list(range(60))
