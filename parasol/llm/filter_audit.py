"""How quality filters overlap, for every order in which they may be applied.

Words per document and distinct words are row sums and entry counts of the global
document-term matrix (``term_matrix``). With the other conditions they give each
document the set of filters it fails. Documents are counted by part and set, at
most 2^n sets a part, inside each map task first; all orders are read off those
counts, so the number of orders costs nothing in documents.

A copy is found by the SHA-256 of its whole text: the smallest id of a text is
looked up under text and id together, so the rows of one large group of copies lie
in many tasks.

Nulls: text counts as empty, part as the empty string; a row without id is no copy
and has no label. Rows that repeat one another count each; they have one id, so none
is a copy of the other. A document with several labels has a mark if any label has
it. An empty text has no words, fails A only (or E as well). An empty table gives no row.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.term_matrix import row_measures
from parasol.session import materialized

MOST_FILTERS = 6  # 720 orders
SYMBOLS = "#$%&*|"


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and whether the document fails A (short), B (repetitive), C (capitals), D (symbols), E (a copy)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = F.lit(False)
    for s in SYMBOLS:
        symbols = symbols | text.contains(s)
    keep = [F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            (capitals(text) * 100 > F.length(text) * 10).alias("C"), symbols.alias("D"), F.unhex(F.sha2(text, 256)).alias("digest")]
    rows = row_measures(docs, text_col, keep)
    a, b = F.col("n_words") < 100, F.col("n_distinct") * 100 < F.col("n_words") * 80
    rows = materialized(rows.select("id", "part", a.alias("A"), b.alias("B"), "C", "D", "digest"), "audit-rows")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").select("id", "part", "A", "B", "C", "D", copy.alias("E"))


def interactions(flagged: DataFrame, filters: str, marks: list[str], part: str = "part") -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, what of each mark is lost, shapley.

    ``filters`` names one boolean column of failures by each letter, ``marks`` are boolean columns.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    failed = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    sets = flagged.select(F.col(part).alias("part"), failed.alias("failed"), *marks).groupBy("part", "failed").agg(
        F.count("*").alias("n"), *[F.count_if(m).alias(m) for m in marks])
    steps = []
    for order in permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = sets.select("*", F.inline(table))
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    orders_first = F.lit(factorial(len(filters))) / F.bit_count("failed")  # orders in which the filter comes first of those failed

    def total(column, when: Column) -> Column:
        return F.sum(F.when(when, column).otherwise(0)).cast("bigint")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~fails & ~earlier).alias("kept"), total(F.col("n"), fails & ~earlier).alias("removed"),
        total(F.col("n"), fails & earlier).alias("redundant"), total(F.col("n"), F.col("failed") == F.col("bit")).alias("unique_fails"),
        *[total(F.col(m), fails & ~earlier).alias(f"{m}_lost") for m in marks],
        total((F.col("n") * orders_first).cast("bigint"), fails).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the five filters, with the good (quality 1) and toxic documents that each step loses."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    flagged = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return interactions(flagged.fillna(False, ["good", "toxic"]), "ABCDE", ["good", "toxic"])
