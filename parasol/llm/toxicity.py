"""Toxicity by class-conditional Kneser-Ney models.

One model is learnt from toxic rows and one from ordinary rows. A model's
probability of a word w in class c is

    max(n_c(w) - DISCOUNT, 0) / N_c  +  D_c / N_c * contexts(w) / contexts

with n_c(w) the word's count in the class, N_c the class's total and D_c all that
was discounted, the sum of min(n_c, DISCOUNT) over the class's words. The second
term is Kneser and Ney's backoff: in how many different contexts (texts) a word
occurs, counted over both classes together. The discount takes all of a word
seen once: of 0.75, 1, 1.5, 2 and 3 it had the smallest loss on the training
folds of sf0.1. So an expression too rare to tell the classes apart weighs nearly the
same in both, and what both models know only from the backoff says nothing.

*Counting.* Labelled rows are read where they lie. A word that a text holds k
times counts as often as k has binary digits, so that a text repeating one word
does not outweigh the rest. Each task sends its distinct words with their counts
by class and fold; Spark adds them up over all labelled rows. The counts are a
table keyed by the word itself, which grows with the corpus.

*Scoring.* A word's difference is log P(w | toxic) - log P(w | ordinary), less
that of a word neither class has: positive or negative. It is drawn towards 0 by
a margin, alike on both sides, since a difference that small is the noise of
thousands of words. A text's measures are the sum of its words' differences per
word (the length-normalised comparison) and per root of their number; a logistic
curve over both gives the score.

*Margin and curve.* Both are picked on training rows alone: for each of the
``FOLDS`` folds, models of the other folds measure its rows at each margin of
``MARGINS``; the margin whose curve has the smallest loss over all folds is kept.
Rows are summed up in a histogram before they come to the driver.

*Plan.* Words whose difference exceeds the margin go to the texts while they are
at most ``SHIPPED_WORDS``; beyond that, the texts' distinct words are joined to
them by word and added up by text. Both ways give the same measures.

Only rows for which ``held_out`` does not hold give labels. Null or empty texts
have no words and get the score of no evidence. Several labels of one
id: the largest counts. Null labels are no labels. Repeated rows count each. If
one of the classes has no row, every score is 0. Of margins with equal losses
the smallest is kept. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.word_arrays import batch_words, byte_class, slices
from parasol.session import materialized

ship_by_value(__name__)

DISCOUNT = 1.5
FOLDS = 5  # of the training rows
MARGINS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
BINS = 64  # of each of the two measures in a margin's histogram
SHIPPED_WORDS = 1_000_000  # words (some 20 bytes each) up to which they go to the texts
BROADCAST_LABELS = 2_000_000  # labelled ids (about 16 bytes each) up to which they go to the texts

WORD_BYTES = byte_class(str.islower)
CLASSES = ("toxic", "ordinary")
TEXT_KEY = ["text_key_1", "text_key_2", "model"]


class Scorer(NamedTuple):
    """What training found: the telling words (word, differences), their margin and the curve."""

    words: DataFrame
    margin: float
    curve: tuple[float, float, float]


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text number, word number and damped count of each distinct word of each text, and the words."""
    codes, words, bounds = batch_words(texts, WORD_BYTES)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair, n = np.unique(text << 32 | codes, return_counts=True)
    return pair >> 32, pair & 0xFFFFFFFF, np.frexp(n)[1].astype(np.int64), words


def _sums() -> list[str]:
    return [f"{c}_{fold}" for fold in range(FOLDS) for c in CLASSES]


def count_words(rows: DataFrame) -> DataFrame:
    """(word, contexts, toxic_0, ordinary_0, ...) of every word of rows (text, toxic, fold)."""
    names = ["contexts", *_sums()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, word, n, words = _distinct_words(part["text"])
                toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(bool)
                column = 2 * part["fold"].to_numpy(zero_copy_only=False).astype(np.int64) + ~toxic
                found = [np.bincount(word, minlength=len(words)).astype(np.int64)]
                for i in range(2 * FOLDS):
                    chosen = column[text] == i
                    found.append(np.bincount(word[chosen], n[chosen], len(words)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), *map(pa.array, found)], ["word", *names])

    found = rows.select("text", "toxic", "fold").mapInArrow(run, "word string, " + ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _count(kind: str, left_out: int | None) -> Column:
    """A word's count in a class without one fold."""
    return sum((F.col(f"{kind}_{fold}") for fold in range(FOLDS) if fold != left_out), F.lit(0))


def differences(counts: DataFrame) -> DataFrame | None:
    """(word, differences): by the models without fold 0, 1, ... and last by those of all folds.

    None if a class has no words. Models without a word of one class, for lack of rows, find no difference.
    """
    models = [*range(FOLDS), None]
    aggs = [F.sum("contexts").alias("contexts")]
    for i, left_out in enumerate(models):
        for kind in CLASSES:
            n = _count(kind, left_out)
            aggs += [F.sum(n).alias(f"{kind}_n{i}"), F.sum(F.least(n, F.lit(DISCOUNT))).alias(f"{kind}_taken{i}")]
    total = counts.agg(*aggs).first()
    last = len(models) - 1
    if not total[f"toxic_n{last}"] or not total[f"ordinary_n{last}"]:
        return None
    found = []
    for i, left_out in enumerate(models):
        if not total[f"toxic_n{i}"] or not total[f"ordinary_n{i}"]:
            found.append(F.lit(0.0))
            continue
        logs = []
        for kind in CLASSES:
            whole = float(total[f"{kind}_n{i}"])
            backoff = total[f"{kind}_taken{i}"] / whole
            p = F.greatest(_count(kind, left_out) - DISCOUNT, F.lit(0.0)) / whole + backoff * F.col("contexts") / float(total["contexts"])
            logs.append(F.log(p) - float(np.log(backoff)))
        found.append(logs[0] - logs[1])
    return counts.select("word", F.array(*found).alias("differences"))


def telling(words: DataFrame, margin: float) -> DataFrame:
    """The words that any of their differences draws beyond the margin."""
    return words.where(F.exists("differences", lambda d: F.abs(d) > margin))


def measures(rows: DataFrame, words: DataFrame, margins: tuple[float, ...], shipped_words: int = SHIPPED_WORDS) -> DataFrame:
    """``rows`` (with columns text and model, the place of the differences to use) with, for each margin, the sum of
    the words' differences per word and per root of the words: arrays per_word and per_root.

    ``words`` (word, differences) is written already. All columns but text and model are handed through.
    """
    if words.count() <= shipped_words:
        return _measures_in_place(rows, words, margins)
    return _measures_by_join(rows, words, margins)


def _measures_in_place(rows: DataFrame, words: DataFrame, margins: tuple[float, ...]) -> DataFrame:
    found = words.toArrow()
    vocabulary = found["word"].combine_chunks().cast(pa.large_string()) if len(found) else pa.array([], pa.large_string())
    table = found["differences"].combine_chunks().flatten().to_numpy().reshape(len(found), -1) if len(found) else np.zeros((0, 1))
    shipped = rows.sparkSession.sparkContext.broadcast((vocabulary, table))
    others = [f for f in rows.schema.fields if f.name not in ("text", "model")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = shipped.value
        for batch in batches:
            for part in slices(batch, "text"):
                total, words_n = np.zeros((part.num_rows, len(margins))), np.ones(part.num_rows)
                text, word, n, words = _distinct_words(part["text"])
                if len(words):
                    words_n = np.maximum(np.bincount(text, n, part.num_rows), 1)
                    place = pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=vocabulary), -1)
                    place = place.to_numpy(zero_copy_only=False)[word]
                    text, n, place = text[place >= 0], n[place >= 0], place[place >= 0]
                    d = table[place, part["model"].to_numpy(zero_copy_only=False)[text]] if len(place) else np.zeros(0)
                    for i, margin in enumerate(margins):
                        total[:, i] = np.bincount(text, n * np.sign(d) * np.maximum(np.abs(d) - margin, 0), part.num_rows)
                lists = [pa.array(list(total / w[:, None]), pa.list_(pa.float64())) for w in (words_n, np.sqrt(words_n))]
                yield pa.RecordBatch.from_arrays([part[f.name] for f in others] + lists, [f.name for f in others] + ["per_word", "per_root"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["per_word array<double>", "per_root array<double>"]
    return rows.mapInArrow(run, ", ".join(schema))


def _measures_by_join(rows: DataFrame, words: DataFrame, margins: tuple[float, ...]) -> DataFrame:
    """A text's measures depend on nothing but its words, so texts are named by a 96-bit hash and the model's place."""
    key = [F.xxhash64("text").alias(TEXT_KEY[0]), F.crc32(F.col("text").cast("binary")).alias(TEXT_KEY[1]), F.col("model").alias("model")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, word, n, words = _distinct_words(part["text"])
                found = [part[k].take(pa.array(text)) for k in TEXT_KEY] + [words.cast(pa.string()).take(pa.array(word)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(found, [*TEXT_KEY, "word", "n"])

    pairs = rows.select(*key, "text").mapInArrow(run, "text_key_1 bigint, text_key_2 bigint, model int, word string, n bigint")
    pairs = pairs.groupBy(*TEXT_KEY, "word").agg(F.max("n").alias("n"))  # equal texts say the same
    d = F.coalesce(F.get("differences", F.col("model")), F.lit(0.0))
    drawn = [F.sum(F.col("n") * F.signum(d) * F.greatest(F.abs(d) - m, F.lit(0.0))) for m in margins]
    sums = pairs.join(words, "word", "left").groupBy(*TEXT_KEY).agg(F.array(*drawn).alias("drawn"), F.sum("n").cast("double").alias("n"))
    sums = sums.toDF("k1__", "k2__", "k3__", "drawn__", "n__")
    others = [F.col(f"r.`{f.name}`") for f in rows.schema.fields if f.name not in ("text", "model")]
    on = [F.xxhash64("r.text") == F.col("s.k1__"), F.crc32(F.col("r.text").cast("binary")) == F.col("s.k2__"), F.col("r.model") == F.col("s.k3__")]
    drawn, n = F.coalesce("s.drawn__", F.array(*[F.lit(0.0)] * len(margins))), F.coalesce("s.n__", F.lit(1.0))
    return rows.alias("r").join(sums.alias("s"), on, "left").select(
        *others, F.transform(drawn, lambda x: x / n).alias("per_word"), F.transform(drawn, lambda x: x / F.sqrt(n)).alias("per_root"))


def fit_curve(y: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[tuple[float, float, float], float]:
    """A logistic curve over both measures, by Newton's steps on histogram rows, and its mean loss.

    Toxic rows, the rarer ones, weigh more by the root of the classes' ratio: half way to equal classes.
    """
    toxic = (n * y).sum()
    n = np.where(y > 0, n * np.sqrt((n.sum() - toxic) / max(toxic, 1)), n)
    x = np.column_stack([np.ones(len(y)), x])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(3)
    ridge = np.diag([1e-3, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    loss = (n * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() / max(n.sum(), 1e-9)
    return tuple(float(v) for v in w / scale), float(loss)


def pick_margin(measured: DataFrame, margins: tuple[float, ...] = MARGINS) -> tuple[float, tuple[float, float, float]]:
    """The margin of the smallest loss and its curve, from rows (toxic, per_word, per_root) of left-out folds."""
    each = measured.select("toxic", F.posexplode(F.arrays_zip("per_word", "per_root")).alias("margin", "m"))
    each = each.select(F.col("toxic").cast("int").alias("toxic"), "margin", "m.per_word", "m.per_root")
    ranges = each.groupBy("margin").agg(*[f(c).alias(f"{k}_{c}") for c in ("per_word", "per_root") for k, f in (("low", F.min), ("high", F.max))])
    ranges = {r["margin"]: r for r in ranges.collect()}  # a row a margin
    if not ranges:
        return margins[0], (0.0, 0.0, 0.0)

    def bin_of(c: str) -> Column:
        low = F.get(F.array(*[F.lit(ranges[i][f"low_{c}"]) for i in range(len(margins))]), F.col("margin"))
        width = [max(ranges[i][f"high_{c}"] - ranges[i][f"low_{c}"], 1e-9) / BINS for i in range(len(margins))]
        return F.least(F.floor((F.col(c) - low) / F.get(F.array(*map(F.lit, width)), F.col("margin"))), F.lit(BINS - 1))

    bins = each.groupBy("margin", "toxic", bin_of("per_word").alias("a"), bin_of("per_root").alias("b")).agg(
        F.count("*").alias("n"), F.avg("per_word").alias("per_word"), F.avg("per_root").alias("per_root")).orderBy("margin", "toxic", "a", "b").toArrow()
    place, y, n, *x = (bins[c].to_numpy().astype(float) for c in ("margin", "toxic", "n", "per_word", "per_root"))
    fits = [fit_curve(y[place == i], n[place == i], np.column_stack(x)[place == i]) for i in range(len(margins))]
    best = min(range(len(margins)), key=lambda i: (fits[i][1], i))
    return margins[best], fits[best][0]


def held_out(id_col: str) -> Column:
    """Rows whose labels are not to be learnt from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, fold). Labels go to the texts while they are few enough to; else both sides are dealt by id."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return texts.join(marks, "id").select(
        "text", F.col("toxic") > 0, F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")).toDF("text", "toxic", "fold")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          shipped_words: int = SHIPPED_WORDS) -> Scorer | None:
    """The scorer; None if a class has no words. ``labels`` has ids and 0/1 labels."""
    rows = _training_rows(docs, labels, id_col, text_col, label_col)
    words = differences(materialized(count_words(rows), "toxicity-words"))
    if words is None:
        return None
    words = materialized(telling(words, min(MARGINS)), "toxicity-differences")
    measured = measures(rows.select("text", "toxic", F.col("fold").alias("model")), words, MARGINS, shipped_words)
    margin, curve = pick_margin(materialized(measured, "toxicity-measures"))
    last = words.select("word", F.slice("differences", FOLDS + 1, 1).alias("differences"))
    return Scorer(materialized(telling(last, margin), "toxicity-telling"), margin, curve)


def score(rows: DataFrame, scorer: Scorer | None, shipped_words: int = SHIPPED_WORDS) -> DataFrame:
    """``rows`` (with a lower-cased column text) without it, with ``score`` from 0 to 1."""
    if scorer is None:
        return rows.drop("text").withColumn("score", F.lit(0.0))
    found = measures(rows.withColumn("model", F.lit(0)), scorer.words, (scorer.margin,), shipped_words)
    z = F.lit(scorer.curve[0]) + scorer.curve[1] * F.col("per_word")[0] + scorer.curve[2] * F.col("per_root")[0]
    return found.withColumn("score", 1 / (1 + F.exp(-z))).drop("per_word", "per_root")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", threshold: float = 0.7, shipped_words: int = SHIPPED_WORDS) -> DataFrame:
    """Per document: id, held_out, score, predicted (1 from ``threshold`` on)."""
    scorer = train(docs, labels, id_col, text_col, label_col, shipped_words)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    found = score(rows, scorer, shipped_words).withColumnRenamed("id", id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more."""
    scorer = train(docs, labels, id_col, text_col, label_col)
    names = [f"c{i}__" for i in range(len(docs.columns))]  # the scorer's own column names stay free
    rows = docs.toDF(*names).withColumn("text", F.lower(F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit(""))))
    return score(rows, scorer).where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
