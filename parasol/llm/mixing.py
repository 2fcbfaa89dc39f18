"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

*Cells.* Tokens are added up by (source, language, topic) inside each map task
first, so a source with a third of all rows sends one row per task and cell.
*Targets.* Each margin's target is its token share tempered (raised to a power,
by margin in ``TEMPER``, and normalised), or given.
*Raking.* A cell's weight is its tokens times one factor per margin value. In
turn, each margin's factors are set so that its weighted totals equal its
targets, ``rounds`` times over. A step adds up the cells and writes them
with their new factors to the shared folder, which cuts the lineage.
*Sampling.* A document's probability is its cell's factor product over the
largest one, so expected tokens meet all three targets at the largest scale at
which no probability exceeds 1. It is kept if a number between 0 and 1 hashed
from its id and the seed lies below.

Null source, language or text count as empty; a document without tokens weighs
nothing in the fit and is sampled with its cell's probability. Repeated rows
weigh each and share their fate. A margin without tokens keeps the factor 1.
Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.common import by_place
from parasol.session import materialized

MARGINS = ("source", "lang", "topic")
ROUNDS = 10
TEMPER = {"source": 0.85, "lang": 0.85, "topic": 1.0}
HASH_BITS = 52
RESULTS = ["topic", "n_tokens", "weight", "probability", "sampled"]


def token_count(text: Column) -> Column:
    """Words between blanks, tabs and line ends, the token of a mixture's budget."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\r\\n]+")).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text: legal, contact, capitals or prose."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    return (F.when(low.contains("license") | low.contains("licence") | low.contains("copyright"), "legal")
            .when(text.contains("@"), "contact").when(~text.rlike("[a-z]"), "capitals").otherwise("prose"))


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(margin value, target): the total tokens dealt out by tempered shares. Two sums go through the driver."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("n"))
    whole, powers = sums.agg(F.sum("n"), F.sum(F.pow("n", F.lit(temper)))).first()
    share = F.pow("n", F.lit(temper)) / F.lit(powers) if powers else F.lit(0.0)
    return sums.select(margin, (share * F.lit(whole or 0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, tokens) with ``factor``, the product of the fitted factors."""
    for m, t in targets.items():
        cells = cells.join(t.select(m, F.col("target").alias(f"t_{m}")), m).withColumn(f"f_{m}", F.lit(1.0))
    cells = materialized(cells, "mix-raked")
    for _ in range(rounds):
        for margin in targets:
            weight = F.col("tokens").cast("double")
            for other in targets:
                if other != margin:
                    weight = weight * F.col(f"f_{other}")
            # One small table is joined per step: what is sent out costs the driver memory each time.
            totals = cells.groupBy(margin).agg(F.sum(weight).alias("total"))
            factor = F.when(F.col("total") > 0, F.col(f"t_{margin}") / F.col("total")).otherwise(1.0)
            cells = materialized(cells.join(totals, margin).withColumn(f"f_{margin}", factor).drop("total"), "mix-raked")
    product = F.lit(1.0)
    for margin in targets:
        product = product * F.col(f"f_{margin}")
    return cells.select(*targets, "tokens", product.alias("factor"))


def unit_hash(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << HASH_BITS))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: dict[str, float] | None = None,
            rounds: int = ROUNDS, seed: int = 1, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with topic, n_tokens, weight (the cell's factor), probability and sampled."""
    docs = docs.drop(*RESULTS)
    marked, (id_col, text_col, source, lang) = by_place(docs, id_col, text_col, "source", "lang")
    marked = marked.withColumns({
        "topic": topic_of(F.col(text_col)), "n_tokens": token_count(F.col(text_col)),
        "source": F.coalesce(F.col(source).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang).cast("string"), F.lit(""))})
    cells = materialized(
        marked.select(*MARGINS, "n_tokens").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")),
        "mix-cells")
    fitted = rake(cells, targets or {m: tempered(cells, m, (temper or TEMPER)[m]) for m in MARGINS}, rounds)
    fitted = materialized(fitted, "mix-fitted")
    largest = fitted.where("tokens > 0").agg(F.max("factor")).first()[0]
    probability = F.least(F.lit(1.0), F.col("factor") / F.lit(largest)) if largest else F.lit(1.0)
    fitted = fitted.select(*[F.col(m).alias(f"cell_{m}") for m in MARGINS], F.col("factor").alias("weight"),
                           probability.alias("probability"))
    # Written, so that its size is known: the planner sends it to the documents if it is small.
    fitted = materialized(fitted, "mix-probabilities")
    on = [F.col(m) == F.col(f"cell_{m}") for m in MARGINS]
    found = marked.join(fitted, on).withColumn("sampled", unit_hash(F.col(id_col), seed) < F.col("probability"))
    return found.select(*[f"c{i}__" for i in range(len(docs.columns))], *RESULTS).toDF(*docs.columns, *RESULTS)
