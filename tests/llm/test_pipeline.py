"""The pipeline: every stage against what its operator says of the stage's own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from odd import documents, nothing
from parasol.llm import decontaminate, exact_dedup, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_decide_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in kept.collect()}
        if name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_duplicates(docs).where("kept").collect()}
        elif name == "simhash_near_dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "benchmark_decontamination":
            tests = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {r.id for r in decontaminate.contamination(docs, tests).where("not contaminated").collect()}
        elif name == "mixing":
            assert ids == {r.doc_id for r in mixing.mixture(docs).where("sampled").collect()}
        if name != "mixing":
            assert kept.columns == columns
        assert ids <= {r.doc_id for r in docs.collect()} and len(ids) == kept.count() > 0
        docs = kept


def test_stages_bear_odd_rows_and_empty_tables(spark):
    for docs in (documents(spark), nothing(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert all(r.row_key_1__ == r.cell_lang == r.row_nth__ == str(len(r.text or "")) for r in docs.collect())


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "probability"} <= set(found.columns) and 0 < found.count() < 200
    assert found.where(F.col("probability") > 1).count() == 0


def test_a_raking_step_joins_one_small_table(spark, monkeypatch):
    """What a step sends out is built in the driver's memory, ten rounds over."""
    from parasol.llm import mixing
    plans, kept = [], mixing.materialized

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(mixing, "materialized", seen)
    cells = spark.createDataFrame([(s, g, t, 10 * i + j) for i, s in enumerate("abc") for j, (g, t) in enumerate((("de", "x"), ("en", "x"), ("en", "y")))],
                                  "source string, lang string, topic string, tokens long")
    fitted = mixing.rake(cells, {m: mixing.tempered(cells, m, 0.85) for m in mixing.MARGINS}, rounds=2)
    assert [plan.count("Join ") for plan in plans[1:]] == [1] * 6 and fitted.count() == 9
