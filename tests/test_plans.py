"""Shapes of physical plans that matter at scale."""

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
QUERIES = queries()
# Streams, loads and learned models run jobs to be built; their plans are those of the parts.
LAZY = sorted(n for n in QUERIES if re.match(r"[fgjmprtvwx]\d", n) and n not in ("t2_top_features", "g19_run_summary")
              and not n.startswith(("p11", "p12")))


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)


@pytest.mark.parametrize("name", ["f4_claims_of_worker", "w6_recent_claims"])
def test_top_n_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


@pytest.mark.parametrize("name", ["f5_newest_claims", "f7_pending_outbox", "f8_failed_by_topic", "t1_top_zones"])
def test_sorted_limits_keep_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_lookup_reaches_the_file(spark):
    assert "EqualTo(c_name,Customer#000000007)" in plan(spark, "f3_equality_lookups")


def test_signals_read_only_their_columns(spark):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "w3_others_on_device")))
    assert read == {"o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz"}


def test_zone_windows_are_split_by_cell(spark):
    text = plan(spark, "w1_zone_burst")
    raw = re.findall(r"Window \[[^\]]*v#\d+L?\)[^\]]*\], \[([^\]]*)\]", text)
    assert raw and all("_cell" in keys for keys in raw)


def test_premium_queries_train_the_default_model(tables, monkeypatch):
    import inspect

    from parasol.plans import learning, model_queries
    right, asked = inspect.signature(learning.train_premium_model), []
    monkeypatch.setattr(learning, "train_premium_model", lambda *a, **k: asked.append(right.bind(*a, **k)))
    monkeypatch.setattr(model_queries, "once", lambda t, name, user, build: build())
    model_queries._premium_model(tables, "test")
    asked[0].apply_defaults()
    assert (asked[0].arguments["trees"], asked[0].arguments["rate"], asked[0].arguments["depth"]) == (400, 0.03, 6)
