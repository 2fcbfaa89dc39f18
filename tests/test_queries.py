"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, why, rows = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert ok, why
    assert rows > 0 or name.startswith(("d1", "f8"))


def test_entry(spark):
    assert entry(spark).count() == 25


def test_model_card(spark):
    card = QUERIES["p11_premium_model_card"](spark, SF).first()
    assert card.test_r2 > 0.9 and card.training_rows + card.test_rows == 1800


def test_predictions_stay_in_the_price_band(spark):
    rows = QUERIES["p12_predicted_premiums"](spark, SF)
    assert rows.where("premium < greatest(20, base_premium * 0.6) - 0.006 or premium > base_premium * 2.2 + 0.006").count() == 0


def test_model_decisions(spark):
    rows = QUERIES["l5_decision_with_model"](spark, SF)
    assert rows.where("score < 0 or score > 100 or ml_score is null").count() == 0
    assert rows.where("approved and score >= 50").count() == 0
    assert rows.where("risk_level not in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')").count() == 0
    blend = "abs(score - (rule_score * 0.65 + ml_score * 0.35)) > 0.051 and layers <> 'Layer 3 Proactive'"
    assert rows.where(blend).count() == 0


def test_top_features(spark):
    rows = QUERIES["t2_top_features"](spark, SF).collect()
    assert len(rows) == 8 and rows[0].importance >= rows[-1].importance
