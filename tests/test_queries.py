import pytest

from oracle import DATA, agree
from terraspark.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_oracle(spark, name):
    agree(spark, name)


def test_rows_only(spark):
    assert queries.rf_score_ml(spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"pixel_id", "n_obs", "probability", "prob_u8", "class"}


def test_each_query_has_a_statement_or_a_reason():
    without = set(queries.QUERIES) - set(oracles.SQL)
    assert without == {"rf_score_ml"}
