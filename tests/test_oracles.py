"""Every registered query with SQL gives the oracle's rows; the others run."""

import pytest
from compare import duck_rows, spark_rows

from corvane.catalog import ORACLE_SQL, QUERIES

#: Models with production settings take minutes; tests of the operators fit small ones.
SLOW = {"logreg_scores", "forest_scores", "gbt_scores", "feature_importance", "model_selection", "feature_ablation"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    made = entry.entry(spark)
    assert made.columns == ["source1_id", "matches"]
    assert made.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
