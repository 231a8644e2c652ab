import os

import pytest

from tests.compare import FOLDER, assert_same
from tidemark.plans import analytics_queries, evaluation_queries, history_queries, stream_queries, training

PLANS = [training, history_queries, analytics_queries, evaluation_queries, stream_queries]
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PLANS for k, v in p.ORACLES.items()}
SLOW = {"time_window_scores", "model_comparison", "ablation", "calibration", "permutation_importance"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, tmp_path, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name], tmp_path / "got")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
