import os

import pytest

from tests.compare import FOLDER, assert_same
from tidemark.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, tmp_path, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name], tmp_path / "got")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
