"""Every registered query against its SQL in DuckDB, and what its plan must not contain."""

import os

import pytest

from gleaner.queries import load_all
from tests.harness import DATA, connect, difference, spark_table, sql_table

FOLDER = f"{DATA}/sf{os.environ.get('GLEANER_SF', '0.001')}"
REGISTRY = load_all()
PYTHON = {"html_to_markdown_written", "udf_map_text", "udtf_cards"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    query = REGISTRY[name]
    df = query.run(spark, FOLDER)
    got = spark_table(df, query.ordered)
    assert got[1], "no rows"
    if query.sql:
        assert difference(got, sql_table(con, query.sql, query.ordered)) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or "EvalPython" not in plan
