"""Registered queries on tables where one key, user, source or text holds a third of the rows."""

import os

import duckdb
import pytest

from gleaner.queries import load_all
from tests.harness import DATA, TABLES, connect, difference, spark_table, sql_table

SOURCE = f"{DATA}/sf0.001"
REGISTRY = load_all()
# the columns that a third of the rows share one value of
HOT = {
    "lineitem": {"l_orderkey": "1", "l_partkey": "1"},
    "orders": {"o_custkey": "1"},
    "part": {"p_brand": "'Brand#1'", "p_name": "'red bolt'"},
    "events": {"user_id": "7"},
    "conversations": {"text": "'same text'"},
    "documents": {"source": "'src1'"},
}
NAMES = [
    "top_skills", "explode_value_counts", "value_counts_topn", "has_any_element", "company_rollup", "company_rollup_lists",
    "count_and_distinct", "nunique_all", "dedupe_keep_first", "dedupe_keep_last", "dedupe_latest", "dedupe_any",
    "lead_flag", "nth_occurrence", "inner_join_renamed_keys", "semi_join", "in_list_filter", "membership_flags",
    "set_overlap", "except_keys", "anti_join_new_keys", "prompt_text", "keys_of_mask", "incremental_first_seen",
    "incremental_upsert_latest", "multi_key_join_nullsafe", "record_by_key", "snapshot_to_postings",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables are not here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        row = "(SELECT *, row_number() OVER () AS _rn FROM read_parquet('{}/{}.parquet'))".format(SOURCE, name)
        changes = ", ".join(f"CASE WHEN _rn % 3 = 0 THEN {v} ELSE {c} END AS {c}" for c, v in HOT.get(name, {}).items())
        picked = "* EXCLUDE (_rn)" + (f" REPLACE ({changes})" if changes else "")
        duckdb.sql(f"COPY (SELECT {picked} FROM {row}) TO '{out}/{name}.parquet'")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    query = REGISTRY[name]
    assert difference(spark_table(query.run(spark, folder)), sql_table(connect(folder), query.sql)) is None
