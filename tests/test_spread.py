"""Work that costs far more than reading its rows is dealt over tasks, however few row groups its file has."""

import os

import pytest

from gleaner.queries import load_all
from tests.harness import DATA

FOLDER = f"{DATA}/sf0.001"
NAMES = ["md_blocks", "md_explode", "md_line_text", "md_style", "md_bold_runs", "button_count", "card_extract_listing", "html_to_markdown_written"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_one_file_are_dealt(spark, name):
    made = load_all()[name].run(spark, FOLDER)
    assert made._jdf.queryExecution().toRdd().getNumPartitions() == 8


def test_lines_of_a_task_stay_bounded(spark, monkeypatch):
    from gleaner.queries import Tables, standins

    monkeypatch.setattr(standins, "TASK_LINES", 100)
    tables = Tables(spark, FOLDER)
    n = -(-tables.lineitem.count() // 100)
    assert standins.item_tasks(tables) == n > 8
    made = standins.order_brands(tables, tables.orders.selectExpr("o_orderkey AS id"))
    assert f", {n})" in made._jdf.queryExecution().executedPlan().toString()


def test_listing_parts_of_a_task_stay_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gleaner.queries import Tables, standing

    monkeypatch.setattr(standing, "TASK_PARTS", 30)
    tables = Tables(spark, FOLDER)
    n = -(-tables.part.count() // 30)
    root = standing._listing_days(tables, [1, 2, 3], F.lit("1d"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"part-(\d+)", 1))
    assert files.distinct().count() == n > 1
    assert spark.read.text(root).count() == 2 * tables.part.count()
