"""The forms in which row functions are handed to the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import masks
from gleaner.functions.nested import html_to_markdown_nested
from gleaner.functions.tables import PageLinks
from gleaner.operators.markdown import block_agg, md_lines
from gleaner.queries import Tables, query
from gleaner.queries.standins import ORDER_BRANDS, order_brands, with_cte


@query("udf_map_text")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html_to_markdown_nested("html").alias("md"))


@query(
    "udf_list_predicate",
    with_cte("SELECT id, len(list_filter(brands, lambda x: ends_with(x, '1'))) > 0 AS hit FROM order_brands", ORDER_BRANDS),
)
def _(t: Tables) -> DataFrame:
    return order_brands(t).select("id", F.exists("brands", lambda x: x.endswith("1")).alias("hit"))


@query("udf_row", with_cte("SELECT id, brands[(id % 4) + 1] AS pick FROM order_brands", ORDER_BRANDS))
def _(t: Tables) -> DataFrame:
    return order_brands(t).select("id", F.get("brands", (F.col("id") % 4).cast("int")).alias("pick"))


@query("udaf_join", "SELECT doc_id, text FROM documents WHERE NOT starts_with(text, '<!--')")
def _(t: Tables) -> DataFrame:
    """Lines joined again in order give back each text."""
    lines = md_lines(t.documents, "doc_id", "text").withColumn("block", F.lit(0)).withColumn("tag", F.lit("p"))
    return block_agg(lines, "doc_id", "block", "line", "tag", "text").select("doc_id", F.col("content").alias("text"))


@query("mask_reduce", "SELECT doc_id, contains(text, 'zu') OR contains(text, 'ou.') OR lang = 'fr' AS hit FROM documents")
def _(t: Tables) -> DataFrame:
    tests = [F.contains("text", F.lit("zu")), F.contains("text", F.lit("ou.")), F.col("lang") == "fr"]
    return t.documents.select("doc_id", masks.any_of(tests).alias("hit"))


@query(
    "udtf_cards",
    r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS card, hrefs[i] AS href, trim(texts[i]) AS label
FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.lateralJoin(PageLinks(F.col("html").outer())).select("page_id", "card", "href", "label")
