"""Markdown as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import markdown as ops
from gleaner.queries import Tables, query
from gleaner.queries.standins import MARKDOWN_BLOCKS, markdown_docs, with_cte


@query(
    "md_lines",
    """WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '<!--')) AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)""",
)
def _(t: Tables) -> DataFrame:
    return ops.md_lines(t.documents, "doc_id", "text")


def _blocks(t: Tables) -> DataFrame:
    return ops.md_blocks(markdown_docs(t), "doc_id", "text")


def _rows(t: Tables) -> DataFrame:
    return ops.md_explode(markdown_docs(t), "doc_id", "text")


@query("md_blocks", with_cte('SELECT doc_id, CAST("begin" AS INTEGER) AS "begin", CAST(len AS BIGINT) AS len, tag, markup, content FROM blocks', MARKDOWN_BLOCKS))
def _(t: Tables) -> DataFrame:
    return _blocks(t)


@query(
    "md_explode",
    with_cte('SELECT doc_id, CAST("begin" AS INTEGER) AS "begin", tag, CAST(i AS INTEGER) AS i, CAST(line AS INTEGER) AS line, markdown, condensed FROM rows', MARKDOWN_BLOCKS),
)
def _(t: Tables) -> DataFrame:
    return _rows(t).select("doc_id", "begin", "tag", "i", "line", "markdown", "condensed")


@query(
    "md_line_text",
    with_cte(
        """SELECT doc_id, CAST("begin" AS INTEGER) AS "begin", list_next, array_to_string(md, '|') AS markdown, array_to_string(cd, '|') AS condensed FROM line_text""",
        MARKDOWN_BLOCKS,
    ),
)
def _(t: Tables) -> DataFrame:
    made = ops.md_line_text(markdown_docs(t), "doc_id", "text")
    return made.select(
        "doc_id", "begin", "list_next", F.array_join("markdown", "|").alias("markdown"), F.array_join("condensed", "|").alias("condensed")
    )


@query(
    "md_style",
    with_cte(
        """SELECT doc_id, CAST("begin" AS INTEGER) AS "begin", CAST(i AS INTEGER) AS i,
  CASE rn WHEN 1 THEN 'title' WHEN 2 THEN 'subtitle' WHEN 4 THEN 'Heading 2' ELSE
    CASE WHEN tag IN ('ul', 'li') AND i = 0 THEN 'List Bullet' WHEN tag = 'h2' AND i = 0 THEN 'Heading 2' ELSE 'Normal' END END AS style
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "begin", i) AS rn FROM rows)""",
        MARKDOWN_BLOCKS,
    ),
)
def _(t: Tables) -> DataFrame:
    return ops.md_style(_rows(t), resume=True, pagebreak=True).select("doc_id", "begin", "i", "style")


@query(
    "md_bold_runs",
    with_cte(
        r"""SELECT doc_id, CAST("begin" AS INTEGER) AS "begin", CAST(i AS INTEGER) AS i,
  array_to_string(list_concat(coalesce(regexp_extract_all(' ' || condensed, '.+?\*\*.+?\*\*'), []), [coalesce(string_split('**' || condensed, '**')[-1], '')]), '|') AS runs
FROM rows""",
        MARKDOWN_BLOCKS,
    ),
)
def _(t: Tables) -> DataFrame:
    return _rows(t).select("doc_id", "begin", "i", F.array_join(ops.bold_runs("condensed"), "|").alias("runs"))


@query(
    "md_bold_runs_documents",
    r"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(' ' || t, '.+?\*\*.+?\*\*'), [string_split('**' || t, '**')[-1]]), '|') AS runs
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    return t.documents.select("doc_id", F.array_join(ops.bold_runs(line), "|").alias("runs"))


# blocks of any text by windows over its lines
DOCUMENT_BLOCKS = r"""lines AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '<!--')) AS ls FROM documents))),
fenced AS (
  SELECT *, first_value(t) OVER w AS head, sum(regexp_full_match(t, '---\s*')::INT) OVER w AS fences,
    sum(regexp_full_match(t, '---\s*')::INT) OVER (PARTITION BY doc_id) AS total FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
kinds AS (
  SELECT doc_id, line, t, CASE
    WHEN regexp_full_match(head, '---\s*') AND total >= 2 AND (fences = 1 OR (fences = 2 AND regexp_full_match(t, '---\s*'))) THEN 'front'
    WHEN regexp_full_match(t, '\s*') THEN 'blank' WHEN regexp_matches(t, '^#{1,6}[ \t]+') THEN 'h'
    WHEN regexp_matches(t, '^ {0,3}((-[ \t]*){3,}|(\*[ \t]*){3,}|(_[ \t]*){3,})$') THEN 'hr'
    WHEN regexp_matches(t, '^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \t]+') THEN 'li' ELSE 'p' END AS kind FROM fenced),
opened AS (
  SELECT *, sum((kind IN ('h', 'hr', 'li') OR (kind = 'front' AND line = 0) OR (kind = 'p' AND (before IS NULL OR before IN ('blank', 'h', 'hr', 'front'))))::INT)
    OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM kinds)),
blocks AS (
  SELECT doc_id, min(line) AS "begin", arg_min(kind, line) AS kind,
    coalesce(string_agg(CASE kind WHEN 'h' THEN regexp_extract(t, '^#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)
      WHEN 'li' THEN regexp_extract(t, '^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \t]+(.*)$', 2) WHEN 'p' THEN trim(t, ' ') END, chr(10) ORDER BY line), '') AS content
  FROM opened WHERE kind <> 'blank' AND block > 0 GROUP BY doc_id, block)"""


@query(
    "md_blocks_documents",
    with_cte("""SELECT doc_id, "begin"::INTEGER AS "begin", kind, content FROM blocks""", DOCUMENT_BLOCKS),
)
def _(t: Tables) -> DataFrame:
    """Real texts, of any length, cut into blocks within their rows."""
    tag = F.col("tag")
    kind = F.when(tag.isin("ul", "ol", "li"), "li").when(tag.rlike("^h[1-6]$"), "h").when(tag == "", "front").otherwise(tag)
    return ops.md_blocks(t.documents, "doc_id", "text").select("doc_id", "begin", kind.alias("kind"), "content")
