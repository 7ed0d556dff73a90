"""Inputs that the test tables do not hold as such, made from them by one expression in Spark and one in SQL.

Each SQL constant is a common-table expression named like the function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import left_enrich
from gleaner.queries import Tables
from gleaner.sources.tables import dealt


def with_cte(sql: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + sql


#: lines that a task sorts
TASK_LINES = 150_000


def item_tasks(t: Tables) -> int:
    """Tasks for the lines, by their number: adaptive execution goes by packed bytes, and gathers more into a task as lines grow."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // TASK_LINES))


def order_brands(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """(id, brands): the distinct part brands of each order, sorted; of ``orders`` (id) only, if given.

    Catalyst picks the join by the size of ``part``; a hot part key is split by the adaptive skew join.
    Pairs are made distinct first, in hash aggregates: a hot order leaves each map task as at most one
    row per brand.
    """
    items = t.lineitem.select("l_orderkey", "l_partkey")
    if orders is not None:
        items = items.repartition(item_tasks(t), "l_orderkey")  # a sort of the lines takes memory by the task
        items = items.join(orders, F.col("l_orderkey") == F.col("id"), "left_semi")
    joined = items.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = joined.select(F.col("l_orderkey").alias("id"), "p_brand").distinct()
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list("p_brand")).alias("brands"))


ORDER_BRANDS = """order_brands AS (
  SELECT l_orderkey AS id, list_sort(list(DISTINCT p_brand)) AS brands
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def labelled(t: Tables) -> DataFrame:
    return left_enrich(t.documents, t.labels, "doc_id")


LABELLED = """labelled AS (
  SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def jobs(t: Tables) -> DataFrame:
    """A postings table: text from documents, null-bearing columns from labels."""
    quality, lang, source = F.col("quality"), F.col("lang"), F.col("source")
    return labelled(t).select(
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id")).alias("_hash"),
        F.when(quality.isNotNull(), source).alias("company_name"),
        F.substring_index("text", ".", 1).alias("title"),
        F.concat(lang, F.lit(" from "), source).alias("requirements_summary"),
        F.array(lang, source).alias("technical_tools"),
        F.array(source).alias("role_activities"),
        lang.alias("job_category"),
        F.when(quality == 1, "Senior").when(quality == 0, "Junior").alias("seniority_level"),
        F.when(F.col("toxic") == 1, None).otherwise(F.concat(F.lit("tag "), lang)).alias("company_tagline"),
        F.when(F.col("n_chars") < 500, "Remote").otherwise("Onsite").alias("workplace_type"),
        F.concat(lang, F.lit(", California, United States")).alias("formatted_workplace_location"),
        F.col("text").alias("_md"),
    )


JOBS = (
    LABELLED
    + """,
jobs AS (
  SELECT doc_id, 'd' || doc_id AS _hash, CASE WHEN quality IS NOT NULL THEN source END AS company_name,
    split_part(text, '.', 1) AS title, lang || ' from ' || source AS requirements_summary,
    [lang, source] AS technical_tools, [source] AS role_activities, lang AS job_category,
    CASE quality WHEN 1 THEN 'Senior' WHEN 0 THEN 'Junior' END AS seniority_level,
    CASE WHEN toxic = 1 THEN NULL ELSE 'tag ' || lang END AS company_tagline,
    CASE WHEN n_chars < 500 THEN 'Remote' ELSE 'Onsite' END AS workplace_type,
    lang || ', California, United States' AS formatted_workplace_location, text AS _md
  FROM labelled)"""
)


def salary_text() -> Column:
    n = F.col("p_size")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("yr", "mo", "hr", "wk")]), n % 4 + 1)
    span = F.concat(F.lit("$"), n, F.lit("k-$"), n + 20, F.lit("k/"), unit)
    return F.when(n % 7 == 0, "-").when(n % 5 == 0, F.concat(F.lit("$"), n, F.lit("k/yr"))).otherwise(span)


def age_text() -> Column:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("h", "d", "w", "mo", "y")]), (F.col("p_partkey") % 5).cast("int") + 1)
    return F.concat(F.col("p_size"), unit)


def years_text() -> Column:
    return F.when(F.col("p_size") % 7 == 0, "-").otherwise(F.concat(F.col("p_size"), F.lit("+ YOE")))


def postings(t: Tables) -> DataFrame:
    """Posting texts from parts."""
    return t.part.select(
        F.col("p_partkey").alias("hash"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"),
        F.col("p_type").alias("company_summary"), "p_size", age_text().alias("days"),
        salary_text().alias("salary"), years_text().alias("yoe_text"),
        F.concat("p_type", F.lit(", California, United States")).alias("location"),
    )


POSTINGS = """postings AS (
  SELECT p_partkey AS hash, p_brand AS company, p_name AS title, p_type AS company_summary, p_size,
    p_size || ['h','d','w','mo','y'][CAST(p_partkey % 5 AS INT) + 1] AS days,
    CASE WHEN p_size % 7 = 0 THEN '-' WHEN p_size % 5 = 0 THEN '$' || p_size || 'k/yr'
      ELSE '$' || p_size || 'k-$' || (p_size + 20) || 'k/' || ['yr','mo','hr','wk'][p_size % 4 + 1] END AS salary,
    CASE WHEN p_size % 7 = 0 THEN '-' ELSE p_size || '+ YOE' END AS yoe_text,
    p_type || ', California, United States' AS location
  FROM part)"""

# typed features of the postings, spelled out for the oracle
FEATURES = (
    POSTINGS
    + """,
features AS (
  SELECT *, CAST(regexp_extract(days, '^([0-9]*)', 1) AS BIGINT)
      * CASE regexp_extract(days, '([^0-9]*)$', 1) WHEN 'h' THEN 1 WHEN 'd' THEN 24 WHEN 'w' THEN 168
        WHEN 'mo' THEN 730 WHEN 'y' THEN 8760 END AS hours,
    CASE split_part(salary, '/', 2) WHEN 'yr' THEN 1.0::DOUBLE WHEN 'mo' THEN 12.0::DOUBLE WHEN 'hr' THEN 2.08::DOUBLE
      ELSE 0.0::DOUBLE END AS times,
    split_part(split_part(salary, '/', 1), '-', 1) AS lo,
    string_split(split_part(salary, '/', 1), '-')[-1] AS hi,
    company || ' - ' || title AS position
  FROM postings),
pay AS (
  SELECT *, TRY_CAST(nullif(substr(lo, 2, greatest(length(lo) - 2, 0)), '') AS DOUBLE) * times AS lower_k,
    TRY_CAST(nullif(substr(hi, 2, greatest(length(hi) - 2, 0)), '') AS DOUBLE) * times AS upper_k
  FROM features)"""
)

# Card slots and the bit of the key that leaves an optional one out.
_OPTIONAL = {0: 0, 3: 1, 7: 2, 9: 3, 10: 4, 12: 5}


def _slots() -> list[Column]:
    lit = F.lit
    return [
        age_text(), F.col("p_name"), F.concat("p_type", lit(", United States")),
        F.concat(lit("$"), F.col("p_size"), lit("k-$"), F.col("p_size") + 20, lit("k/yr")), lit("Onsite"),
        lit("Full Time"), F.concat("p_brand", lit(":")), lit("NYSE: ABC"), F.concat(lit(": makes "), F.col("p_name")),
        F.concat(F.col("p_size"), lit("+ YOE")), F.concat(F.col("p_size"), lit("+ Mgmt")), lit("Builds  things"),
        lit("SQL, Python"), lit("Job Posting"), lit("9 views"),
    ]


def cards(t: Tables) -> DataFrame:
    """(hash, cells): card texts with optional slots left out by the bits of the key."""
    cells = [
        F.when(F.col("p_partkey").bitwiseAND(1 << _OPTIONAL[i]) == 0, s) if i in _OPTIONAL else s
        for i, s in enumerate(_slots())
    ]
    return t.part.select(F.col("p_partkey").alias("hash"), F.array_compact(F.array(*cells)).alias("cells"))


def repaired(t: Tables) -> DataFrame:
    """What repair must give: the left-out slots filled in."""
    fill = {0: "0h", 3: "-", 7: "-", 9: "-", 10: "-", 12: "-"}
    cells = [
        F.when(F.col("p_partkey").bitwiseAND(1 << _OPTIONAL[i]) == 0, s).otherwise(fill[i]) if i in _OPTIONAL else s
        for i, s in enumerate(_slots())
    ]
    return t.part.select(F.col("p_partkey").alias("hash"), F.array(*cells).alias("cells"))


_SQL_SLOTS = [
    "p_size || ['h','d','w','mo','y'][CAST(p_partkey % 5 AS INT) + 1]", "p_name", "p_type || ', United States'",
    "'$' || p_size || 'k-$' || (p_size + 20) || 'k/yr'", "'Onsite'", "'Full Time'", "p_brand || ':'", "'NYSE: ABC'",
    "': makes ' || p_name", "p_size || '+ YOE'", "p_size || '+ Mgmt'", "'Builds  things'", "'SQL, Python'",
    "'Job Posting'", "'9 views'",
]
REPAIRED = "repaired AS (SELECT p_partkey AS hash, [" + ", ".join(
    f"CASE WHEN (p_partkey & {1 << _OPTIONAL[i]}) = 0 THEN {s} ELSE '{'0h' if i == 0 else '-'}' END" if i in _OPTIONAL else s
    for i, s in enumerate(_SQL_SLOTS)
) + "] AS cells FROM part)"


def key_sets(t: Tables) -> dict[str, DataFrame]:
    """Customers with an order of status F, O, P."""
    return {s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O", "P")}


KEY_SETS = """flags AS (
  SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'P') AS p
  FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1)"""


def markdown_docs(t: Tables) -> DataFrame:
    """(doc_id, text): a small Markdown document per part."""
    item = F.transform(
        F.sequence(F.lit(1), F.col("p_size") % 4 + 1),
        lambda i: F.concat(F.lit("- **"), F.col("p_type"), F.lit(":** "), F.col("p_name"), F.lit(" "), i.cast("string")),
    )
    text = F.concat(
        F.lit("<!-- note -->\n## **"), F.col("p_brand"), F.lit("**\nMakes **"), F.col("p_name"), F.lit("** daily\nand more\n\n"),
        F.array_join(item, "\n"), F.lit("\n\nEnd of "), F.col("p_name"), F.lit("\n"),
    )
    parts = dealt(t.part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size"))
    return parts.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


MARKDOWN_DOCS = r"""markdown_docs AS (
  SELECT p_partkey AS doc_id, p_size % 4 + 1 AS k,
    '<!-- note -->' || chr(10) || '## **' || p_brand || '**' || chr(10) || 'Makes **' || p_name || '** daily' || chr(10)
    || 'and more' || chr(10) || chr(10)
    || array_to_string(list_transform(range(1, p_size % 4 + 2), lambda i: '- **' || p_type || ':** ' || p_name || ' ' || i), chr(10))
    || chr(10) || chr(10) || 'End of ' || p_name || chr(10) AS text
  FROM part)"""

# blocks of those documents, written down from their known shape
MARKDOWN_BLOCKS = (
    MARKDOWN_DOCS
    + """,
blocks AS (
  SELECT p_partkey AS doc_id, 0::BIGINT AS "begin", 3::BIGINT AS len, 'h2' AS tag, '##' AS markup, '**' || p_brand || '**' AS content FROM part
  UNION ALL SELECT p_partkey, 1, 3, 'p', '', 'Makes **' || p_name || '** daily' || chr(10) || 'and more' FROM part
  UNION ALL SELECT p_partkey, 3 + i, 5 + (i = 1)::INT + (i = k)::INT, CASE WHEN i = k THEN 'ul' ELSE 'li' END, '-',
      '**' || p_type || ':** ' || p_name || ' ' || i
    FROM (SELECT *, p_size % 4 + 1 AS k, unnest(range(1, p_size % 4 + 2)) AS i FROM part)
  UNION ALL SELECT p_partkey, 3 + (p_size % 4 + 1) + 2, 3, 'p', '', 'End of ' || p_name FROM part),
line_text AS (
  SELECT *, coalesce(lead(tag) OVER w IN ('ul', 'li'), FALSE) AS list_next,
    string_split(ltrim(markup || ' ' || content) || CASE WHEN tag = 'li' THEN '' ELSE chr(10) END, chr(10)) AS md,
    string_split(content || CASE WHEN tag IN ('li', 'h2') OR coalesce(lead(tag) OVER w IN ('ul', 'li'), FALSE) THEN '' ELSE chr(10) END, chr(10)) AS cd
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY "begin")),
rows AS (
  SELECT doc_id, "begin", tag, list_next, i - 1 AS i, "begin" + i AS line, md[i] AS markdown, cd[i] AS condensed
  FROM (SELECT *, unnest(range(1, len(md) + 1)) AS i FROM line_text))"""
)
