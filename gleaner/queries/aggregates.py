"""Summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import all_matches, dictionary_hits, share_text
from gleaner.functions.values import age_to_hours, midpoint, salary_bounds, whole_days
from gleaner.operators import aggregates as ops
from gleaner.operators import sketches
from gleaner.operators.markdown import block_agg
from gleaner.operators.filters import since
from gleaner.queries import Tables, query
from gleaner.queries.standins import FEATURES, ORDER_BRANDS, POSTINGS, order_brands, postings, with_cte
from gleaner.session import scratch_path
from gleaner.sources import dated


def _priced(t: Tables) -> DataFrame:
    pay = salary_bounds("salary")
    df = postings(t).withColumns({"lower": pay["lower"], "upper": pay["upper"], "hours": age_to_hours("days")})
    return df.withColumn("median", midpoint("lower", "upper"))


@query(
    "company_rollup",
    with_cte(
        """SELECT company, count(*) AS n_jobs, min_by(company_summary, hash) AS company_summary, min(hours) // 24 AS days,
  min(lower_k) AS lower, round(avg((lower_k + upper_k) / 2), 2) AS median, max(upper_k) AS upper
FROM pay GROUP BY company""",
        FEATURES,
    ),
)
def _(t: Tables) -> DataFrame:
    return ops.company_rollup(_priced(t))


@query(
    "company_rollup_lists",
    with_cte(
        """SELECT company, field, value, count(*) AS n FROM (
  SELECT company, 'title' AS field, title AS value FROM postings
  UNION ALL SELECT company, 'skills', unnest(string_split(title, ' ')) FROM postings
  UNION ALL SELECT company, 'location', replace(location, ', United States', '') FROM postings
  UNION ALL SELECT company, 'bay', unnest(regexp_extract_all(location, 'BRASS|STEEL|TIN')) FROM postings)
GROUP BY ALL""",
        POSTINGS,
    ),
)
def _(t: Tables) -> DataFrame:
    """The list columns of the rollup, a row per company and value."""
    posts = postings(t).select(
        "company", "title", F.split("title", " ").alias("skills"), dictionary_hits("location", ["BRASS", "STEEL", "TIN"]).alias("bay"),
        F.replace("location", F.lit(", United States"), F.lit("")).alias("location"),
    )
    return ops.company_lists(posts, ["title", "skills", "location", "bay"])


@query(
    "count_and_distinct",
    """SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders GROUP BY 1
UNION ALL SELECT 'ALL', count(*), count(DISTINCT o_custkey) FROM orders""",
)
def _(t: Tables) -> DataFrame:
    return ops.count_and_distinct(t.orders, "o_orderstatus", "o_custkey")


_SPANS = """WITH e AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, (SELECT max(CAST(ts AS DATE)) FROM events) AS last FROM events)
"""


@query(
    "distinct_over_days",
    _SPANS + """SELECT 'all' AS span, event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, true AS estimate_holds FROM e GROUP BY 2
UNION ALL SELECT 'week', event_type, count(*), count(DISTINCT user_id), true FROM e WHERE day > last - 7 GROUP BY 2""",
)
def _(t: Tables) -> DataFrame:
    """Sketches stored per day and type, written in two goes and merged over two spans; the exact counts beside them."""
    daily = t.events.withColumn("day", F.to_date("ts"))
    store = scratch_path(t.spark, "daily-sketches")
    for half in (F.dayofmonth("day") > 15, F.dayofmonth("day") <= 15):  # days may come in any order
        dated.write_days(sketches.daily_sketches(daily.filter(half), ["day", "event_type"], "user_id"), store, "day")
    spans = {"all": None, "week": 7}

    def within(df: DataFrame, days: int | None) -> DataFrame:
        return df if days is None else df.filter(F.col("day") > F.date_sub(daily.agg(F.max("day").alias("day")).scalar(), days))

    parts = []
    for span, days in spans.items():
        merged = sketches.merged_counts(within(dated.read_days(t.spark, store, "day"), days), ["event_type"])
        exact = sketches.exact_counts(within(daily, days), ["event_type"], "user_id")
        both = merged.withColumnRenamed("n_keys", "estimate").join(exact.drop("n_rows"), "event_type")
        holds = F.abs(F.col("estimate") - F.col("n_keys")) <= F.greatest(F.lit(1.0), F.col("n_keys") * F.lit(sketches.error_bound()))
        parts.append(both.select(F.lit(span).alias("span"), "event_type", "n_rows", "n_keys", holds.alias("estimate_holds")))
    return parts[0].unionByName(parts[1])


@query(
    "nunique_all",
    "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + " FROM part",
)
def _(t: Tables) -> DataFrame:
    return ops.nunique_all(t.part)


_TOP = """SELECT * FROM (SELECT value, N, round(100.0 * N / (SELECT sum(N) FROM c), 1)::DOUBLE AS percent FROM c ORDER BY N DESC, value LIMIT 10)
UNION ALL SELECT '(Other)', (SELECT sum(N) FROM c)::BIGINT - (SELECT sum(N) FROM (SELECT N FROM c ORDER BY N DESC, value LIMIT 10))::BIGINT,
  round(100.0 * ((SELECT sum(N) FROM c) - (SELECT sum(N) FROM (SELECT N FROM c ORDER BY N DESC, value LIMIT 10))) / (SELECT sum(N) FROM c), 1)::DOUBLE"""


@query("value_counts_topn", "WITH c AS (SELECT p_brand AS value, count(*) AS N FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)\n" + _TOP)
def _(t: Tables) -> DataFrame:
    brands = t.lineitem.select("l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return ops.value_counts(brands, "p_brand", 10)


@query(
    "explode_value_counts",
    with_cte(_TOP.replace("(SELECT sum(N) FROM c), 1)", "(SELECT count(*) FROM order_brands), 1)"), ORDER_BRANDS,
             "c AS (SELECT b AS value, count(*) AS N FROM (SELECT unnest(brands) AS b FROM order_brands) GROUP BY 1)"),
)
def _(t: Tables) -> DataFrame:
    return ops.exploded_counts(order_brands(t), "brands", 10)


_TOP_SKILLS = with_cte(
    _TOP.replace("(SELECT sum(N) FROM c), 1)", "(SELECT count(*) FROM recent), 1)"), ORDER_BRANDS,
    "recent AS (SELECT * FROM order_brands JOIN orders ON id = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01')",
    "c AS (SELECT b AS value, count(*) AS N FROM (SELECT unnest(brands) AS b FROM recent) GROUP BY 1)",
)


@query("top_skills", _TOP_SKILLS)
def top_skills(t: Tables) -> DataFrame:
    """Top list elements among recent rows: the flagship, from scan to report.

    The date filter reaches the scan of ``orders``, whose keys thin out the lines ahead of all other work.
    """
    recent = since(t.orders, "o_orderdate", "1998-01-01").select(F.col("o_orderkey").alias("id"))
    return ops.exploded_counts(order_brands(t, recent), "brands", 10)


@query(
    "share_true",
    r"""SELECT count(*) FILTER (m) AS N, count(*) FILTER (NOT m) AS n_false, count(*) AS total, round(100.0 * count(*) FILTER (m) / count(*), 4)::DOUBLE AS percent
FROM (SELECT coalesce(regexp_matches(lower(text), '(^|[^\pL\pN_])zu'), FALSE) AS m FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    from gleaner.functions.masks import regex_mask

    return ops.share_true(t.documents, regex_mask("zu", "text"), with_false=True)


@query(
    "share_text",
    """SELECT source_ok || ' of ' || format('{:,}', total) || ' (' || printf('%.1f', 100.0 * n / total) || '%)' AS line
FROM (SELECT format('{:,}', count(*) FILTER (quality = 1)) AS source_ok, count(*) FILTER (quality = 1) AS n, count(*) AS total FROM labels)""",
)
def _(t: Tables) -> DataFrame:
    share = ops.share_true(t.labels, F.col("quality") == 1)
    return share.select(share_text(F.col("N"), F.col("total")).alias("line"))


_LINES = """lines AS (SELECT doc_id, i - 1 AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query(
    "block_agg",
    with_cte(
        """SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, max_by(tag, line) AS last_tag, min_by(text, line) AS first_text,
  string_agg(text, chr(10) ORDER BY line) AS content
FROM (SELECT *, line // 5 AS block, CASE WHEN length(text) < 40 THEN 'short' ELSE 'p' END AS tag FROM lines) GROUP BY 1, 2""",
        _LINES,
    ),
)
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("block", F.floor(F.col("line") / 5)).withColumn(
        "tag", F.when(F.length("text") < 40, "short").otherwise("p")
    )
    return block_agg(lines, "doc_id", "block", "line", "tag", "text")


@query("collect_matches", "SELECT doc_id, array_to_string(regexp_extract_all(text, '([A-Z][a-z]+)[.]', 1), '|') AS hits FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(all_matches("text", "([A-Z][a-z]+)[.]"), "|").alias("hits"))


@query(
    "max_scalar",
    "SELECT o_orderkey, date_sub('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS days_old FROM orders",
)
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", whole_days(F.col("o_orderdate"), ops.newest(t.orders, "o_orderdate")).alias("days_old"))


@query("payload_sizes", "SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS dsize FROM pages")
def _(t: Tables) -> DataFrame:
    return ops.with_size(t.pages, "html").select("page_id", "url", "dsize")


@query("any_match", "SELECT bool_or(contains(text, '***')) AS found FROM documents")
def _(t: Tables) -> DataFrame:
    return ops.any_match(t.documents, F.contains("text", F.lit("***")))
