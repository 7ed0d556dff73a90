"""Scalar features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text, values
from gleaner.operators.aggregates import newest
from gleaner.queries import Tables, query
from gleaner.queries.standins import FEATURES, LABELLED, ORDER_BRANDS, labelled, order_brands, postings, with_cte


@query("collapse_space", r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.collapse_space("text").alias("text"))


@query(
    "clean_company",
    """SELECT c_custkey, replace(replace(c_name, '#', ''''), '00', '''') AS company FROM customer""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.replace(F.replace("c_name", F.lit("#"), F.lit('"')), F.lit("00"), F.lit("’")), F.lit(":"))
    return t.customer.select("c_custkey", text.clean_company(raw).alias("company"))


@query(
    "position_name",
    """SELECT hash, trim(regexp_replace(CASE WHEN p_size > 40 THEN '' ELSE company END || ' - ' || 'a_b' || title || '''', ' +', ' ', 'g')) AS position
FROM (SELECT p_partkey AS hash, p_brand AS company, p_name AS title, p_size FROM part)""",
)
def _(t: Tables) -> DataFrame:
    company = F.when(F.col("p_size") <= 40, F.col("company"))
    title = F.concat(F.lit("a/b"), F.replace("title", F.lit(" "), F.lit("   ")), F.lit('"'))
    return postings(t).select("hash", text.position_name(company, title).alias("position"))


@query("age_to_hours", with_cte("SELECT hash, CAST(hours AS BIGINT) AS hours FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    return postings(t).select("hash", values.age_to_hours("days").alias("hours"))


@query("salary_bounds", with_cte("SELECT hash, lower_k AS lower, upper_k AS upper FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    return postings(t).select("hash", values.salary_bounds("salary").alias("pay")).select("hash", "pay.*")


@query("midpoint", with_cte("SELECT hash, (lower_k + upper_k) / 2 AS median FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    pay = values.salary_bounds("salary")
    return postings(t).select("hash", values.midpoint(pay["lower"], pay["upper"]).alias("median"))


@query("leading_number", with_cte("SELECT hash, CASE WHEN yoe_text <> '-' THEN p_size::DOUBLE END AS yoe FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    return postings(t).select("hash", values.leading_number("yoe_text").alias("yoe"))


@query("shorten_location", with_cte("SELECT hash, company_summary AS location FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    return postings(t).select("hash", text.shorten_location("location").alias("location"))


@query(
    "city_tags",
    """SELECT p_partkey, nullif(array_to_string(regexp_extract_all(p_name, 'hot gear|gear|red|small'), ';'), '') AS tags FROM part""",
)
def _(t: Tables) -> DataFrame:
    hits = text.dictionary_hits("p_name", ["hot gear", "gear", "red", "small"])
    return t.part.select("p_partkey", F.array_join(hits, ";").alias("tags"))


@query("lower_key", "SELECT p_partkey, lower(p_type) AS key FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.lower_key("p_type").alias("key"))


@query("url_of_hash", "SELECT page_id, 'https://example.org/view/' || page_id AS address FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.url_of_key("https://example.org/view/", F.col("page_id").cast("string")).alias("address"))


@query("identifier", with_cte("SELECT position || '.' || hash AS identifier FROM pay", FEATURES))
def _(t: Tables) -> DataFrame:
    return postings(t).select(
        text.identifier(text.position_name("company", "title"), F.col("hash").cast("string")).alias("identifier")
    )


@query(
    "rsplit_parts",
    r"""SELECT page_id, regexp_extract(url, '^(.*)\.([^.]*)$', 1) AS name, regexp_extract(url, '^(.*)\.([^.]*)$', 2) AS hash,
  string_split(url, '://')[1] AS first_part, regexp_replace(url, '\.html$', '') AS bare FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", text.before_last("url", ".").alias("name"), text.after_last("url", ".").alias("hash"),
        text.before_first("url", "://").alias("first_part"), text.remove_suffix("url", ".html").alias("bare"),
    )


@query("list_join_text", with_cte("SELECT id, array_to_string(brands, '; ') AS line FROM order_brands", ORDER_BRANDS))
def _(t: Tables) -> DataFrame:
    df = order_brands(t)
    return df.select("id", values.as_text(df, "brands").alias("line"))


@query(
    "scalar_to_list",
    """SELECT doc_id, 1 AS n_lang, array_to_string([lang], ';') AS lang, 2 AS n_pair, lang || '; ' || source AS pair FROM documents""",
)
def _(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "lang", F.array("lang", "source").alias("pair"))
    return df.select(
        "doc_id", F.size(values.as_list(df, "lang")).alias("n_lang"), F.array_join(values.as_list(df, "lang"), ";").alias("lang"),
        F.size(values.as_list(df, "pair")).alias("n_pair"), values.as_text(df, "pair").alias("pair"),
    )


@query("nested_get", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS inner_name FROM events")
def _(t: Tables) -> DataFrame:
    parsed = t.events.select("event_id", F.from_json("props", "k bigint, inner struct<name:string>").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.col("p.inner.name").alias("inner_name"))


@query("null_list_to_empty", with_cte("SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n FROM labelled", LABELLED))
def _(t: Tables) -> DataFrame:
    listed = F.when(F.col("quality").isNotNull(), F.array("lang"))
    return labelled(t).select("doc_id", F.size(values.list_or_empty(listed)).alias("n"))


@query("date_prefix", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a date")
    return t.orders.select("o_orderkey", F.date_format(values.date_prefix(raw), "yyyy-MM-dd").alias("day"))


@query("floor_seconds", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS second FROM events")
def _(t: Tables) -> DataFrame:
    epoch = F.unix_micros(values.to_utc("ts")) / F.lit(1e6)
    return t.events.select("event_id", F.unix_seconds(values.floor_seconds(epoch)).alias("second"))


@query("to_utc", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.unix_micros(values.to_utc("ts")).alias("micros"))


@query(
    "recency_weight",
    """SELECT o_orderkey, round(greatest(0.0::DOUBLE, 1 - 0.01 * date_sub('day', o_orderdate, (SELECT max(o_orderdate) FROM orders))), 6)::DOUBLE AS weight
FROM orders""",
)
def _(t: Tables) -> DataFrame:
    weight = values.recency_weight("o_orderdate", newest(t.orders, "o_orderdate"))
    return t.orders.select("o_orderkey", F.round(weight, 6).alias("weight"))


@query(
    "lat_lon_pairs",
    """SELECT l_orderkey AS id, l_partkey, l_quantity AS lat, l_extendedprice AS lon FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_quantity + 5, l_extendedprice / 2 FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    from gleaner.queries.filters import line_arrays

    pairs = line_arrays(t).select("id", "l_partkey", F.inline(values.zip_pairs("lat", "lon")))
    return pairs.select("id", "l_partkey", F.col("a").alias("lat"), F.col("b").alias("lon"))


@query("plus_to_space", "SELECT doc_id, replace(replace(text, ' ', '+'), '+', ' ') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.plus_to_space(F.replace("text", F.lit(" "), F.lit("+"))).alias("text"))


@query(
    "format_location",
    """SELECT c_custkey, 'San ' || c_mktsegment || CASE WHEN c_nationkey > 10 THEN ' - ' || c_nationkey || ' miles' ELSE '' END || '. Remote | Hybrid' AS line
FROM customer""",
)
def _(t: Tables) -> DataFrame:
    radius = F.when(F.col("c_nationkey") > 10, F.col("c_nationkey"))
    loc = F.struct(
        F.array(F.struct(F.concat(F.lit("San+"), F.col("c_mktsegment")).alias("long_name"))).alias("address_components"),
        F.struct(radius.alias("radius"), F.when(radius.isNotNull(), "miles").alias("radius_unit")).alias("options"),
        F.array(F.lit("Remote"), F.lit("Hybrid")).alias("workplace_types"),
    )
    return t.customer.select("c_custkey", values.format_location(loc).alias("line"))


@query("fill_placeholder", with_cte("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '...') AS quality FROM labelled", LABELLED))
def _(t: Tables) -> DataFrame:
    return labelled(t).select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("...")).alias("quality"))


@query(
    "dated_label",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS file_day, strftime(o_orderdate, '%Y-%m-%d_%H%M%S') AS file_time,
  strftime(o_orderdate, '%-m/%-d/%y (%A)') AS shown, lower(strftime(o_orderdate, '%-I:%M%p')) AS shown_time FROM orders""",
)
def _(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", text.dated_label(day, 3).alias("file_day"), text.dated_label(day, with_time=True).alias("file_time"),
        text.dated_label(day, for_file=False).alias("shown"), text.dated_label(day, with_time=True, for_file=False).alias("shown_time"),
    )


@query("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", values.value_map("o_orderstatus", {"F": "done", "O": "open"}).alias("state"))


