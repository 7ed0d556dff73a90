"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup, text
from gleaner.queries import Tables, query
from gleaner.queries.standins import postings, POSTINGS, with_cte
from gleaner.session import scratch_path
from gleaner.sources import files, searches, tables

BASE = "https://search.example.org/?searchState="


@query("read_jobs_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    return tables.read_table(t.spark, t.path("documents")).select("doc_id", "text", "lang", "source", "n_chars")


@query(
    "sql_parquet_scan",
    """SELECT vec_id, label, len(embedding) AS width,
  array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') AS milli
FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    return tables.sql_on_file(
        t.spark, t.path("embeddings"),
        "vec_id, label, cast(size(embedding) AS bigint) AS width, "
        "array_join(transform(embedding, x -> cast(floor(cast(x AS double) * 1000) AS string)), ',') AS milli",
    )


@query("parquet_cache", "SELECT DISTINCT o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cache")

    def build() -> DataFrame:
        return t.orders.select("o_custkey", "o_orderstatus", "o_totalprice").distinct()

    tables.cached_parquet(t.spark, path, build)
    return tables.cached_parquet(t.spark, path, build)  # reads what the first call wrote


@query("csv_reference_list", "SELECT n_name AS city FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cities")
    listed = t.nation.select(F.col("n_name").alias("city"))
    noted = t.region.select(F.concat(F.lit("#"), F.col("r_name")).alias("city"))
    noted.unionByName(listed).write.csv(path, header=True)
    return files.reference_list(t.spark, path, "city")


@query("csv_distinct_sink", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "words")
    files.write_distinct_csv(t.part.select(F.split("p_name", " ").alias("word")), "word", path)
    return t.spark.read.csv(path, schema="word string")


def _snapshots(t: Tables) -> str:
    root = scratch_path(t.spark, "snapshots")
    days = t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("query"), F.col("event_id").cast("string")
    )
    days.write.partitionBy("day", "query").text(root)
    return root


@query(
    "snapshot_glob_scan",
    "SELECT strftime(ts, '%Y-%m-%d') AS snapshot_date, event_type AS query, CAST(event_id AS VARCHAR) AS value FROM events",
)
def _(t: Tables) -> DataFrame:
    found = files.snapshot_scan(t.spark, _snapshots(t), "part-*.txt", whole=False)
    return found.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "query", "value")


@query(
    "file_inventory",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes
FROM events GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    found = files.file_inventory(t.spark, _snapshots(t), "part-*.txt", since=1)
    day = F.regexp_extract("path", r"/day=([^/]+)/", 1)
    return found.groupBy(day.alias("day")).agg(F.sum("size").alias("bytes"))


@query(
    "file_inventory_check",
    "SELECT 'pages' AS store, count(*) AS n_rows, count(DISTINCT url) AS n_names FROM pages",
)
def _(t: Tables) -> DataFrame:
    return files.name_check(t.pages, "url", "pages")


@query("nonempty_files", "SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE octet_length(encode(html)) > 5")
def _(t: Tables) -> DataFrame:
    size = F.octet_length("html").cast("bigint")
    return files.nonempty(t.pages, size).select("page_id", size.alias("bytes"))


@query(
    "record_by_key",
    """SELECT user_id, props, event_id FROM events WHERE user_id = 7
ORDER BY ts DESC, props LIMIT 1""",
)
def _(t: Tables) -> DataFrame:
    return tables.payload_by_key(t.events, "user_id", 7, "props", "ts").select("user_id", "props", "event_id")


@query("consolidate_payloads", "SELECT page_id, url, md5(html) AS digest, octet_length(encode(html)) AS bytes FROM pages")
def _(t: Tables) -> DataFrame:
    merged = tables.consolidate(t.pages, scratch_path(t.spark, "merged"))
    return merged.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").cast("bigint").alias("bytes"))


@query("identifier_list_sink", with_cte("SELECT company || ' - ' || title || '.' || hash AS value FROM postings", POSTINGS))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "identifiers")
    named = postings(t).select(text.position_name("company", "title").alias("position"), "hash")
    files.write_identifiers(named, "position", "hash", path)
    return t.spark.read.text(path)


@query("log_scan", "SELECT CAST(p_partkey AS VARCHAR) AS hash FROM part WHERE p_size > 10")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    entry = F.concat(
        F.when(F.col("p_size") > 10, "Skip ").otherwise("Done "), F.col("p_name"), F.lit("."), F.col("p_partkey"), F.lit(".html.pkl")
    )
    t.part.select(entry).write.text(path)
    return files.skipped_keys(files.read_log(t.spark, path))


def _search_texts(t: Tables) -> DataFrame:
    """A saved search per page, as JSON text."""
    search = F.struct(
        F.replace(markup.page_title("html"), F.lit(" "), F.lit("+")).alias("jobTitleQuery"),
        F.col("page_id").alias("dateFetchedPastNDays"),
        F.array(F.lit(0), F.col("page_id")).alias("roleYoeRange"),
        F.array(F.lit("Full+Time"), F.lit("Contract")).alias("commitmentTypes"),
    )
    return t.pages.select(F.col("page_id").cast("string").alias("name"), F.to_json(search).alias("text"))


def _search_urls(t: Tables) -> DataFrame:
    return _search_texts(t).select("name", searches.search_url("text", BASE).alias("url"))


_SEARCH_SQL = r"""SELECT CAST(page_id AS VARCHAR) AS name, page_id AS days, page_id AS years_to,
  'Full+Time, Contract' AS commitments,
  regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), ' ', '+'), '\s', '', 'g') AS title_query
FROM pages"""


def _search_fields(df: DataFrame) -> DataFrame:
    s = F.col("search")
    return df.select(
        "name", s["dateFetchedPastNDays"].alias("days"), F.get(s["roleYoeRange"], F.lit(1)).alias("years_to"),
        F.array_join(s["commitmentTypes"], ", ").alias("commitments"), s["jobTitleQuery"].alias("title_query"),
    )


@query("saved_search_catalog", _SEARCH_SQL)
def _(t: Tables) -> DataFrame:
    return _search_fields(searches.catalog(_search_urls(t)))


@query(
    "saved_search_url",
    r"""SELECT page_id, '"""
    + BASE
    + r"""' || replace(replace(url_encode(regexp_replace(
  '{"q": "' || regexp_extract(html, '<title>(.*?)</title>', 1) || '", "u": "' || url || '"}', '\s', '', 'g')), '%2B', '+'), '%2F', '/') AS search_url
FROM pages""",
)
def _(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"q": "'), markup.page_title("html"), F.lit('", "u": "'), F.col("url"), F.lit('"}'))
    return t.pages.select("page_id", searches.search_url(body, BASE).alias("search_url"))


@query("saved_search_sink", _SEARCH_SQL)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "searches")
    searches.write_catalog(searches.catalog(_search_urls(t)), path)
    from gleaner.schemas import SAVED_SEARCH

    schema = f"name string, url string, search {SAVED_SEARCH.simpleString()}"
    return _search_fields(t.spark.read.schema(schema).json(path))
