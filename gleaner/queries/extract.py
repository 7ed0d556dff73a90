"""Tables out of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.nested import html_to_markdown_nested
from gleaner.functions import markup
from gleaner.functions.variants import json_fields, json_get, json_kind, json_value
from gleaner.operators import cards as card_ops
from gleaner.operators.joins import embedded_tables
from gleaner.queries import Tables, query
from gleaner.queries.standins import REPAIRED, cards, repaired, with_cte
from gleaner.sources.tables import dealt
from gleaner.schemas import CARD_SLOTS, EMBEDDED


def _with_script(t: Tables) -> DataFrame:
    """Pages that carry their key and address as embedded JSON."""
    payload = F.to_json(F.struct("page_id", "url"))
    return t.pages.withColumn(
        "html", F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), payload, F.lit("</script>"))
    )


@query(
    "extract_embedded_json",
    """SELECT page_id, '{"page_id":' || page_id || ',"url":"' || url || '"}' AS embedded,
  regexp_extract(html, '<script[^>]*>(.*?)</script>', 1) AS first_script FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return _with_script(t).select(
        "page_id", markup.script_text("html").alias("embedded"), markup.script_text("html", None).alias("first_script")
    )


@query(
    "json_path_get",
    "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.none' AS none FROM events",
)
def _(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k bigint, none string")
    return t.events.select("event_id", parsed["k"].alias("k"), parsed["none"].alias("none"))


def _mixed_json(t: Tables) -> DataFrame:
    """Event properties in six shapes, broken text and null among them."""
    k = F.get_json_object("props", "$.k")
    shapes = [
        F.col("props"), F.concat(F.lit('{"k": "'), k, F.lit('"}')), F.concat(F.lit('{"k": {"n": ['), k, F.lit(', 2]}, "z": null}')),
        F.concat(F.lit("["), k, F.lit(', "a"]')), F.concat(F.lit('{"k": '), k), F.lit(None),
    ]
    shape = F.col("event_id") % 6
    mixed = F.coalesce(*[F.when(shape == i, s) for i, s in enumerate(shapes)])
    return t.events.select("event_id", json_value(mixed).alias("value"))


_EVENT_K = "SELECT event_id, event_id % 6 AS shape, CAST(props ->> '$.k' AS BIGINT) AS k FROM events"


@query(
    "json_variant_get",
    f"""SELECT event_id, CASE WHEN shape IN (0, 1) THEN k END AS as_number, CASE WHEN shape < 2 THEN CAST(k AS VARCHAR)
    WHEN shape = 2 THEN '{{"n":[' || k || ',2]}}' END AS as_text, CASE WHEN shape = 2 THEN k END AS deep, CASE WHEN shape = 3 THEN 'a' END AS element,
  CASE shape WHEN 3 THEN 'array' WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'object' END AS kind FROM ({_EVENT_K})""",
)
def _(t: Tables) -> DataFrame:
    """One path over values of several shapes, beside ``json_path_get`` with its schema."""
    value = F.col("value")
    return _mixed_json(t).select(
        "event_id", json_get(value, "$.k", "bigint").alias("as_number"), json_get(value, "$.k").alias("as_text"),
        json_get(value, "$.k.n[0]", "bigint").alias("deep"), json_get(value, "$[1]").alias("element"), json_kind(value).alias("kind"),
    )


@query(
    "json_variant_fields",
    f"""WITH f AS (SELECT 'k' AS key, CASE shape WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'object' END AS kind FROM ({_EVENT_K}) WHERE shape < 3
  UNION ALL SELECT 'z', 'void' FROM ({_EVENT_K}) WHERE shape = 2
  UNION ALL SELECT NULL, unnest(['bigint', 'string']) FROM ({_EVENT_K}) WHERE shape = 3)
SELECT key, kind, count(*) AS n_values FROM f GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """The fields that the values turn out to have, by kind: what a schema would have to hold."""
    fields = json_fields(_mixed_json(t), "value")
    return fields.groupBy("key", json_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n_values"))


_NEWLINE = "' || chr(10) || '"


def _markdown_sql() -> str:
    """The rule list as nested SQL calls."""
    expr = "html"
    for pattern, to in markup.MARKDOWN_RULES:
        to_sql = to.replace("$2", r"\2").replace("$1", r"\1").replace("\n", _NEWLINE)
        expr = f"regexp_replace({expr}, '{pattern}', '{to_sql}', 'g')"
    for name, char in markup.HEADING_MARKS + markup.ENTITIES:
        quoted = char.replace("'", "''")
        expr = f"replace({expr}, '{name}', '{quoted}')"
    return f"trim({expr}, ' ' || chr(10))"


@query("html_to_markdown", f"SELECT page_id, {_markdown_sql()} AS md FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.html_to_markdown("html").alias("md"))


_PAGE = (
    "<html><head><title>t</title><style>p {{}}</style></head><body><h2>{0}</h2><p>By <b>{1}</b>,\n <i>{2}</i>&#8217;s &amp; &eacute;t&#xE9; &trade;</p>"
    '<ol><li>{0}</li><li>{1}<ul><li>{2}</li></ol_></li></ol><p>See <a href="/{1}">here</a><br>now</p></body></html>'
).replace("</ol_>", "</ul>")
_PAGE_MD = "## {0}\n\nBy **{1}**, *{2}*’s & été ™\n\n1. {0}\n2. {1}\n\t* {2}\n\nSee [here](/{1})  \nnow"


def _filled(template: str, joined: str) -> str:
    """The template as an SQL expression over the columns of ``part``."""
    text = template.replace("{{", "{").replace("}}", "}").replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")
    for i, column in enumerate(("p_name", "p_brand", "p_type")):
        text = text.replace(f"{{{i}}}", f"'||{column}||'")
    return f"'{text}' AS {joined}"


@query("html_to_markdown_written", f"SELECT p_partkey, {_filled(_PAGE_MD, 'md')} FROM part")
def _(t: Tables) -> DataFrame:
    """A hand-written page around the values of each part, against its Markdown as written by hand."""
    pages = dealt(t.part.select("p_partkey", "p_name", "p_brand", "p_type")).selectExpr("p_partkey", _filled(_PAGE, "html"))
    return pages.select("p_partkey", html_to_markdown_nested("html").alias("md"))


@query(
    "normalise_chars",
    """SELECT doc_id, replace(replace(text, 'the', ''''), chr(10), ' ') AS text FROM documents""",
)
def _(t: Tables) -> DataFrame:
    """The marks to replace are put into every text first: the test texts hold none."""
    from gleaner.functions.text import normalise_chars

    marked = F.replace(F.replace("text", F.lit("the"), F.lit("’")), F.lit("\n"), F.lit(" "))
    return t.documents.select("doc_id", normalise_chars(marked).alias("text"))


@query(
    "card_extract",
    r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS card, hrefs[i] AS href, trim(texts[i]) AS label
FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts FROM pages))""",
)
def _(t: Tables) -> DataFrame:
    rows = card_ops.card_rows(t.pages, "html", "<li>", "a", "li")
    return rows.select("page_id", "card", "href", F.get("cells", F.lit(0)).alias("label"))


@query("card_repair", with_cte("SELECT hash, array_to_string(cells, '|') AS cells FROM repaired", REPAIRED))
def _(t: Tables) -> DataFrame:
    return card_ops.repair_cards(cards(t)).select("hash", F.array_join("cells", "|").alias("cells"))


@query(
    "array_to_columns",
    with_cte(
        "SELECT hash, " + ", ".join(rf"regexp_replace(cells[{i + 1}], '\s+', ' ', 'g') AS {n}" for i, n in enumerate(CARD_SLOTS))
        + " FROM repaired",
        REPAIRED,
    ),
)
def _(t: Tables) -> DataFrame:
    return card_ops.cells_to_columns(repaired(t))


@query(
    "page_kind",
    """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  NOT contains(regexp_extract(html, '<title>(.*?)</title>', 1), 'the') AS is_company_page FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", markup.page_title("html").alias("title"), markup.is_company_page("html", "the").alias("is_company_page")
    )


@query(
    "hash_from_url",
    r"""SELECT page_id, string_split(url, '/')[-1] AS hash, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page
FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.key_from_url("url").alias("hash"), markup.query_field("url", "page").alias("page"))


def _listing_pages(t: Tables) -> DataFrame:
    """(hash, html): a listing page per part, of two cards and a footer with links and buttons of its own."""
    lit = F.lit
    key = F.col("p_partkey").cast("string")
    buttons = F.repeat(lit('<div><button>x</button><div>tip</div></div>'), (F.col("p_size") % 4).cast("int"))

    def card(name: str) -> Column:
        return F.concat(
            lit('<div class="x card"><div><span> '), "p_name", lit(' </span><div><span>'), "p_brand", lit('</span></div></div><div><div><a href="/view/'),
            lit(name), key, lit('">v</a><a href="/?company='), "p_brand", lit('&a=1">c</a></div></div><div class="flex justify-center space-x-2">'),
            buttons, lit('</div></div>'),
        )

    footer = lit('<div class="foot"><span>About</span><a href="/about">us</a><div class="flex justify-center space-x-2"><div>a</div></div></div>')
    parts = dealt(t.part.select("p_partkey", "p_name", "p_brand", "p_size"))
    return parts.select(F.col("p_partkey").alias("hash"), F.concat(lit("<body>"), card("a"), card("b"), footer, lit("</body>")).alias("html"))


@query("button_count", "SELECT p_partkey AS hash, i - 1 AS card, CAST(p_size % 4 AS BIGINT) AS n_buttons FROM (SELECT *, unnest([1, 2]) AS i FROM part)")
def _(t: Tables) -> DataFrame:
    rows = card_ops.card_rows(_listing_pages(t))
    return rows.select("hash", "card", F.col("_len").alias("n_buttons"))


@query(
    "card_extract_listing",
    """SELECT p_partkey AS hash, i - 1 AS card, p_name || '|' || p_brand AS cells, '/view/' || ['a', 'b'][i] || p_partkey AS href,
  '/?company=' || p_brand || '&a=1' AS href2 FROM (SELECT *, unnest([1, 2]) AS i FROM part)""",
)
def _(t: Tables) -> DataFrame:
    rows = card_ops.card_rows(_listing_pages(t))
    return rows.select("hash", "card", F.array_join("cells", "|").alias("cells"), "href", "href2")


@query("quality_assert", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    known = F.col("event_type").isin("view", "signup", "purchase", "click", "error")
    return card_ops.check_all(t.events, known, "unknown event type").select("event_id", "event_type")


def _payloads(t: Tables) -> DataFrame:
    """Page payloads in the embedded shape, built from parts."""
    job = F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.col("p_partkey").cast("string").alias("requisition_id"),
        F.struct(F.col("p_name").alias("title"), F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p>")).alias("description")).alias("job_information"),
        F.struct(
            F.lit("2026-01-05T10:00:00Z").alias("estimated_publish_date"),
            F.concat("p_type", F.lit(", California, United States")).alias("formatted_workplace_location"),
            F.col("p_brand").alias("company_name"), F.col("p_retailprice").alias("yearly_min_compensation"),
            F.split("p_name", " ").alias("technical_tools"),
        ).alias("v5_processed_job_data"),
        F.struct(F.when(F.col("p_size") > 25, F.array("p_type")).alias("industries"), F.col("p_size").alias("num_employees")).alias("v5_processed_company_data"),
    ).alias("job")).alias("pageProps")).alias("props")))
    return t.part.select("p_partkey", job.alias("payload"))


@query(
    "row_aligned_assembly",
    """SELECT p_partkey AS _id, '2026-01-05' AS published, p_name AS title, p_type AS loc, p_retailprice AS pay,
  replace(p_name, ' ', ';') AS tools, p_brand AS company_name, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS n_industries,
  CAST(p_size AS BIGINT) AS num_employees, '<p>' || p_name || '</p>' AS description
FROM part""",
)
def _(t: Tables) -> DataFrame:
    """The three tables of the payload, put side by side again for the check."""
    parsed = _payloads(t).select("p_partkey", F.from_json("payload", EMBEDDED)["props"]["pageProps"]["job"].alias("job"))
    made = embedded_tables(parsed, F.col("job"), F.col("p_partkey"), F.lit(None).cast("timestamp"))
    jobs = made["jobs"].select(
        "_id", F.date_format("_est_pub_date", "yyyy-MM-dd").alias("published"), "title", F.col("_loc").alias("loc"),
        F.col("yearly_min_compensation").alias("pay"), F.array_join("technical_tools", ";").alias("tools"), "company_name",
    )
    companies = made["companies"].select("_id", F.size("industries").alias("n_industries"), "num_employees")
    sources = made["sources"].select("_id", "description")
    return jobs.join(companies, "_id").join(sources, "_id")


@query(
    "snapshot_to_postings",
    """WITH c AS (SELECT p_partkey AS hash, p_brand AS company, p_name AS title, p_size,
    p_brand || ' - ' || p_name AS position, p_size * 24 AS hours, 'makes ' || p_type AS summary FROM part)
SELECT CAST(hash AS VARCHAR) AS hash, 'c' || company AS chash, company, title, position, CAST(hours AS BIGINT) AS hours,
  p_size * 1.0::DOUBLE AS lower_k, (p_size + 20) * 1.0::DOUBLE AS upper_k, (p_size + p_size + 20) / 2.0::DOUBLE AS median_k,
  'Oakland' AS bay, CAST(NULL AS DOUBLE) AS yoe
FROM c QUALIFY row_number() OVER (PARTITION BY lower(position) ORDER BY position, hours, summary, CAST(hash AS VARCHAR)) = 1""",
)
def _(t: Tables) -> DataFrame:
    """The whole way from listing pages to deduplicated postings; one page per part, optional slots left out."""
    texts = [
        F.concat("p_size", F.lit("d")), F.col("p_name"), F.lit("Oakland, California, United States"),
        F.concat(F.lit("$"), "p_size", F.lit("k-$"), F.col("p_size") + 20, F.lit("k/yr")), F.lit("Onsite"),
        F.lit("Full Time"), F.concat("p_brand", F.lit(":")), F.concat(F.lit(": makes "), "p_type"),
        F.lit("builds"), F.lit("SQL"), F.lit("Job Posting"), F.lit("1 view"),
    ]
    spans = F.concat(*[x for c in texts for x in (F.lit("<span>"), c, F.lit("</span>"))])
    page = F.concat(
        F.lit('<html><head><title>All (N=1)</title></head><body><div class="card"><div>'), spans,
        F.lit('</div><div><div><a href="/view/'), F.col("p_partkey"), F.lit('">x</a><a href="/?company=c'), F.col("p_brand"),
        F.lit('&s=1">y</a></div></div></div></body></html>'),
    )
    parts = dealt(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    made = card_ops.postings_from_pages(parts.select(page.alias("html")), ["Oakland", "Palo Alto"])
    return made.select(
        "hash", "chash", "company", "title", "position", "hours", F.col("lower").alias("lower_k"),
        F.col("upper").alias("upper_k"), F.col("median").alias("median_k"), F.array_join("bay", ";").alias("bay"), "yoe",
    )
