"""Projections and predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import masks
from gleaner.operators import filters as ops
from gleaner.operators import search_index
from gleaner.operators.joins import keep_known
from gleaner.queries import Tables, query
from gleaner.queries.standins import JOBS, LABELLED, ORDER_BRANDS, POSTINGS, jobs, labelled, order_brands, postings, with_cte
from gleaner.sources.searches import catalog, matching_searches, search_url


@query("project_cols", "SELECT doc_id, lang, source FROM documents")
def _(t: Tables) -> DataFrame:
    return ops.project(t.documents, ["doc_id", "lang", "source"])


@query("drop_cols", "SELECT * EXCLUDE (o_orderpriority, o_totalprice) REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders")
def _(t: Tables) -> DataFrame:
    df = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return df.drop("o_orderpriority", "o_totalprice")


@query("rename_cols", "SELECT c_custkey AS hash_, c_name AS title_, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.withColumnsRenamed({"c_custkey": "hash_", "c_name": "title_"})


@query("drop_all_null_rows", with_cte("SELECT quality, toxic FROM labelled WHERE quality IS NOT NULL OR toxic IS NOT NULL", LABELLED))
def _(t: Tables) -> DataFrame:
    return labelled(t).select("quality", "toxic").na.drop(how="all")


@query("drop_null_subset", with_cte("SELECT doc_id, quality FROM labelled WHERE quality IS NOT NULL", LABELLED))
def _(t: Tables) -> DataFrame:
    return labelled(t).na.drop(subset=["quality"]).select("doc_id", "quality")


@query("date_floor_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(t: Tables) -> DataFrame:
    return ops.since(t.orders, "o_orderdate", "1998-01-01").select("o_orderkey", "o_custkey")


@query(
    "date_floor_flags",
    """SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-01-01' AS jan, o_orderdate >= TIMESTAMP '1998-02-01' AS feb FROM orders""",
)
def _(t: Tables) -> DataFrame:
    return ops.since_flags(t.orders, "o_orderdate", {"jan": "1998-01-01", "feb": "1998-02-01"}).select("o_orderkey", "jan", "feb")


@query("equality_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 12 ORDER BY doc_id LIMIT 1")
def _(t: Tables) -> DataFrame:
    return ops.find_one(t.documents, "doc_id", 12, "doc_id").select("doc_id", "text")


@query(
    "in_list_filter",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderstatus IN ('F', 'O')""",
)
def _(t: Tables) -> DataFrame:
    listed = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    return keep_known(t.orders.filter(F.col("o_orderstatus").isin("F", "O")), listed, "o_custkey", "c_custkey").select("o_orderkey")


@query("flag_filter", "SELECT doc_id FROM labels WHERE toxic = 1")
def _(t: Tables) -> DataFrame:
    return t.labels.withColumn("flag", F.col("toxic") == 1).filter("flag").select("doc_id")


@query(
    "null_default_compare",
    with_cte("SELECT doc_id, coalesce(quality, 0) < 1 AS low FROM labelled WHERE coalesce(toxic, 0) <= 0", LABELLED),
)
def _(t: Tables) -> DataFrame:
    df = labelled(t).filter(ops.default_zero("toxic") <= 0)
    return df.select("doc_id", (ops.default_zero("quality") < 1).alias("low"))


@query(
    "mask_algebra",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE ((l_quantity > 40 OR l_returnflag = 'R') AND NOT (l_linestatus = 'O')) AND l_discount <= 0.05""",
)
def _(t: Tables) -> DataFrame:
    two = masks.two_valued
    mask = (two(F.col("l_quantity") > 40) | two(F.col("l_returnflag") == "R")) & ~two(F.col("l_linestatus") == "O")
    return t.lineitem.filter(mask & (F.col("l_discount") <= 0.05)).select("l_orderkey", "l_linenumber", "l_extendedprice")


def line_arrays(t: Tables) -> DataFrame:
    """Two parallel lists per line, made within the row."""
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), "l_partkey", F.array(quantity, quantity + 5).alias("lat"), F.array(price, price / 2).alias("lon")
    )


@query(
    "geo_box_any",
    """SELECT l_orderkey AS id, l_partkey, (l_quantity BETWEEN 10 AND 12 AND l_extendedprice BETWEEN 20000 AND 30000)
  OR (l_quantity + 5 BETWEEN 10 AND 12 AND l_extendedprice / 2 BETWEEN 20000 AND 30000) AS inside FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    return line_arrays(t).select("id", "l_partkey", masks.in_box("lat", "lon", (10, 12, 20000, 30000)).alias("inside"))


@query(
    "location_text_or_box",
    """SELECT c_custkey, regexp_matches(n_name, 'nation_1$|NATION_7', 'i') OR (c_nationkey BETWEEN 10 AND 12 AND c_acctbal BETWEEN 1000 AND 3000)
  OR (c_nationkey + 3 BETWEEN 10 AND 12 AND c_acctbal * 2 BETWEEN 1000 AND 3000) AS norcal
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: Tables) -> DataFrame:
    nation, balance = F.col("c_nationkey").cast("double"), F.col("c_acctbal")
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name", F.array(nation, nation + 3).alias("lat"), F.array(balance, balance * 2).alias("lon")
    )
    flag = masks.home_region("lat", "lon", "n_name", (10, 12, 1000, 3000), "nation_1$|NATION_7")
    return placed.select("c_custkey", flag.alias("norcal"))


@query(
    "title_class",
    "SELECT p_partkey, regexp_matches(p_name, '(?:red|hot).+(?:bolt|gear)', 'i') AND NOT regexp_matches(p_name, 'hot.+gear', 'i') AS fits FROM part",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", masks.title_class("p_name", "(?:RED|hot).+(?:bolt|gear)", "hot.+gear").alias("fits"))


@query(
    "topic_flags",
    """SELECT p_partkey, regexp_matches(p_name, '\\bred\\b', 'i') AS red, regexp_matches(p_name, '\\bhot\\b|small.+ring', 'i') AS hot,
  regexp_matches(p_name, 'bolt$', 'i') AS bolt FROM part""".replace("\\\\", "\\"),
)
def _(t: Tables) -> DataFrame:
    flags = masks.topic_flags("p_name", {"red": r"\bRed\b", "hot": r"\bhot\b|small.+ring", "bolt": "bolt$"})
    return t.part.select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query(
    "has_any_element",
    with_cte("SELECT id, list_has_any(brands, ['Brand#1', 'Brand#7', 'Brand#13']) AS hit FROM order_brands", ORDER_BRANDS),
)
def _(t: Tables) -> DataFrame:
    return order_brands(t).select("id", masks.overlaps("brands", ["Brand#1", "Brand#7", "Brand#13"]).alias("hit"))


@query(
    "composite_profile",
    with_cte(
        """SELECT doc_id FROM jobs JOIN labelled USING (doc_id) WHERE regexp_matches(title, '(?:the|die).+', 'i')
  AND NOT regexp_matches(title, 'that', 'i') AND (list_has_any(technical_tools, ['src1', 'src2', 'en']) OR jobs.workplace_type = 'Remote')
  AND coalesce(quality, 0) < 7 AND coalesce(toxic, 0) <= 0 AND list_has_any(technical_tools, ['en', 'fr'])""",
        JOBS,
    ),
)
def _(t: Tables) -> DataFrame:
    made = jobs(t).withColumn("quality", F.when(F.col("seniority_level") == "Senior", 1).when(F.col("seniority_level") == "Junior", 0))
    toxic = F.when(F.col("company_tagline").isNull(), 1)
    profile = ops.profile(
        masks.title_class("title", "(?:the|die).+", "that"),
        masks.overlaps("technical_tools", ["src1", "src2", "en"]) | (F.col("workplace_type") == "Remote"),
        F.col("quality"), toxic, max_years=7, max_days=0, industries=masks.overlaps("technical_tools", ["en", "fr"]),
    )
    return made.filter(profile).select("doc_id")


# Two saved searches of the usual shape.
SEARCHES = {
    "junior": {
        "roleYoeRange": [0, 20], "commitmentTypes": ["Full+Time", "Contract"], "dateFetchedPastNDays": 400,
        "restrictJobsToTransparentSalaries": True,
        "locations": [{"workplace_types": ["Remote", "Hybrid"], "options": {}}, {"workplace_types": ["Onsite"], "options": {}}],
    },
    "metal": {"industries": ["STANDARD", "PROMO"], "roleYoeRange": [10, 50], "locations": [{"workplace_types": ["Remote"]}]},
}


@query(
    "saved_search_filter",
    with_cte(
        """SELECT hash, 'junior' AS search FROM base WHERE coalesce(yoe, 0) BETWEEN 0 AND 20 AND commitment IN ('Full Time', 'Contract')
  AND published >= TIMESTAMP '1999-01-01' - INTERVAL 400 DAY AND lower_k IS NOT NULL AND workplace IN ('Remote', 'Hybrid', 'Onsite')
UNION ALL SELECT hash, 'metal' FROM base WHERE industry IN ('STANDARD', 'PROMO') AND coalesce(yoe, 0) BETWEEN 10 AND 50 AND workplace = 'Remote'""",
        POSTINGS,
        """base AS (SELECT hash, CASE WHEN yoe_text = '-' THEN NULL ELSE p_size END AS yoe, CASE WHEN salary = '-' THEN NULL ELSE p_size END AS lower_k,
  company_summary AS industry, CASE WHEN p_size < 20 THEN 'Remote' ELSE 'Onsite' END AS workplace,
  CASE WHEN p_size % 3 = 0 THEN 'Full Time' WHEN p_size % 3 = 1 THEN 'Contract' ELSE 'Part Time' END AS commitment,
  TIMESTAMP '1997-06-01' + INTERVAL (p_size * 20) DAY AS published FROM postings)""",
    ),
)
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    base = postings(t).select(
        "hash", F.when(F.col("yoe_text") != "-", size).alias("yoe"), F.when(F.col("salary") != "-", size).alias("lower"),
        F.array("company_summary").alias("industries"), F.when(size < 20, "Remote").otherwise("Onsite").alias("workplace"),
        F.when(size % 3 == 0, "Full Time").when(size % 3 == 1, "Contract").otherwise("Part Time").alias("commitment"),
        F.date_add(F.lit(date(1997, 6, 1)), size * 20).cast("timestamp_ntz").alias("published"),
    )
    columns = {c: c for c in ("yoe", "lower", "industries", "workplace", "commitment", "published")}
    return matching_searches(base, SEARCHES, date(1999, 1, 1), columns).select("hash", "search")


def _placed(t: Tables) -> DataFrame:
    """Posting facts with a point and an address, from parts."""
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("hash"), F.when(size % 7 != 0, size).alias("yoe"), F.array("p_type").alias("industries"), F.col("p_name").alias("title"),
        F.when(size < 20, "Remote").otherwise("Onsite").alias("workplace"), (F.lit(36.5) + size / 20.0).alias("lat"),
        (F.lit(-123.5) + (F.col("p_partkey") % 60) / 20.0).alias("lon"), F.concat("p_brand", F.lit(", California, United States")).alias("address"),
        F.when(size % 3 == 0, "Full Time").when(size % 3 == 1, "Contract").otherwise("Part Time").alias("commitment"),
        F.date_add(F.lit(date(1997, 6, 1)), size * 20).cast("timestamp_ntz").alias("published"),
    )


def _many_searches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A saved search per customer, as a URL, and the word groups of the title queries: two words of a part's name."""
    n, key = F.col("c_nationkey"), F.col("c_custkey")
    names = t.part.select(F.col("p_partkey").alias("part"), "p_name")
    query = F.when(key % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("+AND+")))
    state = F.struct(F.lit("United+States").alias("long_name"))
    point = F.struct(F.struct((F.lit(36.5) + n / 10).alias("lat"), F.lit(-122.4).alias("lon")).alias("location"))

    def place(types: str, around: bool) -> Column:
        names = F.array(F.struct(F.concat(F.lit("brand#"), n).alias("long_name")), state)
        return F.struct(
            F.array(F.lit(types)).alias("workplace_types"), F.when(F.lit(around), point).alias("geometry"),
            F.struct(F.when(F.lit(around), n + 5).alias("radius")).alias("options"), F.when(F.lit(not around), names).alias("address_components"),
        )

    places = F.when(key % 3 == 0, F.array(place("Onsite", True), place("Remote", False))).when(key % 3 == 1, F.array(place("Remote", False)))
    search = F.struct(
        query.alias("jobTitleQuery"), F.array(n % 10, n % 10 + 4).alias("roleYoeRange"),
        F.when(key % 5 == 0, F.array(F.lit("Full+Time"), F.lit("Contract"))).alias("commitmentTypes"),
        F.when(key % 5 == 1, F.array(F.lit("PROMO"), F.lit("STANDARD"))).alias("industries"),
        F.when(key % 7 == 0, 900).alias("dateFetchedPastNDays"), places.alias("locations"),
    )
    made = t.customer.join(names.hint("merge"), F.col("c_custkey") == F.col("part"), "left").select(
        key.cast("string").alias("name"), search_url(F.to_json(search), "https://jobs.example/?searchState=").alias("url")
    )
    words = F.transform(F.split("p_name", " "), lambda w: F.array(w))
    groups = names.select(F.replace("p_name", F.lit(" "), F.lit("+AND+")).alias("query"), words.alias("any_of"), F.array(F.lit("hex")).alias("none_of"))
    return catalog(made), groups.distinct()


@query(
    "saved_search_index",
    with_cte(
        """SELECT hash, c_custkey::VARCHAR AS search FROM base JOIN searches ON coalesce(yoe, 0) BETWEEN n % 10 AND n % 10 + 4
  AND (c_custkey % 2 <> 0 OR p_name IS NULL OR (list_has_all(string_split(title, ' '), string_split(p_name, ' ')) AND NOT list_contains(string_split(title, ' '), 'hex')))
  AND (c_custkey % 5 <> 0 OR commitment IN ('Full Time', 'Contract')) AND (c_custkey % 5 <> 1 OR industry IN ('PROMO', 'STANDARD'))
  AND (c_custkey % 7 <> 0 OR published >= TIMESTAMP '1999-01-01' - INTERVAL 900 DAY)
  AND (c_custkey % 3 = 2 OR (workplace = 'Remote' AND address = 'Brand#' || n || ', California, United States')
    OR (c_custkey % 3 = 0 AND workplace = 'Onsite' AND 2 * 3958.7613 * asin(sqrt(pow(sin(radians(lat - (36.5::DOUBLE + n / 10.0::DOUBLE)) / 2), 2)
      + cos(radians(36.5::DOUBLE + n / 10.0::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon + 122.4::DOUBLE) / 2), 2))) <= n + 5))""",
        """base AS (SELECT p_partkey AS hash, CASE WHEN p_size % 7 <> 0 THEN p_size END AS yoe, p_type AS industry, p_name AS title,
  CASE WHEN p_size < 20 THEN 'Remote' ELSE 'Onsite' END AS workplace, 36.5::DOUBLE + p_size / 20.0::DOUBLE AS lat,
  -123.5::DOUBLE + (p_partkey % 60) / 20.0::DOUBLE AS lon, p_brand || ', California, United States' AS address,
  CASE WHEN p_size % 3 = 0 THEN 'Full Time' WHEN p_size % 3 = 1 THEN 'Contract' ELSE 'Part Time' END AS commitment,
  TIMESTAMP '1997-06-01' + INTERVAL (p_size * 20) DAY AS published FROM part)""",
        "searches AS (SELECT c_custkey, c_nationkey AS n, p_name FROM customer LEFT JOIN part ON c_custkey = p_partkey)",
    ),
)
def _(t: Tables) -> DataFrame:
    searches, groups = _many_searches(t)
    columns = {c: c for c in ("yoe", "industries", "title", "workplace", "lat", "lon", "address", "commitment", "published")}
    found = search_index.matching(_placed(t), "hash", columns, search_index.compiled(searches, groups), date(1999, 1, 1))
    return found.select(F.col("key").alias("hash"), F.col("name").alias("search"))


@query(
    "term_group_filter",
    r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\pL\pN_])(the|die|la)($|[^\pL\pN_])', 'i')
  AND regexp_matches(text, '(^|[^\pL\pN_])(and|und|et)($|[^\pL\pN_])', 'i')
  AND NOT regexp_matches(text, '(^|[^\pL\pN_])(of the|le)($|[^\pL\pN_])', 'i')""",
)
def _(t: Tables) -> DataFrame:
    mask = masks.term_groups("text", [["the", "die", "la"], ["and", "und", "et"]], ["of the", "le"])
    return t.documents.filter(mask).select("doc_id")


@query(
    "geo_radius_filter",
    """WITH g AS (SELECT p_partkey, 36.5::DOUBLE + p_size / 20.0::DOUBLE AS lat, -123.5::DOUBLE + (p_partkey % 60) / 20.0::DOUBLE AS lon FROM part)
SELECT p_partkey FROM g WHERE 2 * 3958.7613 * asin(sqrt(pow(sin(radians(lat - 37.77493) / 2), 2)
  + cos(radians(37.77493)) * cos(radians(lat)) * pow(sin(radians(lon + 122.41942) / 2), 2))) <= 50""",
)
def _(t: Tables) -> DataFrame:
    points = t.part.select(
        "p_partkey", (F.lit(36.5) + F.col("p_size") / 20.0).alias("lat"), (F.lit(-123.5) + (F.col("p_partkey") % 60) / 20.0).alias("lon")
    )
    return points.filter(masks.within_miles("lat", "lon", (37.77493, -122.41942), 50)).select("p_partkey")


@query("company_or_status_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _(t: Tables) -> DataFrame:
    return t.customer.filter((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).select("c_custkey")


@query(
    "is_member",
    r"""SELECT bool_or(list_contains(regexp_extract_all(text, '[A-Za-z]+'), 'there')) AS there,
  bool_or(list_contains(regexp_extract_all(text, '[A-Za-z]+'), 'Quartz')) AS quartz FROM documents""",
)
def _(t: Tables) -> DataFrame:
    words = t.documents.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("words"))
    return ops.is_member(words, "words", {"there": "there", "quartz": "Quartz"})


@query(
    "record_profile",
    with_cte(
        """SELECT doc_id, field, value FROM (
  SELECT doc_id, 'lang' AS field, lang AS value FROM labelled UNION ALL SELECT doc_id, 'source', source FROM labelled
  UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labelled UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labelled)
WHERE value IS NOT NULL""",
        LABELLED,
    ),
)
def _(t: Tables) -> DataFrame:
    return ops.record_profile(labelled(t).select("doc_id", "lang", "source", "quality", "toxic"), "doc_id")
