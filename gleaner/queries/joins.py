"""Joins, membership and set algebra on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import masks
from gleaner.functions.text import dictionary_hits
from gleaner.operators import joins as ops
from gleaner.operators import overlap
from gleaner.operators.dictionary import long_dictionary_hits
from gleaner.queries import Tables, query
from gleaner.queries.standins import KEY_SETS, LABELLED, key_sets, labelled, with_cte


@query(
    "inner_join_renamed_keys",
    """SELECT o_orderkey, o_custkey, c_custkey, o_orderstatus AS name_x, c_mktsegment AS name_y
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("name"))
    right = t.customer.select("c_custkey", F.col("c_mktsegment").alias("name"))
    return ops.inner_join(left, right, [("o_custkey", "c_custkey")])


@query("left_join_enrich", with_cte("SELECT doc_id, lang, quality, toxic FROM labelled", LABELLED))
def _(t: Tables) -> DataFrame:
    return ops.left_enrich(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "multi_key_join_nullsafe",
    """WITH a AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status, year(o_orderdate) AS y, count(*) AS n
    FROM orders GROUP BY ALL),
b AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status, year(o_orderdate) AS y, max(o_orderkey) AS top
    FROM orders GROUP BY ALL)
SELECT a.priority, a.status, CAST(a.y AS INTEGER) AS y, a.n, b.top FROM a JOIN b
  ON a.priority IS NOT DISTINCT FROM b.priority AND a.status IS NOT DISTINCT FROM b.status AND a.y IS NOT DISTINCT FROM b.y""",
)
def _(t: Tables) -> DataFrame:
    keyed = t.orders.select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("y"), "o_orderkey",
    )
    keys = ["priority", "status", "y"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    tops = keyed.groupBy(*keys).agg(F.max("o_orderkey").alias("top"))
    return ops.null_safe_join(counts, tops, keys)


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    return ops.keep_known(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey")


@query("membership_flags", with_cte("SELECT o_custkey, f AS F, o AS O, p AS P FROM flags", KEY_SETS))
def _(t: Tables) -> DataFrame:
    return ops.membership_flags(key_sets(t), "o_custkey")


@query(
    "anti_join_new_keys",
    "SELECT key FROM (SELECT c_custkey + 7 AS key FROM customer) WHERE key NOT IN (SELECT o_custkey FROM orders)",
)
def _(t: Tables) -> DataFrame:
    # keys moved up by seven, so the last ones are new to the stored side
    probe = t.customer.select((F.col("c_custkey") + 7).alias("key"))
    return ops.keep_unknown(probe, t.orders, "key", "o_custkey")


@query(
    "lookup_map",
    "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey + 4 = n_nationkey",
)
def _(t: Tables) -> DataFrame:
    # keys moved up by four, so some suppliers' nation is missing
    probe = t.supplier.withColumn("key", F.col("s_nationkey") + 4)
    return ops.lookup(probe, t.nation, "key", "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query(
    "mismatch_report",
    with_cte("SELECT doc_id, quality, toxic FROM labelled WHERE quality IS NULL OR toxic IS NULL OR quality <> toxic", LABELLED),
)
def _(t: Tables) -> DataFrame:
    return ops.mismatches(labelled(t), "quality", "toxic").select("doc_id", "quality", "toxic")


WORDS = ["the end", "the", "their", "und", "la", "that"]


@query(
    "city_dictionary_match",
    "SELECT doc_id, array_to_string(regexp_extract_all(text, 'the end|the|their|und|la|that'), '|') AS hits FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.coalesce(dictionary_hits("text", WORDS), F.array()), "|").alias("hits"))


_PAIRS = r"""pairs AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT string_split(text, ' ') AS ws FROM benchmark), unnest(range(1, len(ws))) AS u(i)
    UNION SELECT DISTINCT ws[i] FROM (SELECT string_split(text, ' ') AS ws FROM benchmark), unnest(range(1, len(ws))) AS u(i) WHERE length(ws[i]) > 6)"""


@query(
    "long_dictionary_match",
    with_cte(
        """SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, (SELECT string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) FROM pairs)), lambda x: x <> ''), '|') AS hits
FROM documents""",
        _PAIRS,
    ),
)
def _(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    longer = F.filter(F.slice(words, 1, F.size(words) - 1), lambda w: F.length(w) > 6)
    terms = t.benchmark.select(F.explode(F.concat(F.filter(pairs, lambda p: p.isNotNull()), longer)).alias("term")).distinct()
    # long terms first, so that a pair stands ahead of its first word
    places = terms.withColumn("rank", -F.length("term"))
    found = long_dictionary_hits(t.documents.select("doc_id", "text"), "doc_id", "text", places)
    return found.select("doc_id", F.coalesce(F.array_join("hits", "|"), F.lit("")).alias("hits"))


@query("align_fill", with_cte("SELECT doc_id, coalesce(quality, -1) AS quality FROM labelled", LABELLED))
def _(t: Tables) -> DataFrame:
    return ops.align_fill(t.documents.select("doc_id"), t.labels, "doc_id", "quality", -1)


@query(
    "union_snapshots",
    """SELECT event_id, user_id, NULL AS value FROM events WHERE ts < TIMESTAMP '2024-01-15'
UNION ALL SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def _(t: Tables) -> DataFrame:
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    early = t.events.filter(F.col("ts") < middle).select("event_id", "user_id")
    late = t.events.filter(F.col("ts") >= middle).select("event_id", "user_id", "value")
    return overlap.union_snapshots([early, late])


@query("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select(F.col("s_nationkey").alias("nationkey"))]
    return overlap.union_snapshots(parts, distinct=True)


@query("intersect_keys", with_cte("SELECT o_custkey FROM flags WHERE f AND o", KEY_SETS))
def _(t: Tables) -> DataFrame:
    sets = key_sets(t)
    return overlap.intersect_keys(sets["F"], sets["O"], "o_custkey")


@query("union_keys", with_cte("SELECT o_custkey FROM flags WHERE f OR p", KEY_SETS))
def _(t: Tables) -> DataFrame:
    sets = key_sets(t)
    return overlap.union_keys(sets["F"], sets["P"], "o_custkey")


@query("except_keys", with_cte("SELECT o_custkey FROM flags WHERE o AND NOT p", KEY_SETS))
def _(t: Tables) -> DataFrame:
    sets = key_sets(t)
    return overlap.except_keys(sets["O"], sets["P"], "o_custkey")


@query("keys_of_mask", r"SELECT DISTINCT source FROM documents WHERE regexp_matches(lower(text), '(^|[^\pL\pN_])zu')")
def _(t: Tables) -> DataFrame:
    return overlap.keys_of_mask(t.documents, masks.regex_mask("zu", "text"), "source")


@query(
    "set_overlap",
    with_cte(
        " UNION ALL ".join(
            "SELECT {} AS F, {} AS O, {} AS P, count(*) AS size, round(100.0 * count(*) / (SELECT count(*) FROM flags), 1)::DOUBLE AS percent"
            " FROM flags WHERE {}".format(
                *["'Yes'" if c in combo else "'-'" for c in "FOP"], " AND ".join(c.lower() for c in combo) or "TRUE"
            )
            for combo in ("", "F", "O", "P", "FO", "FP", "OP", "FOP")
        ),
        KEY_SETS,
    ),
)
def _(t: Tables) -> DataFrame:
    return overlap.set_overlap(key_sets(t), "o_custkey")


@query(
    "set_overlap_exclusive",
    with_cte("SELECT f AS F, o AS O, p AS P, count(*) AS size FROM flags GROUP BY 1, 2, 3", KEY_SETS),
)
def _(t: Tables) -> DataFrame:
    return overlap.exclusive_regions(key_sets(t), "o_custkey")
