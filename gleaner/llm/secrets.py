"""Secret scan: base patterns per text, and how widely each candidate is owned across the corpus.

Candidates of the base kinds are assignments, access keys and hex strings. The further kind ``key`` is any
run of 20 or more of ``[A-Za-z0-9_-]`` with a digit, an upper-case and a lower-case letter that no base span
touches. Every candidate's value is hashed, and hashes are aggregated over the corpus by distinct owners and distinct
repositories. A repository is a text: copies of one text are one, however many rows hold it. A value held by more than
``FEW_OWNERS`` owners is taken for a copied example; one with few owners looks live, whatever the number of its repositories. Base
spans always stay; a span of the further kind is kept only where its value looks live.

All of it is DataFrame functions. The texts are read once: their spans are written, with hashes in place of values, and all else
works on these. Copies of a text become one before anything is joined, and distinct (hash, owner) and (hash, repository) pairs
are formed before counting, so a value in a third of all texts is pre-aggregated where it is read. Work per text is in
proportion to its length and the number of its spans.

Null and empty texts have no spans; texts of any length are read whole; repeated rows come out once each; a null
owner counts as one more holder. Other columns are not used, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.values import bound, sums_before
from gleaner.llm.common import fresh_name, written

# fixed values: patterns of the contract. A failing match must use up its text, so the length is tested afterwards
# where a shorter match could hide a longer one (assign); hex and access runs are maximal, so the length can be inside
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"[A-Za-z0-9_-]{20,}"
LEAST_VALUE = 12
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY}
ORDER = list(KINDS)
FEW_OWNERS = 2


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """All matches of a kind, left to right: (start, kind number, kind, end, hash of the value), in code points.

    The text between matches comes from splitting at the same pattern, so starts are running sums of lengths.
    """
    pattern = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    hits = F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("gap"), sizes(found).alias("size"), values.alias("value"))

    def placed(hits: Column) -> Column:
        # the last gap has no match after it
        steps = F.transform(hits, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0)))

        def span(x: Column, ahead: Column) -> Column:
            start = ahead + x["gap"]
            return F.struct(
                start.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"),
            )

        return bound(sums_before(steps), lambda ahead: F.transform(hits, lambda x, i: span(x, F.get(ahead, i))))

    spans = F.filter(bound(hits, placed), lambda s: s["end"].isNotNull())
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= LEAST_VALUE)
    if kind == "key":
        spans = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    hashed = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")).cast(_SPANS[6:-1]))
    return F.when(text.rlike(pattern), hashed).otherwise(F.array().cast(_SPANS))


def text_key(text: Column) -> Column:
    """A text's digest; copies of one text share it."""
    return F.unhex(F.sha2(text, 256))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str) -> DataFrame:
    """Per row, written: id, owner, digest of the text if it has any span, and its spans with the hash of each value."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{owner}`").cast("string").alias("owner"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    found = rows.withColumn("spans", F.concat(*[spans_of(F.col("text"), k) for k in ORDER]))
    return written(found.select("doc_id", "owner", F.when(F.size("spans") > 0, text_key(F.col("text"))).alias("key"), "spans"), "secrets-spans")


def distinct_spans(found: DataFrame) -> DataFrame:
    """(key, start, rank, kind, end, hash) of each text once, without further spans that a base span touches."""
    base = F.col("rank") < ORDER.index("key")
    onward = Window.partitionBy("key").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("key", F.inline("spans")).distinct()
    spans = spans.withColumn("ended", F.max(F.when(base, F.col("end"))).over(onward)).withColumn("begins", F.min(F.when(base, F.col("start"))).over(back))
    touched = (F.coalesce("ended", F.lit(-1)) > F.col("start")) | (F.coalesce("begins", F.col("end")) < F.col("end"))
    return spans.filter(base | ~touched).drop("ended", "begins")


def ownership(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) over all candidates of the corpus."""
    hashes = spans.select("key", "hash").distinct()
    holders = found.filter("key IS NOT NULL").select("key", "owner").distinct().join(hashes, "key")
    holder = F.explode(F.array(
        F.struct(F.lit("owners").alias("what"), F.col("owner").cast("binary").alias("holder")), F.struct(F.lit("repos").alias("what"), F.col("key").alias("holder"))
    )).alias("h")
    both = holders.select("hash", holder).select("hash", "h.what", "h.holder").distinct()
    return both.groupBy("hash").agg(
        F.count_if(F.col("what") == "owners").alias("n_owners"), F.count_if(F.col("what") == "repos").alias("n_repos")
    )


def judged_spans(found: DataFrame) -> DataFrame:
    """The spans of each text that stay, each with the verdict on its value."""
    spans = written(distinct_spans(found), "secrets-distinct")
    verdicts = ownership(found, spans).select("hash", (F.col("n_owners") <= FEW_OWNERS).alias("live"))
    return spans.join(verdicts, "hash").filter((F.col("rank") < ORDER.index("key")) | F.col("live"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per row: base spans, kept further spans, and how many distinct base values look live or copied."""
    found = candidates(docs, doc_id, text, owner)
    fields = ("start", "rank", "kind", "end", "hash", "live")
    texts = judged_spans(found).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    # rows without any span meet nothing: they would all share one key
    with_any = found.filter("key IS NOT NULL").select("doc_id", "key").join(texts, "key", "left").select("doc_id", "all")
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:string,live:boolean>>"
    none = found.filter("key IS NULL").select("doc_id", F.lit(None).cast(kind).alias("all"))
    every = F.coalesce("all", F.array().cast(kind))
    base = F.filter(every, lambda s: s["rank"] < ORDER.index("key"))
    values = lambda live: F.size(F.array_distinct(F.transform(F.filter(base, lambda s: s["live"] == live), lambda s: s["hash"]))).cast("long")
    return with_any.unionByName(none).select(
        "doc_id", base.alias("base"), F.filter(every, lambda s: s["rank"] == ORDER.index("key")).alias("added"),
        values(True).alias("n_live"), values(False).alias("n_copied"),
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied",
    )


#: code points of a piece in which a place of a text is looked up
PIECE = 4096


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to before ``end`` of a text cut into pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    held = lambda at: F.coalesce(F.get(pieces, at), F.lit(""))
    cut = lambda at, begin, size: F.substring(held(at), (begin + 1).cast("int"), size.cast("int"))
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over = F.concat(cut(first, start - first * PIECE, F.lit(PIECE)), middle, cut(last, F.lit(0), end - last * PIECE))
    return F.when(first == last, cut(first, start - first * PIECE, end - start)).otherwise(over)


def redacted(text: Column, spans: Column) -> Column:
    """A text with ``<secret>`` in place of each of ``spans``, which are disjoint and in order."""
    whole = F.lit(1 << 31)  # beyond any text

    def cut(pieces: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(whole.cast("long")))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: _part(pieces, a, F.least(b, F.size(pieces).cast("long") * PIECE))), "<secret>")

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``docs`` with every base and kept further span replaced by ``<secret>``; overlapping spans become one.

    The spans of a text come back to its rows by its digest.
    """
    onward = Window.partitionBy("key").orderBy("start", "rank")
    before = F.max("end").over(onward.rowsBetween(Window.unboundedPreceding, -1))
    spans = judged_spans(candidates(docs, doc_id, text, owner)).withColumn("apart", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("apart").over(onward.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    key, cuts = fresh_name(docs, "text_key"), fresh_name(docs, "text_cuts")
    texts = islands.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    joined = docs.withColumn(key, F.when(F.length(f"`{text}`") > 0, text_key(F.col(f"`{text}`")))).join(texts, key, "left")
    cleaned = F.when(F.col(cuts).isNotNull(), redacted(F.col(f"`{text}`"), F.col(cuts))).otherwise(F.col(f"`{text}`"))
    return joined.select(*[cleaned.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for ``secret_digests``."""
    def spans(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  SELECT doc_id, source, start, {rank} AS rank, '{kind}' AS kind, start + length(hit) AS "end", value FROM (
    SELECT doc_id, source, hits[i] AS hit, vals[i] AS value,
      list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start
    FROM (SELECT doc_id, source, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, source, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals,
        string_split_regex(text, '{quoted}') AS gaps
      FROM documents WHERE regexp_matches(text, '{quoted}')))
  ) WHERE {keep}"""

    return f"""
WITH base AS ({" UNION ALL ".join([
        spans("assign", 0, ASSIGN, 2, f"length(value) >= {LEAST_VALUE}"), spans("access", 1, "AKIA[A-Z0-9]+", 0, "length(hit) >= 18"),
        spans("hex", 2, "[0-9a-f]+", 0, "length(hit) >= 16")])}
), extra AS (
  SELECT * FROM ({spans("key", 3, KEY, 0, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')")}) AS k
  WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = k.doc_id AND b.start < k."end" AND k.start < b."end")
), holders AS (
  SELECT value, count(DISTINCT coalesce(source, '?')) AS n_owners
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY value
), kept AS (
  SELECT * FROM base UNION ALL SELECT e.* FROM extra AS e JOIN holders USING (value) WHERE n_owners <= {FEW_OWNERS}
), live AS (
  SELECT doc_id, count(DISTINCT value) FILTER (WHERE n_owners <= {FEW_OWNERS}) AS n_live, count(DISTINCT value) AS n
  FROM base JOIN holders USING (value) GROUP BY doc_id
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base_text,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
  coalesce(n - n_live, 0)::BIGINT AS n_copied
FROM documents AS d LEFT JOIN per_doc USING (doc_id) LEFT JOIN live USING (doc_id)"""
