"""Search text, highlighting, keyword candidates and ranked retrieval."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import masks
from gleaner.functions.values import as_text
from gleaner.operators.aggregates import value_counts

SPAN = '<span style="color: rebeccapurple">'
# The usual short English stop-word list of search libraries.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this",
    "to", "was", "will", "with",
]
K1, B = 1.5, 0.75


def search_text(df: DataFrame) -> Column:
    """One searchable text per posting.

    A missing company or tagline is filled in; a null in any other part makes the whole text null.
    """
    lit = F.lit
    return F.concat(
        F.coalesce("company_name", lit("")), lit(" - "), F.col("title"), lit("."), F.col("_hash"), lit("\n\n"),
        F.col("requirements_summary"), lit("\n\n"),
        as_text(df, "technical_tools"), lit("\n"),
        as_text(df, "role_activities"), lit("\n\n"),
        F.col("seniority_level"), lit("; "),
        F.coalesce("company_tagline", lit("...")), lit("\n\n---\n\n"),
        F.col("_md"),
    )


def text_mask(df: DataFrame, phrase: str, regex: bool = False) -> Column:
    return masks.regex_mask(phrase, search_text(df), regex)


def highlight_terms(text: Column | str, terms: Column, extra: list[str] = ["AI"], open_tag: str = SPAN) -> Column:
    """Wrap every whole-word occurrence of the row's own literal terms, and of ``extra``."""
    all_terms = F.concat(terms, F.array(*[F.lit(t) for t in extra]))

    def wrap(acc: Column, term: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace(term, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
        quoted = F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(acc, pattern, F.concat(F.lit(open_tag), quoted, F.lit("</span>")))

    return F.aggregate(all_terms, F.col(text) if isinstance(text, str) else text, wrap)


def highlight_patterns(text: Column | str, patterns: list[str], open_tag: str = SPAN) -> Column:
    """As above for pattern terms; what matched is kept."""
    start = F.col(text) if isinstance(text, str) else text
    return reduce(
        lambda acc, p: F.regexp_replace(acc, rf"(?U)\b({p})\b", f"{open_tag}$1</span>"), patterns, start
    )


# possessive, so that a long run of capitalised words needs no stack
CANDIDATE = r"[a-z]++ ((?:[A-Z][-A-Za-z0-9]*+ ?+)++)"
#: what stands ahead of the lower-case word: a border, or a character of its own that no other phrase has taken
BORDER, OWN_CHARACTER = r"\b", r"(?:^|[^\pL\pN_])"


def keyword_candidates(text: Column | str, ahead: str = BORDER) -> Column:
    """Capitalised phrases that follow a lower-case word, each once per document, then trimmed.

    With ``OWN_CHARACTER``, the blank that ends a phrase is not also the one ahead of the next, so of two phrases with
    one lower-case word between them the second is left out.
    """
    col = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(col, F.lit("(?U)" + ahead + CANDIDATE), 1)
    return F.transform(F.array_distinct(found), lambda x: F.trim(x))


def candidate_counts(df: DataFrame, text: str, cutoff: int = 200, ahead: str = BORDER) -> DataFrame:
    """Candidates in at least ``cutoff`` documents; percent is of the number of distinct candidates."""
    terms = df.select(F.explode(keyword_candidates(text, ahead)).alias("keyword"))
    return value_counts(terms, "keyword", n=None, cutoff=cutoff, vmax="values")


def tokens(text: Column | str, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case word tokens of two or more characters, stop words removed, repeats kept."""
    col = F.col(text) if isinstance(text, str) else text
    # the plain characters are looked up in a table of bits; only others ask for their Unicode class
    words = F.regexp_extract_all(F.lower(col), F.lit(r"(?U)[a-z0-9_\w]{2,}+"), 0)
    return F.filter(words, lambda w: ~w.isin(stop))


def query_terms(query: str, stop: list[str] = STOP_WORDS) -> list[str]:
    """Tokens of a query string, by the same rule; a repeated term counts each time."""
    import re

    return [w for w in re.findall(r"\w{2,}", query.lower()) if w not in stop]


def bm25_index(df: DataFrame, doc: str, text: str, by_doc: bool = True) -> dict[str, DataFrame]:
    """Index tables: ``postings`` (doc, term, tf, len), ``terms`` (term, df) and one-row ``stats``.

    Write them once and query many times. Texts are dealt by document, so that its terms are counted where it lies: a text
    is smaller than its postings. Partial counts keep a frequent term from travelling row by row. Without ``by_doc`` the
    postings travel, for a reader that goes over them twice.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(doc), tokens("_text").alias("_t")).withColumn("len", F.size("_t").cast("bigint"))

    texts = df.select(F.col(doc), F.col(text).alias("_text"))
    toks = counted(texts)
    postings = (counted(texts.repartition(doc)) if by_doc else toks).select(doc, "len", F.explode("_t").alias("term"))
    postings = postings.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    return {"postings": postings, "terms": terms, "stats": stats}


#: documents of a block, and best postings of a term that the floor of a lookup is taken from
BLOCK_DOCS = 1024
CHAMPIONS = 128
#: words whose postings a task of ``write_index`` counts and sorts, and the most tasks there may be
TASK_WORDS = 1 << 20
MOST_TASKS = 10_000


def block_postings(df: DataFrame, doc: str, text: str, n_docs: int, avg_len: float | None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings (doc, term, tf, len, block, part, leads), each partition with whole blocks of documents and sorted by term.

    ``leads`` marks the posting of a term and block that has the largest ``part`` of a score. The texts travel once, by block;
    postings, blocks and their order are made where they lie. A document of several rows is one document, as in ``bm25_index``.
    """
    average = F.lit(avg_len).cast("double")
    blocks = math.ceil(max(n_docs, 1) / block_docs)
    tasks = min(max(math.ceil(n_docs * (avg_len or 0) / TASK_WORDS), 1), MOST_TASKS)
    texts = df.select(F.col(doc), F.pmod(F.xxhash64(doc), F.lit(blocks).cast("bigint")).alias("block"), F.col(text).alias("_text"))
    toks = texts.repartition(tasks, "block").select(doc, "block", tokens("_text").alias("_t")).withColumn("len", F.size("_t").cast("bigint"))
    postings = toks.select(doc, "block", "len", F.explode("_t").alias("term"))
    postings = postings.groupBy("block", doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))
    parted = postings.select(doc, "term", "tf", "len", "block", _part(F.col("tf"), F.col("len"), average).alias("part"))
    best = Window.partitionBy("term", "block").orderBy(F.desc("part"), doc)
    marked = parted.withColumn("leads", F.row_number().over(best) == 1)
    return marked.sortWithinPartitions("term", "block", F.desc("part"), doc)  # as the window left them


def write_index(df: DataFrame, doc: str, text: str, folder: str, block_docs: int = BLOCK_DOCS) -> dict[str, DataFrame]:
    """Store the index tables below ``folder`` and read them back.

    Documents are dealt into blocks, and a file of ``postings`` holds whole blocks, sorted by term, so that a query's terms meet
    few row groups of each. Neither postings nor what is taken from them is dealt out again, for they are several times
    the size of the texts. ``read_index`` reads two more tables off them: ``blocks`` has the largest part of a score that
    a term gives any document of a block, ``champions`` the documents to which each term gives most: with these
    ``bm25_lookup`` leaves out blocks without a hit. All parts are exact, since lengths and the average are final.
    """
    spark = df.sparkSession
    bm25_index(df, doc, text)["stats"].write.mode("overwrite").parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats").first()
    block_postings(df, doc, text, stats["n_docs"], stats["avg_len"], block_docs).write.mode("overwrite").parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored tables; a filter on terms reaches the scan of each, that of ``blocks`` and ``champions`` through their marks and ranks."""
    index = {name: spark.read.parquet(f"{folder}/{name}") for name in ("postings", "terms", "stats")}
    stored = index["postings"]
    doc = stored.columns[0]
    best = Window.partitionBy("term").orderBy(F.desc("part"), doc)
    ranked = stored.select("term", doc, "part").withColumn("place", F.row_number().over(best))
    return index | {
        "blocks": stored.filter("leads").select("term", "block", F.col("part").alias("most")), "champions": ranked.filter(F.col("place") <= CHAMPIONS),
    }


def blocks_to_read(
    index: dict[str, DataFrame], doc: str, idf: dict[str, float], k: int, weights: DataFrame | None = None, heaviest: float = 1.0
) -> DataFrame:
    """Blocks whose documents can reach the ``k``-th best score, by ``idf`` of each query term.

    A document among a term's champions has at least what its champion parts give it, so the ``k``-th best of these sums
    is a floor; a block stays if the sum of its terms' largest parts, at the heaviest weight, is not below it.
    """
    terms = list(idf)
    worth = F.create_map(*[F.lit(x) for t in terms for x in (t, idf[t])])
    sums = index["champions"].filter(F.col("term").isin(terms)).groupBy(doc).agg(F.sum(worth[F.col("term")] * F.col("part")).alias("least"))
    if weights is not None:
        sums = sums.join(weights, doc, "left").select((F.col("least") * F.coalesce("weight", F.lit(1.0))).alias("least"))
    top = sums.select("least").orderBy(F.desc("least")).limit(k)
    floor = top.agg(F.when(F.count(F.lit(1)) >= k, F.min("least")).otherwise(0.0)).scalar()
    limits = index["blocks"].filter(F.col("term").isin(terms)).groupBy("block").agg(F.sum(worth[F.col("term")] * F.col("most")).alias("most"))
    # sums of parts in another order may differ in the last digits
    return limits.filter(F.col("most") * F.lit(heaviest * (1 + 1e-9)) >= floor).select("block")


def bm25_lookup(
    index: dict[str, DataFrame], doc: str, query: str, k: int = 15, weights: DataFrame | None = None, heaviest: float = 1.0
) -> DataFrame:
    """``bm25_retrieve`` on a stored index that scores only the blocks that can hold one of the top ``k``.

    ``heaviest`` is the largest weight there may be; 1 fits weights by recency. Statistics of the query's
    terms, a row each, are read when the plan is made.
    """
    times = {t: query_terms(query).count(t) for t in sorted(set(query_terms(query)))}
    stats = index["stats"].first()
    known = {r["term"]: r["df"] for r in index["terms"].filter(F.col("term").isin(list(times))).collect()} if times else {}
    if not known:
        return index["postings"].select(doc, F.lit(0.0).alias("score")).limit(0)
    n = stats["n_docs"]
    idf = {t: times[t] * math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in known.items()}
    hits = index["postings"].filter(F.col("term").isin(list(idf)))
    hits = hits.join(blocks_to_read(index, doc, idf, k, weights, heaviest), "block", "left_semi")
    worth = F.create_map(*[F.lit(x) for t in idf for x in (t, idf[t])])
    scored = hits.groupBy(doc).agg(F.sum(worth[F.col("term")] * F.col("part")).alias("score"))
    if weights is not None:
        scored = scored.join(weights, doc, "left").select(doc, (F.col("score") * F.coalesce("weight", F.lit(1.0))).alias("score"))
    return _top(scored, doc, k)


def _occurrences(items: str, term: str) -> Column:
    """Without a lambda, which would leave generated code."""
    return F.size(items) - F.size(F.array_remove(items, F.lit(term)))


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _part(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def _top(scored: DataFrame, doc: str, k: int) -> DataFrame:
    # positive scores sort first, so the test may follow the limit; ahead of it, it would be pushed down
    # into the scan and repeat the whole score there
    return scored.orderBy(F.desc("score"), F.asc(doc)).limit(k).filter(F.col("score") > 0)


def bm25_rank(df: DataFrame, doc: str, text: str, query: str, k: int = 15, weight: Column | None = None) -> DataFrame:
    """Top ``k`` documents for one query straight from the texts: two scans and no shuffle of the corpus.

    Term counts are taken per row from the token list, the corpus statistics come in as a scalar
    subquery, and only ``k`` rows per task leave it. ``weight`` is an expression over ``df``.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    counts = [_occurrences("_t", term).cast("double").alias(f"_tf{i}") for i, term in enumerate(distinct)]

    def counted(docs: DataFrame) -> DataFrame:
        carried = docs.select(doc, (F.lit(1.0) if weight is None else weight).alias("_w"), tokens(text).alias("_t"))
        return carried.select(doc, "_w", F.size("_t").cast("double").alias("_len"), *counts)

    stats = counted(df).agg(F.struct(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_len").alias("avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(distinct))],
    ).alias("s")).scalar()
    scored = counted(df).withColumn("_s", stats)
    parts = [
        F.lit(float(terms.count(t))) * _idf(F.col("_s.n"), F.col(f"_s.df{i}"))
        * _part(F.col(f"_tf{i}"), F.col("_len"), F.col("_s.avg"))
        for i, t in enumerate(distinct)
    ]
    score = reduce(lambda x, y: x + y, parts, F.lit(0.0)) * F.col("_w")
    return _top(scored.select(doc, score.alias("score")), doc, k)


def bm25_retrieve(
    index: dict[str, DataFrame], doc: str, query: str, k: int = 15, weights: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` documents from stored index tables; ``weights`` is (doc, weight); a
    document without one weighs 1.

    Only the postings of the query terms are read: the terms are literals, so the filter reaches the
    scan. ``df`` and the averages are scalar subqueries.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    if not distinct:
        return index["postings"].select(doc, F.lit(0.0).alias("score")).limit(0)
    stats = index["stats"].agg(F.struct(F.max("n_docs").alias("n"), F.max("avg_len").alias("avg")).alias("s")).scalar()
    dfs = (
        index["terms"].filter(F.col("term").isin(distinct))
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("m")).scalar()
    )  # at most one entry per query term
    times = F.create_map(*[F.lit(x) for t in distinct for x in (t, float(terms.count(t)))])
    hits = (
        index["postings"].filter(F.col("term").isin(distinct))
        .withColumn("_s", stats).withColumn("_df", F.element_at(dfs, F.col("term")).cast("double"))
    )
    part = times[F.col("term")] * _idf(F.col("_s.n"), F.col("_df")) * _part(F.col("tf"), F.col("len"), F.col("_s.avg"))
    scored = hits.groupBy(doc).agg(F.sum(part).alias("score"))
    if weights is not None:
        weighed = F.col("score") * F.coalesce("weight", F.lit(1.0))
        scored = scored.join(weights, doc, "left").select(doc, weighed.alias("score"))
    return _top(scored, doc, k)


def prompt_table(df: DataFrame, prompt: str, text: str, key: str) -> DataFrame:
    """Prompt and document as one message, each distinct message once, with its digest and first key."""
    message = F.concat(F.lit(prompt), F.lit("\n\n"), F.col(text))
    return (
        df.select(key, message.alias("message"))
        .withColumn("digest", F.sha2("message", 256))
        .groupBy("digest", "message")  # as a key the message stays in hash aggregation
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_rows"))
    )
