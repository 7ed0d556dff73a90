"""License scan: an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z in lower case, line ends ignored. The blocks
that a template is held against are all runs of ``window_of`` consecutive words, a little more than it has itself, so a notice
that is wrapped over lines is one block and words far apart are none. A block meets a template when it holds at
least ``THRESHOLD`` of the template's distinct words. Template words are put in one global order, rarest first by the
number of texts that hold them. With c the least count of common words that meets the threshold:

- prefix filter: a block that meets a template of m words has one of its first m - c + 1 words, so blocks are looked for around
  the places of these words only;
- length filter: there are at least c template words within reach of that place;
- positional filter: after a common word at place i of the template and j of the template words within reach, no
  more than min(m - i, k - j) common words can follow, that one included (k: those within reach).

What passes is counted exactly, block by block. Every text is taken apart once: the places of template words are
written and all else reads them. Labels of phrases whose words stand consecutively are found there too, in one pass over a
text's places. All of it is DataFrame functions.

Null and empty texts have no words and no labels; texts of any length are read whole; repeated rows come
out once each, and rows that share a doc_id share the labels found in any of them; a null doc_id is a key like
any other. Other columns are not used, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.85

# fixed values: phrases of the contract and usual wordings of license notices
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license version 3", "lgpl-3"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
]


def template_words(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of each template."""
    return [(n, label, list(dict.fromkeys(text.split()))) for n, (text, label) in enumerate(templates)]


def window_of(text: str) -> int:
    """Words of the blocks that a template is held against: its own and a quarter more."""
    n = len(text.split())
    return n + (n + 3) // 4


def least_common(words: int, threshold: float) -> int:
    """The least count of common words that meets the threshold, free of rounding below a billionth."""
    return max(1, -int(-(words * threshold - 1e-9) // 1))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_places(docs: DataFrame, doc_id: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n_words, hits) per row: the words of the vocabulary as (pos, w), in order."""
    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words_of(ascii_lower(F.col(f"`{text}`"))).alias("words"))
    hit = lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("w")))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", hit)).alias("hits"))


def word_frequency(places: DataFrame) -> Column:
    """A map from word to the number of texts that hold it, as a scalar subquery over all texts."""
    held = places.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    counts = held.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("m")).scalar()


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One row per template, from literals: its size is that of the list in the code."""
    rows = [
        F.struct(
            F.lit(n).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, ws)).alias("template_words"),
            F.lit(least_common(len(ws), threshold)).alias("needed"), F.lit(window_of(templates[n][0])).alias("span"),
        )
        for n, label, ws in template_words(templates)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def in_global_order(words: Column, frequency: Column) -> Column:
    """Words rarest first; equally frequent ones by the word itself."""
    keyed = F.transform(words, lambda w: F.struct(F.coalesce(frequency[w], F.lit(0)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda x: x["w"])


def matching_blocks(
    places: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, template, label, containment): the best block around each place of a prefix word, where it meets the template.

    ``places`` is a stored table of ``word_places``.
    """
    frequency = word_frequency(places)
    index = template_table(places.sparkSession, templates, threshold).withColumn("frequency", frequency)
    index = index.withColumn("ordered", in_global_order(F.col("template_words"), F.col("frequency")))
    prefix = F.expr("slice(ordered, 1, size(ordered) - needed + 1)")
    index = index.select("template", "label", "ordered", "needed", "span", F.posexplode(prefix).alias("i", "word"))
    prefixes = index.agg(F.collect_set("word").alias("all")).scalar()

    # places ascend, so all words within reach are as many hits away at most
    reach = max(window_of(text) for text, _ in templates)
    hits = F.col("hits")
    around = lambda h, k: F.when(
        F.array_contains(F.col("prefixes"), h["w"]),
        F.struct(h["pos"].alias("pos"), h["w"].alias("word"), F.slice(hits, F.greatest(k + 2 - reach, F.lit(1)), F.lit(2 * reach - 1)).alias("near")),
    )
    found = (
        places.filter(F.size(hits) > 0).withColumn("prefixes", prefixes)
        .select("doc_id", F.inline(F.array_compact(F.transform(hits, around))))
        .join(F.broadcast(index), "word")
    )
    within = lambda h: (h["pos"] > F.col("pos") - F.col("span")) & (h["pos"] < F.col("pos") + F.col("span")) & F.array_contains("ordered", h["w"])
    kept = found.withColumn("near", F.filter("near", within))
    kept = kept.withColumn("held", F.array_intersect("ordered", F.transform("near", lambda h: h["w"])))
    kept = kept.filter(F.size("held") >= F.col("needed"))
    j = F.array_position("held", F.col("word")) - 1
    kept = kept.filter(F.least(F.size("ordered") - F.col("i"), F.size("held") - j) >= F.col("needed") - F.least(F.col("i"), j))
    # a best block begins with a template word and reaches the prefix word
    near, span = F.col("near"), F.col("span")
    block = lambda s: F.filter(near, lambda h: (h["pos"] >= s["pos"]) & (h["pos"] < s["pos"] + span))
    count = lambda s: F.size(F.array_distinct(F.transform(block(s), lambda h: h["w"])))
    best = F.array_max(F.transform(F.filter(near, lambda s: s["pos"] <= F.col("pos")), count))
    met = kept.select("doc_id", "template", "label", best.alias("n"), F.size("ordered").alias("m"), "needed")
    return met.filter(F.col("n") >= F.col("needed")).select("doc_id", "template", "label", (F.col("n") / F.col("m")).alias("containment"))


def phrase_starts(hits: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the words of ``phrase`` stand consecutively, from the places of all its words."""
    first, *rest = phrase.split()

    def starts(h: Column, k: Column) -> Column:
        here = h["w"] == first
        for step, word in enumerate(rest, 1):
            ahead = F.get(hits, k + step)
            here = here & (ahead["w"] == word) & (ahead["pos"] == h["pos"] + step)
        return F.coalesce(here, F.lit(False))

    return F.transform(F.filter(hits, starts), lambda h: h["pos"].cast("long"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: words, places of base phrases, base labels, all labels, and a score.

    The score is the largest containment that a block reaches, 1 where a base phrase stands, else 0.
    """
    vocabulary = sorted({w for t in [*PHRASES, *(t for t, _ in TEMPLATES)] for w in t.split()})
    places = written(word_places(docs, doc_id, text, vocabulary), "license-words")
    base = places.select(
        "doc_id", "n_words", *[phrase_starts(F.col("hits"), phrase).alias(f"at_{label}") for phrase, label in PHRASES.items()]
    )
    starts = F.concat(*[F.col(f"`at_{label}`") for label in PHRASES.values()])
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"`at_{x}`")) > 0, F.lit(x)) for x in PHRASES.values()]))
    base = base.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels.alias("found"),
    )
    blocks = matching_blocks(places).groupBy(F.col("doc_id").alias("block_doc")).agg(
        F.collect_set("label").alias("block_labels"), F.max("containment").alias("best")
    )
    joined = base.join(blocks, F.col("doc_id").eqNullSafe(F.col("block_doc")), "left")
    none = F.array().cast("array<string>")
    every = F.array_union("found", F.coalesce("block_labels", none))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for ``scan_licenses`` that holds every block of every text against every template, without filters."""
    def literals(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    templates = ", ".join(
        f"({n}, '{label}', {literals(ws)}, {least_common(len(ws), THRESHOLD)}, {window_of(TEMPLATES[n][0])})"
        for n, label, ws in template_words(TEMPLATES)
    )
    starts = " || ".join(
        f"list_transform(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + {len(p.split())}] = {literals(p.split())}),"
        f" lambda i: {{'at': i, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    return f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
), placed AS (SELECT doc_id, len(words) AS n_words, {starts} AS places FROM texts),
templates AS (FROM (VALUES {templates}) AS t(template, label, tw, needed, span)),
wanted AS (SELECT *, unnest(tw) AS word FROM templates),
hits AS (SELECT doc_id, rid, unnest(range(0, len(words))) AS pos, unnest(words) AS word FROM texts),
blocks AS (
  SELECT doc_id, label, needed, len(tw) AS m, len(list_distinct(list(word) OVER (
    PARTITION BY rid, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING))) AS n
  FROM hits JOIN wanted USING (word)
), met AS (SELECT doc_id, label, n / m AS containment FROM blocks WHERE n >= needed),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM met GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda p: p.at))::BIGINT AS first_word,
  list_max(list_transform(places, lambda p: p.at))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label) || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM placed LEFT JOIN best USING (doc_id)"""
