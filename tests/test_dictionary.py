"""The long word list against the alternation of all its terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import dictionary_hits
from gleaner.operators.dictionary import LONGEST, long_dictionary_hits, term_table, words_that_begin

TERMS = ["San Francisco", "San", "an Fra", "Fran", "New York City", "New York", "a", "York (NY)", "c++", ".net", r"\E$x", "é b", "Oakland\tCA", "x" * 40, "new"]


def random_text(draw):
    parts = [draw.choice([*TERMS, " ", "  ", "\n", "Frank", "NewYork", "Sanity", "q", "xx" * 30, "New York", "(", "é"]) for _ in range(draw.randrange(12))]
    return "".join(parts)


def test_hits_equal_the_alternation(spark):
    draw = random.Random(3)
    texts = [(i % 150 if i % 9 else None, random_text(draw), "k") for i in range(200)] + [(1000, None, "k"), (1001, "", "k"), (1002, "New York City " * 3000, "k"), (1003, "a" * 20_000, "k")]
    df = spark.createDataFrame(texts, "id long, text string, word string")
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(TERMS)] + [("San", 50), (None, 1)], "term string, rank int")
    got = long_dictionary_hits(df, "id", "text", terms).collect()
    want = df.select("id", "text", "word", dictionary_hits("text", TERMS).alias("hits")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r.hits is not None for r in got) > 100


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("term "), "id").alias("term"), F.col("id").alias("rank"))
    df = spark.range(300).select("id", F.concat(F.lit("some term "), F.col("id") * 7, F.lit(" and Xterm 99999 here")).alias("text"))
    got = {r.id: r.hits for r in long_dictionary_hits(df, "id", "text", terms).collect()}
    # the earlier and shorter number wins where one begins the other, as in an alternation
    want = {i: re.findall("|".join(f"term {n}" for n in (range(10))), f"some term {7 * i} and Xterm 99999 here") for i in range(300)}
    assert got == want
    plan = long_dictionary_hits(df, "id", "text", terms)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_terms_without_a_first_word_raise(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    for term in ("", " a", "x" * (LONGEST + 1)):
        with pytest.raises(Exception, match="must begin with a word"):
            long_dictionary_hits(df, "id", "text", spark.createDataFrame([(term, 1)], "term string, rank int")).collect()


def test_many_terms_of_one_first_word_are_not_listed_by_word(spark):
    """Words that end with a first word times the terms it begins are more than either."""
    terms = spark.range(2_000).select(F.concat(F.lit("a w"), "id").alias("term"), F.col("id").alias("rank"))
    words = spark.range(3_000).select(F.concat(F.lit("x"), "id", F.lit("a")).alias("word"))
    several, single = words_that_begin(words, term_table(terms, "term", "rank"))
    assert (several.count(), several.columns, single.count()) == (3_000, ["word", "first"], 0)
