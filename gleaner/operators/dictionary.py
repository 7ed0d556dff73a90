"""Hits of a long list of literal terms, as an alternation of all of them would find them.

An alternation tries every term at every place, so its cost grows with the list. Here only the terms that may occur in a text
are tried on it:

1. The words of the corpus (runs without white space) are made distinct; every part of a word that could begin a term is
   joined with the list. A term of several words must begin with the end of a word, a term of one word may begin and end
   anywhere in one, and is looked up by its first characters.
2. The words of each text are joined with the first words they end with, and these with the terms by the first characters of the word
   that follows, so that many terms with one first word are told apart; a text's terms are collected.
3. In the row, the terms that do not stand in the text go, and the alternation of the others, in the order of the list, is
   applied to the whole text. Terms that do not occur cannot match, so the hits are those of the whole list.

Neither texts nor the list are broadcast by hand; only words move. A text's own terms go back to it by its key, which may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.values import bound

#: first characters that a term is looked up by
GRAM = 4
#: characters that the first word of a term may have
LONGEST = 256


def term_table(terms: DataFrame, term: str, order: str) -> DataFrame:
    """(term, rank, first, more, second): each term once, its place in the list, its first word, whether more follows it, and
    the first characters of its second word.

    A term that is empty or begins with white space raises, since it begins with no word, and so does one whose first word
    is longer than ``LONGEST``.
    """
    named = terms.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.min(order).alias("rank"))
    first = F.regexp_extract("term", r"^\S+", 0)
    bad = F.raise_error(F.concat(F.lit("a term must begin with a word of usual length: "), "term")).cast("string")
    checked = F.when(~F.length(first).between(1, LONGEST), bad).otherwise(first)
    second = F.substring(F.regexp_extract("term", r"^\S+\s+(\S*)", 1), 1, GRAM)
    return named.select("term", "rank", checked.alias("first"), (F.length(first) < F.length("term")).alias("more"), second.alias("second"))


def words_that_begin(words: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, first) of every word that ends with the first word of a term of several, and (word, term, rank) of every word in
    which a term of one word begins.

    Terms that go on are not listed by word: a short first word ends many words and begins many terms, whose product would
    stand here.
    """
    # one character more than any first word, so that a longer rest is told from an equal one
    rests = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(LONGEST + 1))))
    parts = words.select("word", F.explode(rests).alias("rest"))
    firsts = table.filter("more").select("first").distinct()
    several = parts.join(firsts, F.col("rest") == F.col("first")).select("word", "first")
    grams = F.array_distinct(F.array(*[F.substring("rest", 1, n) for n in range(1, GRAM + 1)]))
    keyed = table.filter("not more").withColumn("gram", F.substring("first", 1, GRAM))
    single = parts.select("word", "rest", F.explode(grams).alias("gram")).join(keyed, "gram").filter(F.startswith("rest", "first"))
    return several, single.select("word", "term", "rank").distinct()


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def alternation(terms: Column, depth: int = 4) -> Column:
    """A pattern that tries ``terms`` in their order, those with the same first characters together; null without terms.

    Terms with different first characters never match at one place, so their order among each other is free. Where a term
    ends, it stays in its order among those that go on.
    """
    def tried(rests: Column, level: int) -> Column:
        plain = F.array_join(F.transform(rests, _quoted), "|")
        if not level:
            return plain
        heads = F.array_distinct(F.transform(rests, lambda t: F.substring(t, 1, 1)))
        after = lambda h: F.transform(F.filter(rests, lambda t: F.startswith(t, h)), lambda t: F.substring(t, F.lit(2), F.length(t)))
        groups = F.transform(heads, lambda h: F.concat(_quoted(h), F.lit("(?:"), bound(after(h), lambda r: tried(r, level - 1)), F.lit(")")))
        return F.when((F.size(rests) < 2) | F.exists(rests, lambda t: t == ""), plain).otherwise(F.array_join(groups, "|"))

    return F.when(F.size(terms) > 0, F.concat(F.lit("("), tried(terms, depth), F.lit(")")))


def long_dictionary_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", order: str = "rank", out: str = "hits") -> DataFrame:
    """``df`` with ``out``, every hit of the terms left to right; null when there is none.

    At one place the term that stands earlier in ``order`` is taken, of two at one place in it the lesser.
    """
    table = term_table(terms, term, order)
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    # as texts, which are made distinct by hashing; a word holds no blank
    both = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, n: F.concat(w, F.lit(" "), F.coalesce(F.substring(n, 1, GRAM), F.lit(""))))
    pairs = df.select(F.col(key).alias("key_of"), F.explode(F.array_distinct(both)).alias("both"))
    pairs = pairs.select("key_of", F.substring_index("both", " ", 1).alias("word"), F.substring_index("both", " ", -1).alias("follow"))
    several, single = words_that_begin(pairs.select("word").distinct(), table)
    heads = F.array(F.lit(""), *[F.substring("follow", 1, n) for n in range(1, GRAM + 1)])
    led = pairs.join(several, "word").select("key_of", "first", F.explode(F.array_distinct(heads)).alias("second"))
    met = led.join(table.filter("more"), ["first", "second"]).select("key_of", "rank", "term")
    met = met.unionByName(pairs.join(single, "word").select("key_of", "rank", "term"))
    found = met.groupBy("key_of").agg(F.collect_set(F.struct("rank", "term")).alias("terms_of"))
    joined = df.join(found, df[key].eqNullSafe(found["key_of"]), "left")
    present = F.transform(F.filter(F.array_sort("terms_of"), lambda t: F.contains(F.col(text), t["term"])), lambda t: t["term"])
    hits = F.regexp_extract_all(F.col(text), bound(present, lambda p: alternation(p)), F.lit(1))
    kept = [c for c in df.columns if c != out]
    return joined.select(*[df[c] for c in kept], hits.alias(out))
