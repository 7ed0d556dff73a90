"""Result cards of listing pages as a typed postings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup, text, values
from gleaner.operators.dedupe import keep_first
from gleaner.schemas import CARD_SLOTS, COMPANY_CARD_COLUMNS

CARD_OPEN = r'<div[^>]*class="[^"]*\bcard\b[^"]*"[^>]*>'
# Fixed value: the row of a card's buttons; each child element is one
BUTTON_ROW = r"<div[^>]*class=[\"']flex justify-center space-x-2[\"'][^>]*>"


def own_part(rest: Column, tag: str = "div") -> Column:
    """What an element holds, given all markup behind its opening tag: up to its own closing tag, or to the end."""
    steps = F.split(rest, rf"(?i)(?=</?{tag}[\s>/])")

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece.rlike(rf"(?i)\A</{tag}[\s>/]"), -1).when(piece.rlike(rf"(?i)\A<{tag}[\s>/]"), 1).otherwise(0)
        is_open = at["open"] & (depth > 0)
        return F.struct(
            depth.alias("depth"), is_open.alias("open"),
            (at["chars"] + F.when(is_open, F.length(piece)).otherwise(0)).alias("chars"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(True).alias("open"), F.lit(0).alias("chars"))
    return F.substr(rest, F.lit(1), F.aggregate(steps, start, step)["chars"])


def row_cells(card: Column, row_open: str = BUTTON_ROW) -> Column:
    """How many child ``div`` elements the card's button rows have."""
    rows = F.split(card, row_open)

    def children(rest: Column) -> Column:
        steps = F.regexp_extract_all(own_part(rest), F.lit(r"(?i)</?div(?=[\s>/])"), 0)
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
        counted = F.aggregate(steps, start, lambda at, tag: F.struct(
            (at["depth"] + F.when(tag.startswith("</"), -1).otherwise(1)).alias("depth"),
            (at["n"] + F.when((at["depth"] == 0) & ~tag.startswith("</"), 1).otherwise(0)).alias("n"),
        ))
        return counted["n"]

    inner = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.aggregate(inner, F.lit(0).cast("bigint"), lambda n, rest: n + children(rest))


def card_rows(
    pages: DataFrame, html: str = "html", card_open: str = CARD_OPEN, text_tag: str = "span", tag: str = "div",
    row_open: str = BUTTON_ROW,
) -> DataFrame:
    """One row per card: position in the page, its texts, its two links, and the cells of its button row.

    A card is what follows an opening tag (of an element ``tag``) that fits ``card_open``, up to its own closing tag,
    or to the next card where that is missing. Links and cells are those inside it.
    """
    pieces = F.split(F.col(html), card_open)
    cards = pages.select(
        "*", F.posexplode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("card", "_piece")
    )
    return (
        cards.withColumn("_piece", own_part(F.col("_piece"), tag))
        .withColumn("cells", markup.span_texts("_piece", text_tag))
        .withColumn("_links", markup.hrefs("_piece"))
        .withColumn("href", F.get("_links", F.lit(0)))
        .withColumn("href2", F.get("_links", F.lit(1)))
        .withColumn("_len", row_cells(F.col("_piece"), row_open))
        .drop("_piece", "_links")
    )


def _insert_unless(df: DataFrame, column: str, slot: int, ok: Column, filler: str | None = "-") -> DataFrame:
    fixed = F.array_insert(column, slot + 1, F.lit(filler).cast("string"))
    return df.withColumn(column, F.when(F.coalesce(ok, F.lit(False)), F.col(column)).otherwise(fixed))


def repair_cards(df: DataFrame, column: str = "cells", company: Column | None = None) -> DataFrame:
    """Fill in the optional slots a card leaves out, so that every list has 15 slots.

    Each test sees the list after the earlier inserts. ``company`` is non-null for the cards of a
    company page, which carry one slot more at the front and lack the company slots.
    """

    def slot(i: int) -> Column:
        return F.get(F.col(column), F.lit(i))

    if company is not None:
        df = df.withColumn("_company", company)
        lone = F.col("_company").isNotNull()
        rest = F.slice(column, F.lit(2), F.greatest(F.size(column) - 1, F.lit(0)))
        df = df.withColumn(column, F.when(lone, rest).otherwise(F.col(column)))
    df = _insert_unless(df, column, 0, slot(0).rlike(r"^\d\d?[y|mowdh]"), "0h")
    df = _insert_unless(df, column, 3, slot(3).rlike("(yr|mo|wk|hr)$"))
    if company is not None:
        both = F.array_insert(F.array_insert(column, 7, F.col("_company")), 8, F.lit(None).cast("string"))
        df = df.withColumn(column, F.when(F.col("_company").isNotNull(), both).otherwise(F.col(column)))
    df = _insert_unless(df, column, 7, ~F.coalesce(slot(7).startswith(":"), F.lit(False)))
    df = _insert_unless(df, column, 9, slot(9).endswith("YOE"))
    df = _insert_unless(df, column, 10, slot(10).endswith("Mgmt"))
    df = _insert_unless(df, column, 12, ~F.coalesce(F.contains(slot(12), F.lit("Posting")), F.lit(False)))
    return df.withColumn(column, F.slice(column, 1, len(CARD_SLOTS))).drop("_company")


def cells_to_columns(df: DataFrame, column: str = "cells", names: list[str] = CARD_SLOTS) -> DataFrame:
    """Slots of a list as named columns, with white space collapsed."""
    cells = {n: text.collapse_space(F.get(F.col(column), F.lit(i))) for i, n in enumerate(names)}
    return df.withColumns(cells).drop(column)


def check_all(df: DataFrame, test: Column, message: str) -> DataFrame:
    """The same rows; the job fails on the first row that does not pass ``test``, whatever columns are read.

    The test feeds a generator, on which the row's existence depends, so no reader's choice of columns takes it
    away. As a filter it would be pushed below the steps that compute its input, and repeat them.
    """
    passed = F.coalesce(test, F.lit(False))
    one = F.array(F.lit(True))
    kept = F.when(passed, one).otherwise(F.raise_error(F.lit(message)).cast("array<boolean>"))
    return df.withColumn("_checked", F.explode(kept)).drop("_checked")


def posting_features(df: DataFrame, cities: list[str]) -> DataFrame:
    """Typed features of repaired cards: age, name, pay, experience and home-region cities."""
    df = df.withColumn("company", text.clean_company("company"))
    df = df.withColumn("hours", values.age_to_hours("days"))
    df = df.withColumn("position", text.position_name("company", "title"))
    df = df.withColumn("_position", text.lower_key("position"))
    pay = values.salary_bounds("salary")
    df = df.withColumns({"lower": pay["lower"], "upper": pay["upper"], "location": text.shorten_location("location")})
    df = df.withColumns({
        "median": values.midpoint("lower", "upper"),
        "yoe": values.leading_number("yoe"),
        "mgmt": values.leading_number("mgmt"),
        "bay": text.dictionary_hits("location", cities),
    })
    return df


def postings_from_pages(
    pages: DataFrame, cities: list[str], html: str = "html", card_open: str = CARD_OPEN, dedupe: bool = True
) -> DataFrame:
    """Listing pages to the deduplicated postings table, in one scan and one shuffle."""
    lone = markup.is_company_page(html)
    cards = card_rows(
        pages.withColumn("_lone", F.when(lone, F.concat(markup.page_title(html), F.lit("_")))), html, card_open
    )
    cards = cells_to_columns(repair_cards(cards, company=F.col("_lone")))
    keyed = cards.withColumns({
        "hash": markup.key_from_url("href"),
        "chash": F.when(F.col("_lone").isNull(), markup.company_key("href2")),
    })
    keyed = check_all(keyed, F.col("_job_posting") == "Job Posting", "a card lacks its posting mark")
    keyed = keyed.drop("_job_posting", "_views", "href", "href2", "_lone", html)
    featured = posting_features(keyed, cities)
    if not dedupe:
        return featured
    return keep_first(
        featured, ["_position"],
        [F.asc_nulls_last("position"), F.asc_nulls_last("hours"), F.asc_nulls_last("company_summary"), F.asc("hash")],
    )


__all__ = ["COMPANY_CARD_COLUMNS", "card_rows", "cells_to_columns", "check_all", "posting_features",
           "postings_from_pages", "repair_cards"]
