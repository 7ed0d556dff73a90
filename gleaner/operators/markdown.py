"""Markdown documents as tables of lines and blocks.

A document's lines, their kinds and its blocks are lists within its row: everything that looks at the line or block next to
another is a lookup in such a list. Rows are exploded at the end, and no step shuffles or sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.values import bound, sums_before
from gleaner.plans.ordered import forward_value

HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
ITEM = r"^ {0,3}([-*+]|\d{1,9}[.)])[ \t]+(.*)$"
RULE = r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kept_lines(text: Column | str) -> Column:
    """Lines of a text without those that open a comment."""
    return F.filter(F.split(_col(text), "\n"), lambda x: ~x.startswith("<!--"))


def md_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, text): kept lines numbered from 0. The number comes with the split, without a window."""
    return df.select(doc, F.posexplode(kept_lines(text)).alias("line", "text"))


def _kinds(lines: Column) -> Column:
    """Kind of each line. Front matter reaches from a fence on the first line to the next fence, if there is one."""
    fence = lambda x: x.rlike(r"^---\s*$")
    closing = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), fence), True)
    front = F.when(fence(F.get(lines, F.lit(0))) & (closing > 0), closing).otherwise(F.lit(-1))

    def kind(x: Column, last: Column, i: Column) -> Column:
        return (
            F.when(i <= last, "front").when(x.rlike(r"^\s*$"), "blank").when(x.rlike(HEADING), "h")
            .when(x.rlike(RULE), "hr").when(x.rlike(ITEM), "li").otherwise("p")
        )

    return bound(front, lambda last: F.transform(lines, lambda x, i: kind(x, last, i)))


def _openings(kinds: Column) -> Column:
    """Numbers of the lines that open a block."""
    def opens(k: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(kinds, i - 1))
        fresh = before.isNull() | before.isin("blank", "h", "hr", "front")
        return k.isin("h", "hr", "li") | ((k == "front") & (i == 0)) | ((k == "p") & fresh)

    return F.array_compact(F.transform(kinds, lambda k, i: F.when(opens(k, i), i)))


def _body(kind: Column, line: Column) -> Column:
    """What a line adds to its block's content; null for nothing."""
    return (
        F.when(kind == "h", F.regexp_extract(line, HEADING, 2)).when(kind == "li", F.regexp_extract(line, ITEM, 2))
        .when(kind.isin("hr", "front", "blank"), F.lit(None).cast("string")).otherwise(F.trim(line))
    )


def _mark(kind: Column, line: Column) -> Column:
    return (
        F.when(kind == "h", F.regexp_extract(line, HEADING, 1)).when(kind == "li", F.regexp_replace(F.regexp_extract(line, ITEM, 1), r"\d+", ""))
        .when(kind.isin("hr", "front"), F.lit("---")).otherwise(F.lit(""))
    )


def block_agg(lines: DataFrame, doc: str, block: str, order: str, tag: str, text: str) -> DataFrame:
    """By block: number of lines, last tag, first text, and the texts in order joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return lines.groupBy(doc, block).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max_by(tag, order).alias("last_tag"),
        F.min_by(text, order).alias("first_text"),
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("content"),
    )


def blocks_of(text: Column | str) -> Column:
    """The blocks of a text in order: structs of begin line, token count, tag, markup, content and whether a list follows.

    A list item is ``li``; the last item of a list counts as ``ul`` (``ol`` when numbered), since its
    closing marks share the block. Rules cover front matter, headings, rules, list items with lazy
    continuation lines, and paragraphs. Lines ahead of the first block are blank; a null text has no blocks.
    """
    def cut(lines: Column, kinds: Column, starts: Column) -> Column:
        bodies = F.zip_with(kinds, lines, _body)

        def raw(bodies: Column) -> Column:
            def block(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(lines))
                kind, line = F.get(kinds, at), F.get(lines, at)
                content = F.array_join(F.slice(bodies, at + 1, end - at), "\n")
                return F.struct(at.alias("begin"), kind.alias("kind"), _mark(kind, line).alias("markup"), content.alias("content"))

            return F.transform(starts, block)

        return bound(bodies, raw)

    def tagged(blocks: Column) -> Column:
        def one(b: Column, k: Column) -> Column:
            is_item = b["kind"] == "li"
            alike = lambda o: F.coalesce((o["kind"] == "li") & (o["markup"] == b["markup"]), F.lit(False))
            first = is_item & ~F.when(k > 0, alike(F.get(blocks, k - 1))).otherwise(False)
            last = is_item & ~alike(F.get(blocks, k + 1))
            tag = (
                F.when(last, F.when(b["markup"].isin("-", "*", "+"), "ul").otherwise("ol"))
                .when(b["kind"] == "h", F.concat(F.lit("h"), F.length(b["markup"]).cast("string")))
                .when(b["kind"] == "front", F.lit("")).otherwise(b["kind"])
            )
            size = F.when(is_item, 5 + first.cast("int") + last.cast("int")).when(b["kind"].isin("hr", "front"), 1).otherwise(3)
            return F.struct(b["begin"].alias("begin"), size.cast("bigint").alias("len"), tag.alias("tag"), b["markup"].alias("markup"), b["content"].alias("content"))

        return F.transform(blocks, one)

    def followed(blocks: Column) -> Column:
        after = lambda k: F.coalesce(F.get(blocks, k + 1)["tag"].isin("ul", "li"), F.lit(False))
        return F.transform(blocks, lambda b, k: F.struct(*[b[c].alias(c) for c in ("begin", "len", "tag", "markup", "content")], after(k).alias("list_next")))

    whole = lambda lines: bound(_kinds(lines), lambda kinds: bound(_openings(kinds), lambda starts: cut(lines, kinds, starts)))
    return bound(bound(bound(kept_lines(text), whole), tagged), followed)


_BLOCK = ("begin", "len", "tag", "markup", "content")


def md_blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per block: begin line, token count, tag, markup, content."""
    return df.select(doc, F.inline(blocks_of(text))).select(doc, *_BLOCK)


def _rebuilt(b: Column) -> tuple[Column, Column]:
    """A block's lines as written, and condensed."""
    newline = F.lit("\n")
    full = F.concat(F.regexp_replace(F.concat(b["markup"], F.lit(" "), b["content"]), r"(?U)^\s+", ""), F.when(b["tag"] == "li", F.lit("")).otherwise(newline))
    short = F.concat(b["content"], F.when(b["tag"].isin("li", "h2") | b["list_next"], F.lit("")).otherwise(newline))
    return F.split(full, "\n"), F.split(short, "\n")


def _with_lines(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        markdown, condensed = _rebuilt(b)
        return F.struct(*[b[c].alias(c) for c in (*_BLOCK, "list_next")], markdown.alias("markdown"), condensed.alias("condensed"))

    return F.transform(blocks, one)


def md_line_text(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Blocks with their lines rebuilt: ``markdown`` as written, ``condensed`` without the blank line
    after a heading, an item, or ahead of a list."""
    return df.select(doc, F.inline(_with_lines(blocks_of(text))))


def md_explode(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per rebuilt line: ``i`` within the block, ``line`` from 1, and the condensed line or null.

    ``place`` is the line's place in its document, from 1; ``gap`` counts the empty lines of list ends up to an own one.
    """
    def lines(b: Column, ahead: Column, gaps: Column) -> Column:
        gap = lambda x: (b["tag"] == "ul") & (F.length(x) == 0)
        return F.transform(b["markdown"], lambda x, i: F.struct(
            *[b[c].alias(c) for c in ("begin", "len", "tag", "markup", "list_next")], i.alias("i"), (b["begin"] + i + 1).alias("line"),
            x.alias("markdown"), F.get(b["condensed"], i).alias("condensed"), (ahead + i + 1).cast("int").alias("place"),
            F.when(gap(x), gaps + F.size(F.filter(F.slice(b["markdown"], 1, i + 1), gap))).alias("gap"),
        ))

    def rows(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.size(b["markdown"]))
        gaps = F.transform(blocks, lambda b: F.when(b["tag"] == "ul", F.size(F.filter(b["markdown"], lambda x: F.length(x) == 0))).otherwise(0))
        made = lambda n, g: F.flatten(F.transform(blocks, lambda b, k: lines(b, F.get(n, k), F.get(g, k))))
        return bound(sums_before(sizes), lambda n: bound(sums_before(gaps), lambda g: made(n, g)))

    return df.select(doc, F.inline(bound(_with_lines(blocks_of(text)), rows)))


def md_style(rows: DataFrame, resume: bool = False, pagebreak: bool = False) -> DataFrame:
    """Style label of each line of ``md_explode``; later rules win. ``pagebreak`` marks the third empty line of lists."""
    first = F.col("i") == 0
    style = F.when(F.col("tag").isin("ul", "li") & first, "List Bullet").when((F.col("tag") == "h2") & first, "Heading 2").otherwise("Normal")
    if pagebreak:
        style = F.when(F.col("gap") == 3, "_pagebreak").otherwise(style)
    if resume:
        row = F.col("place")
        style = F.when(row == 1, "title").when(row == 2, "subtitle").when(row == 4, "Heading 2").otherwise(style)
    return rows.withColumn("style", style)


# one piece up to its closing bold mark; anchored and possessive, so that a long line costs linear time
BOLD_PIECE = r"\G(.(?:(?!\*\*).)*+\*\*.(?:(?!\*\*).)*+\*\*)"


def bold_runs(condensed: Column | str) -> Column:
    """Pieces that end in a bold part, then the tail; a null line gives one empty piece."""
    c = _col(condensed)
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), c), F.lit(BOLD_PIECE), 1)
    tail = F.element_at(F.split(c, r"\*\*"), -1)
    return F.concat(F.coalesce(pieces, F.array().cast("array<string>")), F.array(F.coalesce(tail, F.lit(""))))


def split_runs(runs: Column | str) -> Column:
    """Pieces as (normal, bold) structs; the tail has no bold part."""
    return F.transform(
        _col(runs),
        lambda r: F.struct(
            F.get(F.split(r, r"\*\*"), F.lit(0)).alias("normal"), F.get(F.split(r, r"\*\*"), F.lit(1)).alias("bold")
        ),
    )


def forward_fill(df: DataFrame, doc: str, order: str, column: str, out: str, slices: int | None = None) -> DataFrame:
    """Last value seen so far within a document, however long it is."""
    return forward_value(df, [doc], [order], column, out, slices)


def joined_slice(text: Column | str, start: int, stop: int) -> Column:
    """Lines ``start`` to before ``stop`` (0-based) of a text, joined by line breaks."""
    lines = F.split(_col(text), "\n")
    return F.array_join(F.slice(lines, start + 1, stop - start), "\n")
