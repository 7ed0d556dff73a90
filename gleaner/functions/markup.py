"""Values out of page markup, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def script_text(html: Column | str, script_id: str | None = "__NEXT_DATA__") -> Column:
    """Text of the first script with this id (or of any script); null when the page has none."""
    tag = f'<script[^>]*\\bid=["\']{script_id}["\'][^>]*>' if script_id else "<script[^>]*>"
    found = F.regexp_extract_all(_col(html), F.lit(f"(?s){tag}(.*?)</script>"), 1)
    return F.get(found, F.lit(0))


def page_title(html: Column | str) -> Column:
    found = F.regexp_extract_all(_col(html), F.lit("(?s)<title[^>]*>(.*?)</title>"), 1)
    return F.get(found, F.lit(0))


def is_company_page(html: Column | str, mark: str = "(N=") -> Column:
    """A listing of one company: it has a title, and the title lacks the count mark of a search."""
    title = page_title(html)
    return F.coalesce(~F.contains(title, F.lit(mark)), F.lit(False))


def key_from_url(url: Column | str) -> Column:
    return F.substring_index(_col(url), "/", -1)


def query_field(url: Column | str, field: str) -> Column:
    """A field of the query part, as written; null when absent."""
    found = F.regexp_extract_all(_col(url), F.lit(rf"[?&]{field}=([^&#]*)"), 1)
    return F.get(found, F.lit(0))


def company_key(href: Column | str) -> Column:
    """Company key of a listing link ``/?company=key&...``."""
    return F.regexp_extract(_col(href), r"^(?:/\?company=)?([^&]*)", 1)


# Markup to Markdown rules, applied in order.
MARKDOWN_RULES = [
    (r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>", ""),
    (r"\s+", " "),
    (r"(?i)<h([1-6])(?:\s[^>]*)?> *", "\n\n<#$1>"),
    (r"(?i)</?(?:p|ul|ol|div|article|section|nav|footer|header|table|tr|body|h[1-6])(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)<li(?:\s[^>]*)?>\s*", "\n* "),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"(?i) *<br\s*/?> *", "  \n"),
    (r"<[^#>][^>]*>", ""),
]
HEADING_MARKS = [(f"<#{n}>", "#" * n + " ") for n in range(1, 7)]
# Named characters, the ampersand last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&amp;", "&"),
]


def html_to_markdown(html: Column | str) -> Column:
    """Headings, paragraphs, breaks, bold, italics, list items and links as Markdown; other tags go.

    Every tag maps to its mark on its own, so nesting needs no parser: nested lists come out flat, numbered ones as
    bullets, and only the characters of ``ENTITIES`` are decoded. It is for quick native text. ``functions.nested``,
    which the standing jobs use, keeps depth and numbers and decodes all, in Arrow batches.
    """
    text = reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), MARKDOWN_RULES, _col(html))
    text = reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), HEADING_MARKS + ENTITIES, text)
    return F.trim(text, F.lit(" \n"))


def span_texts(fragment: Column | str, tag: str = "span") -> Column:
    """Trimmed text of every ``tag`` in a piece of markup, in order."""
    texts = F.regexp_extract_all(_col(fragment), F.lit(f"<{tag}(?:\\s[^>]*)?>([^<]+)"), 1)
    return F.transform(texts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def hrefs(fragment: Column | str) -> Column:
    return F.regexp_extract_all(_col(fragment), F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
