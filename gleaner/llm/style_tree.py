"""Main text of web pages by a site style tree: the merged DOM of a host shows which branches carry content.

Each page is read in one pass into blocks of text with the path of block elements (and their classes) above them.
Branches that say by element, class, id or role that they are menus, headers, footers, sidebars, notices, adverts, forms
or comments, and those without visible text, are cut at once; the names are whole classes or ids, html, body, main and article
are never cut by name, and a form that holds most of the page's text is the page. The rest of a host's pages is merged: a style node is
(host, path), it has the styles of its children and the contents below it, counted over distinct pages (pages that
agree in all remaining blocks count once, so copies of a page do not look like a template). With m pages at a node:

- presentation importance: entropy to base m of the distribution of child styles (1 if m = 1);
- content importance of a block found on c pages: 1 - log_m(c), of a node the mean over its distinct blocks;
- importance of a node: ``(1 - CONTENT) * presentation + CONTENT * content``.

Nodes below ``LOW``, and single blocks below it, that ``LEAST_PAGES`` or more pages show are removed from every page of the
host. What a page itself marks as its article or main part is content whatever its importance; outside it the style tree
decides, as on pages without a mark.

Null and empty html give an empty text. Pages of any length are read whole, also with tags left open or cut off. Repeated
rows come out once each. A null or unreadable URL has the empty host. Other columns are not used.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh_name, BROADCAST_ROWS, bounded_batches, written

LOW = 0.3
CONTENT = 0.9
LEAST_PAGES = 5

# fixed values: elements by their part in HTML, and usual names of page furniture
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CUT = frozenset(
    "aside button canvas dialog footer form head iframe input label menu nav noscript object select svg template textarea title".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_OWN = frozenset("p li dt dd tr td th option".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related "
    "reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: words that turn a class into a statement about furniture elsewhere, and words that may follow those of furniture
MODIFIERS = frozenset("has with without no not non is show hide hidden under above below after before per".split())
PARTS = frozenset(
    "area bar block bottom box button buttons center col column container content form group header icons inner item items left line link "
    "links list main outer panel post posts primary right row secondary section slot text title top wrap wrapper".split()
)
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HEADER = frozenset(["header"])
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _cut(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in CUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _INVISIBLE.search(attributes.get("style", "")):
        return True
    if tag in WHOLE:
        return False
    tokens = attributes.get("class", "").split() + attributes.get("id", "").split()
    if attributes.get("role", "").lower() in ROLES or any(_named(x, FURNITURE) for x in tokens):
        return True
    return not in_article and any(_named(x, HEADER) for x in tokens)


def _named(token: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id names one of ``words``: by itself, at its end, or before words for a part or place."""
    parts = [x.lower() for x in _NAME.findall(token)]
    if token.lower() in words or not parts or not MODIFIERS.isdisjoint(parts):
        return token.lower() in words
    return parts[-1] in words or (parts[0] in words and all(x in PARTS or x in words for x in parts[1:]))


class Page:
    """Blocks (path, text, in the marked article) and the child styles of every path of one page."""

    def __init__(self, source: str, shown_forms: frozenset[int] = frozenset()):
        forms, form_chars = 0, {}  # forms so far; characters in each form that is cut
        self.blocks: list[tuple[str, str, bool]] = []
        self.styles: dict[str, list[str]] = {}
        stack: list[tuple[str, str, int, bool]] = []  # element, path, cut (a form's number, else -1; 0: shown), in the article
        run: list[str] = []

        def flush() -> None:
            if run:
                text = "".join(run)
                if "&" in text:
                    text = entities.unescape(text)
                if text := " ".join(text.split()):
                    self.blocks.append((stack[-1][1] if stack else "", text, bool(stack) and stack[-1][3]))
                run.clear()

        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            token = _TOKEN.match(source, lt) if lt >= 0 else None
            if lt >= 0 and token is None:  # a bare "<" is text
                lt, stop = lt + 1, lt + 1
            else:
                lt, stop = (end, end) if lt < 0 else (lt, token.end())
            if lt > at and not (stack and stack[-1][2]):
                run.append(source[at:lt])
            elif lt > at and stack[-1][2] > 0:
                form_chars[stack[-1][2]] = form_chars.get(stack[-1][2], 0) + len(source[at:lt].strip())
            at = stop
            if token is None or not token.group(2):
                continue
            tag = token.group(2).lower()
            if not token.group(1) and tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = close.start() if close else end
                if tag not in BLOCK:
                    continue
            if tag == "br":
                run.append(" ")
            if tag in VOID and tag != "hr":
                continue
            if tag not in BLOCK and tag not in CUT and "=" not in token.group(3) and "hidden" not in token.group(3).lower():
                continue
            if token.group(1):
                if any(s[0] == tag for s in stack):
                    if tag in BLOCK:
                        flush()
                    while stack.pop()[0] != tag:
                        pass
                continue
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token.group(3)) if m[1]} if "=" in token.group(3) or "hidden" in token.group(3).lower() else {}
            parent = stack[-1] if stack else ("", "", 0, False)
            cut = -1 if parent[2] < 0 or _cut(tag, attributes, parent[3]) else parent[2]
            if tag == "form":
                forms += 1
                if parent[2] >= 0 and not _cut("div", attributes, parent[3]):
                    cut = parent[2] or (0 if forms in shown_forms else forms)
            if tag not in BLOCK and not cut:
                continue  # an inline element that is shown
            if tag in BLOCK:
                flush()
            if tag == "hr":
                continue
            if tag in CLOSED_BY_OWN:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        del stack[depth:]
                        break
                    if stack[depth][0] not in CLOSED_BY_OWN:
                        break
                parent = stack[-1] if stack else ("", "", 0, False)
                cut = -1 if parent[2] < 0 or _cut(tag, attributes, parent[3]) else parent[2]
            style = f"{tag}.{attributes['class']}" if attributes.get("class") else tag
            path = f"{parent[1]}/{style}"
            self.styles.setdefault(parent[1], []).append(style)
            marked = parent[3] or (not cut and (tag in ("article", "main") or attributes.get("role") == "main"))
            stack.append((tag, path, cut, marked))
        flush()
        largest = max(form_chars, key=form_chars.get, default=0)
        if largest and 2 * form_chars[largest] > sum(form_chars.values()) + sum(len(t) for _, t, _ in self.blocks):
            self.__init__(source, shown_forms | {largest})

    def text(self, low: set[tuple[int, int | None]]) -> str:
        kept = []
        for path, t, marked in self.blocks:
            number = _number(path)
            if marked or ((number, None) not in low and (number, _number(t)) not in low):
                kept.append(t)
        return "\n\n".join(kept)


def host_of(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_NODES = "host string, path long, text boolean, item long, page long"


def style_nodes(pages: DataFrame) -> DataFrame:
    """Per page: one row for the child styles of each path and one for each block of text."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("text", pa.bool_()), ("item", pa.int64()), ("page", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "")
                signature = _number("\n".join(t for _, t, _ in page.blocks))
                texts: dict[str, set[str]] = {}
                for path, text, _ in page.blocks:
                    texts.setdefault(path, set()).add(text)
                for path, found in texts.items():
                    number = _number(path)
                    rows.append((host, number, False, _number(" ".join(page.styles.get(path, ()))), signature))
                    rows += [(host, number, True, _number(t), signature) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, schema)], schema=schema)

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, _NODES)


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, path, item): style nodes (null item) and single blocks of low importance."""
    counted = style_nodes(pages).distinct().groupBy("host", "path", "text", "item").agg(F.count(F.lit(1)).alias("c"))
    counted = written(counted, "style-tree")
    shown = counted.filter("not text").groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    shown = shown.filter(F.col("m") >= LEAST_PAGES)
    # entropy to base m of shares c / m
    presentation = (F.log("m") - F.col("s") / F.col("m")) / F.log("m")
    importance = 1 - F.log(F.least("c", "m").cast("double")) / F.log(F.col("m").cast("double"))
    # blocks enter by how many pages show them: a node has few such numbers, however many blocks it has
    numbers = counted.filter("text").groupBy("host", "path", "c").agg(F.count(F.lit(1)).alias("n")).join(shown.select("host", "path", "m"), ["host", "path"])
    content = numbers.groupBy("host", "path").agg((F.sum(F.col("n") * importance) / F.sum("n")).alias("content"))
    nodes = shown.join(content, ["host", "path"]).filter((1 - CONTENT) * presentation + CONTENT * F.col("content") < LOW)
    repeated = counted.filter(F.col("text") & (F.col("c") >= LEAST_PAGES)).join(shown.select("host", "path", "m"), ["host", "path"])
    single = repeated.filter(importance < LOW).select("host", "path", "item")
    return nodes.select("host", "path", F.lit(None).cast("long").alias("item")).union(single)


def main_texts(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` with ``text``, the main text of each page."""
    low = written(low_branches(pages), "low-branches")
    host, branches = fresh_name(pages, "host_of_page"), fresh_name(pages, "low_branches")
    by_host = low.groupBy(F.col("host").alias(host)).agg(F.collect_list(F.struct("path", "item")).alias(branches))
    if low.count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    kept = [c for c in (keep or ["page_id", "url"]) if c != "text"]
    rows = pages.withColumn(host, host_of("url")).join(by_host, host, "left")
    fields = [pages.schema[c] for c in kept]
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, low_here in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = {(x["path"], x["item"]) for x in low_here or ()}
                texts.append(Page(html or "").text(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i + 2) for i in range(len(kept))] + [pa.array(texts, pa.string())], names=kept + ["text"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"
    return rows.select("html", branches, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    return main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))
