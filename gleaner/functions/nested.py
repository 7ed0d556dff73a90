"""Markdown from nested markup, parsed per page in Arrow batches; the native form is in ``markup``."""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = ("script", "style", "title")
BLOCKS = ("p", "div", "article", "section", "ul", "ol", "nav", "footer", "header", "table", "tr")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.links, self.skip = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in MARKS:
            self.out.append(MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = "*"
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}."
            self.out.append("\n" + "\t" * depth + mark + " ")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in BLOCKS:
            nested = bool(self.lists) and tag in ("ul", "ol")
            self.out.append("" if nested else "\n\n")
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(self.skip - 1, 0)
        elif tag in MARKS:
            self.out.append(MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("" if self.lists else "\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def _markdown(html: str | None) -> str | None:
    if html is None:
        return None
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = re.sub(r"\n +", "\n", "".join(writer.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(StringType())
def html_to_markdown_nested(html: pd.Series) -> pd.Series:
    return html.map(_markdown, na_action="ignore")


# sent to executors by value, so that they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
