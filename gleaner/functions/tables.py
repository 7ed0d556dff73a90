"""Table functions: one page in, many rows out."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

LINK = StructType([
    StructField("card", IntegerType()), StructField("href", StringType()), StructField("label", StringType()),
])


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.links.append((self.href, "".join(self.text).strip()))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)


@udtf(returnType=LINK)
class PageLinks:
    """Links of a page in order, for markup too irregular for ``operators.cards.card_rows``."""

    def eval(self, html: str):
        parser = _Links()
        parser.feed(html or "")
        for i, (href, label) in enumerate(parser.links):
            yield i, href, label


# sent to executors by value, so that they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
