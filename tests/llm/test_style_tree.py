"""Main text of pages: hand-written pages, the shared template of a host, broken markup."""

import html as entities
import re

from gleaner.llm.style_tree import Page, main_texts

SCHEMA = "page_id long, url string, html string, extra string"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r.page_id: r.text for r in main_texts(df).collect()}


def test_article_without_furniture():
    page = Page(
        "<body><header>Top</header><nav><li>Menu</li></nav><article><h1>A &amp; B</h1><p>one\n  two<br>three"
        '<p>four <b>five</b><div class="comments"><p>hi</p></div></article><footer>&copy;</footer><script>var a="<p>";</script>'
    )
    assert page.text(set()) == "A & B\n\none two three\n\nfour five"


def test_template_of_a_host_goes_and_content_stays(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=x>Same on all</div><div class=y>Own words {i}</div>") for i in range(20)]
    rows += [(100 + i, f"http://solo{i}.example/", "<div class=x>Same on all</div>") for i in range(3)]
    got = texts(spark, rows)
    assert got[3] == "Own words 3"
    assert got[101] == "Same on all"


def test_copies_of_one_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", "<p>One story</p><p>told often</p>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"One story\n\ntold often"}


def test_marked_article_stays_though_repeated(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>Shared words</p><p>Own {i}</p></article>") for i in range(12)]
    assert texts(spark, rows)[0] == "Shared words\n\nOwn 0"


def test_nulls_empty_and_broken(spark):
    rows = [(1, None, None), (2, "::bad", ""), (None, "http://h/", "a < b &lt; c &unknown; &#8217;"), (4, "http://h/", "<p>open <b>x<div>y"),
            (5, "http://h/", "<!-- never closed <p>x"), (6, "http://h/", "<script>x"), (7, "http://h/", "<p class=ad hidden>no</p>yes"),
            (8, "http://h/", "<a " + "x" * 50_000)]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[5] == got[6] == got[8] == ""
    assert got[None] == "a < b < c &unknown; ’"
    assert got[4] == "open x\n\ny" and got[7] == "yes"


def test_empty_table(spark):
    assert texts(spark, []) == {}


def test_table_pages_against_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)
