"""Inputs on which an operator once did less than its whole job."""

import numpy as np

from gleaner.llm import decontaminate, minhash, style_tree
from gleaner.llm.secrets import redact


def test_every_two_classes_of_a_dense_region_meet(spark):
    draw = np.random.default_rng(5)
    size = 2 * minhash.REGION + 1500
    low = draw.integers(0, 256, (size, minhash.COMPARED), dtype=np.uint8)
    planted = [(i, size - 1 - i) for i in range(20)]  # far apart in the sorted order
    for a, b in planted:
        low[b, :52] = low[a, :52]
    rows = [(0, 77, i.to_bytes(8, "big"), i, 100, low[i].tobytes()) for i in range(size)]
    found = minhash.candidate_pairs(spark.createDataFrame(rows, minhash._FOREST))
    assert {(r.a, r.b) for r in found.filter("a is not null").collect()} == set(planted)


def test_long_items_with_a_fifth_of_their_words_changed_are_all_found():
    draw = np.random.default_rng(8)
    for m in (15, 38, 60, 120, 250):
        items = [[f"i{n}w{j}" for j in range(m)] for n in range(25)]
        index = decontaminate.ItemIndex([(n, " ".join(words).encode()) for n, words in enumerate(items)])
        for n, words in enumerate(items):
            gone = set(draw.choice(np.arange(1, m - 1), decontaminate.allowed(m), replace=False).tolist())
            for text in ([w for j, w in enumerate(words) if j not in gone], ["new" if j in gone else w for j, w in enumerate(words)]):
                around = ["before"] * 30 + text + ["after"] * 30
                got = decontaminate.matches(index, " ".join(around).encode())
                assert [x[0] for x in got] == [n] and got[0][3] <= decontaminate.allowed(m), (m, n)


def test_walks_alone_reach_their_target():
    draw = np.random.default_rng(31)
    for m in (7, 15, 38, 60, 120, 250):
        items = [[f"i{n}w{j}" for j in range(m)] for n in range(200)]
        index = decontaminate.ItemIndex([(n, " ".join(words).encode()) for n, words in enumerate(items)])
        k, found = decontaminate.allowed(m), 0
        for n, words in enumerate(items):
            gone = set(draw.choice(m, k, replace=False).tolist())
            text = ["before"] * 30 + [w for j, w in enumerate(words) if j not in gone] + ["after"] * 30
            text = decontaminate.word_hashes(" ".join(text).encode(), decontaminate.LETTERS)
            places = [a for i, a in index.candidates(text) if i == n]
            found += any(decontaminate.best_stretch(index.words[n], text[max(0, a - k) : a + m + k])[0] <= k for a in places)
        assert found >= 190, (m, found)


def test_some_piece_of_an_item_keeps_its_share_of_the_edits():
    for m in range(decontaminate.LEAST_WORDS, 700):
        sizes = [b - a for a, b in decontaminate.pieces(m)]
        assert sum(sizes) == m and max(sizes) <= decontaminate.PIECE and (len(sizes) == 1 or min(sizes) >= decontaminate.PIECE // 2)
        assert sum(decontaminate.allowed(x) + 1 for x in sizes) > decontaminate.allowed(m)


def test_short_items_are_searched_with_the_edits_they_allow():
    texts = ["one two three four five", "red blue green", "alone"]
    index = decontaminate.ItemIndex(list(enumerate(t.encode() for t in texts)))
    got = decontaminate.matches(index, b"x one two drei four five y red blue green z red blue grey alone one two drei vier five")
    assert got == [(0, 1, 5, 1), (1, 7, 9, 0), (2, 14, 14, 0)]
    assert decontaminate.matches(index, b"") == []


def test_content_whose_attributes_only_mention_furniture_stays():
    for tag in (
        'body class="has-sidebar"', 'main class="content-with-sidebar"', 'article class="post no-comments"', 'p class="ad-hoc"', 'div class="overflow-hidden"',
        'div class="md:hidden lg:block"', 'div data-x="not hidden"', 'body class="widget"', 'form action="/page.aspx"', 'body style="visibility: hidden"',
    ):
        assert style_tree.Page(f"<html><{tag}>The story of the page").text(set()) == "The story of the page", tag
    for tag in ('div class="site-footer"', "div hidden", "span hidden", 'div class="x comments-area"', 'div id="sidebarLeft"', 'form action="/s"', "article hidden"):
        close = tag.split()[0]
        assert style_tree.Page(f"<p>A long enough story<{tag}>gone</{close}>").text(set()) == "A long enough story", tag


def test_style_tree_decides_outside_the_marked_part(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<div class=top>Same on all</div><div class=body>Story {i}</div><article>Card {i}</article>") for i in range(20)
    ]
    got = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\n\nCard {i}" for i in range(20)}


def test_a_key_of_one_owner_is_redacted_in_every_copy(spark):
    rows = [(i, "key Qw7aB3dE6gH9jK2mN5pQ8sT here", "one") for i in range(40)]
    cleaned = redact(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [r.text for r in cleaned.collect()] == ["key <secret> here"] * 40
