"""Benchmark items against a plain edit-distance search over whole texts, and odd tables."""

import re

from gleaner.llm.decontaminate import decontaminate, find_items

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def least_edits(item, text):
    """Edits between an item and its nearest stretch, by the plain recurrence over single words."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        ahead, row[0] = row[0], i
        for j, other in enumerate(text, 1):
            ahead, row[j] = row[j], min(ahead + (word != other), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_documents_of_the_small_table_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    known = {r.item_id: WORD.findall(r.text.lower()) for r in items.collect()}
    want = set()
    for r in docs.collect():
        words = WORD.findall((r.text or "").lower())
        here = set(words)
        for item, asked in known.items():
            if len(asked) - sum(w in here for w in asked) <= len(asked) // 5 and least_edits(asked, words) <= len(asked) // 5:
                want.add((r.doc_id, item))
    assert {(r.doc_id, r.item_id) for r in find_items(docs, items).collect()} == want


def test_odd_tables(spark):
    item = "one two three four five six seven eight nine ten"
    columns = "doc_id long, text string, item_id long, first_word int, _hit long"
    items = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, "", "x"), (None, None, "x")], "item_id long, text string, doc_id string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, "word " * 30_000 + item), (None, item), (5, "one two three")]
    docs = spark.createDataFrame([(i, t, 0, 0, i) for i, t in rows], columns)
    found = [tuple(r) for r in find_items(docs, items).collect()]
    assert len(found) == 8 and {f[0] for f in found} == {3, 4, None} and {f[2] for f in found if f[0] == 4} == {30_000}
    assert sorted(r.doc_id or 0 for r in decontaminate(docs, items).collect()) == [0, 1, 2, 5]
    assert find_items(docs.limit(0), items).count() == find_items(docs, items.limit(0)).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == len(rows)
