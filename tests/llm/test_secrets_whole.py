"""The secret scan on long texts, copies and clashing columns."""

import re

from gleaner.llm.secrets import redact, secret_digests

KEY = "Qw7aB3dE6gH9jK2mN5pQ8sT"


def test_a_key_of_one_owner_is_found_in_every_copy_and_text(spark):
    rows = [(i, f"key {KEY} here", "one") for i in range(40)] + [(100 + i, f"text {i} {KEY}", "one") for i in range(40)]
    got = {r.doc_id: r.spans for r in secret_digests(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: "key:4:27" for i in range(40)} | {100 + i: f"key:{6 + len(str(i))}:{29 + len(str(i))}" for i in range(40)}


def test_twenty_thousand_spans_in_one_text(spark):
    words = [f"{i:016x} é😀{KEY}{i % 50}," for i in range(20_000)]
    text = "start " + " ".join(words) + " end"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, "x" * 200_000, "b"), (3, None, None)], "doc_id long, text string, source string")
    found = secret_digests(df).collect()
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{16,}", text)]
    one = next(r for r in found if r.doc_id == 1)
    assert len(found) == 4 and one.n_hex == len(spans) == 20_000
    want = sorted([(a, f"hex:{a}:{b}") for a, b in spans] + [(m.start(), f"key:{m.start()}:{m.end()}") for m in re.finditer(rf"{KEY}\d+", text)])
    assert one.spans == ",".join(s for _, s in want)
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[1] == re.sub(rf"[0-9a-f]{{16,}}|{KEY}\d+", "<secret>", text) and clean[2] == "x" * 200_000 and clean[3] is None


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, f"password=abcdefghijkl{KEY} token: 0123456789abcdef", "s", "k", 1, 2, [3])]
    names = "doc_id long, text string, source string, text_key string, key int, spans int, text_cuts array<int>"
    got = redact(spark.createDataFrame(rows, names)).collect()
    assert [tuple(r) for r in got] == [(1, "<secret> <secret>", "s", "k", 1, 2, [3])]
    assert redact(spark.createDataFrame([], names)).count() == 0
    edges = [(i, "a" * n + " 0123456789abcdef" + "b" * m, "s", "", 0, 0, []) for i, (n, m) in enumerate([(0, 0), (4079, 3), (4078, 0), (4095, 9000), (8200, 0)])]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(edges, names)).collect()}
    assert got == {r[0]: re.sub("[0-9a-f]{16,}", "<secret>", r[1]) for r in edges}
