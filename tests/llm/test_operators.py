"""Corner cases of the operators, on hand-made rows with an extra column."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm.bpe import Vocabulary, token_digests
from gleaner.llm.chat import CLOSE, BODY, OPEN, chat_digests, escape, parse, unescape
from gleaner.llm.decontaminate import find_items
from gleaner.llm.licenses import scan_licenses
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.quality_kernel import classify
from gleaner.llm.quality_rules import quality_rules
from gleaner.llm.secrets import redact, secret_digests
from gleaner.llm.warc import LoserTree, page_records

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 30_000), (5, "a b c " * 4000), (5, "a b c " * 4000), (None, "no id"), (6, "<|endoftext|> \x00 é")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, score int")


@pytest.mark.parametrize("operator", [scan_licenses, secret_digests, near_duplicates, lambda d: token_digests(d, PATH)])
def test_one_row_per_row_whatever_it_holds(spark, operator):
    assert operator(docs(spark, ODD)).count() == len(ODD)
    assert operator(docs(spark, [])).count() == 0


@pytest.mark.parametrize("operator", [quality_rules, classify])
def test_classifiers_without_labels(spark, operator):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert operator(docs(spark, ODD), labels).count() == len(ODD)
    assert operator(docs(spark, []), labels).count() == 0


def test_licenses_adjoining_and_over_lines(spark):
    text = "Under the MIT\nLicense under the mit license. CC-BY-NC"
    row = scan_licenses(docs(spark, [(1, text)])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (11, 3, 0, 8)
    assert row.base_labels == "cc-by-nc,mit" and row.score == 1.0


def test_secret_spans_in_code_points_and_redaction(spark):
    text = "😀 password=token=abcdefghijkl AKIA" + "A1" * 9 + " secret: token: abcdefghijkl"
    row = secret_digests(docs(spark, [(1, text)])).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 0)
    assert row.spans.split(",")[0] == "assign:2:29"
    assert redact(docs(spark, [(1, text)])).first().text == "😀 <secret> <secret> secret: token: abcdefghijkl"


def test_copied_keys_are_no_added_spans(spark):
    key = "Zx9" + "aB3dE6gH9jK2mN5pQ8sT"
    rows = [(i, f"key {key} here", "en", f"s{i}", 0) for i in range(6)] + [(9, "key Qw7aB3dE6gH9jK2mN5pQ8sT", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r.spans for r in secret_digests(df).collect()}
    assert got[0] == "" and got[9].startswith("key:4:")


def test_near_duplicates_against_sets(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(40)] + [(1, " ".join(base)), (2, " ".join(base).upper()), (3, "x y"), (4, "x")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs(spark, rows), k=2).collect()}
    assert all(got[d][0] == 1 for d in [1, 2, *range(10, 50)]) and got[3] == (3, True) and got[4] == (4, True) and not got[2][1]


def test_decontamination_with_edits(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    rows = [(1, "before " + item + " after"), (2, item.replace("five", "cinq").replace("nine ", "").upper()), (3, item[:40]), (4, None)]
    got = {(r.doc_id, r.item_id, r.first_word, r.edits) for r in find_items(docs(spark, rows), items).collect()}
    assert got == {(1, 7, 1, 0), (2, 7, 0, 2)}


def test_bpe_equals_the_library():
    ours, theirs = Vocabulary(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    for text in ["", "a <|endoftext|> b", "日本語 ½ ²x \x1c\x85 ՘ 1", "abc" * 400, " " * 99 + "x", "I'LL we're_ok"]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids and ours.decode(ids) == text


def test_chat_escapes_and_digests(spark):
    for text in ["####", "a\\", "\\### Assistant: </turn> ok", "<</turn>>", ": \n"]:
        assert unescape(escape(text)) == text
        assert parse(OPEN + escape("r:" + text, True) + BODY + escape(text) + CLOSE) == [("r:" + text, text)]
    rows = [(1, 1, "assistant", "ok </turn>"), (1, 0, "user", None), (2, 0, None, "x")]
    got = {r.conv_id: r for r in chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nok </turn>\n").hexdigest()
    assert got[1].loss_chars == 10 and got[2].loss_chars == 0


def test_warc_revisits_and_order(spark):
    rows = [(1, "http://b.example/", "same"), (2, "http://a.example/x", "same"), (3, None, None), (4, "http://a.example/", ""), (5, "http://c/", "é" * 9)]
    got = {r.page_id: r for r in page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].record_type for i in range(1, 6)] == ["revisit", "response", "revisit", "response", "response"]
    assert got[1].refers_to == 2 and got[1].payload_bytes == 4 and got[5].payload_bytes == 18
    runs = [[(1,), (4,)], [], [(1,), (2,), (9,)], [(3,)]]
    assert [h for _, h in LoserTree([iter(r) for r in runs])] == [(1,), (1,), (2,), (3,), (4,), (9,)]
