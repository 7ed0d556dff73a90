"""Encoding and decoding of whole tables against the public library."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
FOLDER = "/root/testdata/sf0.01"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_document_equals_the_library(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.token_digests(docs, PATH).collect())) == sorted(want)


def test_round_trips_of_odd_texts(spark):
    texts = [None, "", " \n", "<|endoftext|>", "x" * 30_000, "é½ \x00", "same", "same"]
    docs = spark.createDataFrame([(i, t, 7, False) for i, t in enumerate(texts)], "doc_id long, text string, ids int, round_trip boolean")
    got = bpe.encode_and_decode(docs, "text", PATH, keep=["doc_id"], compare=True).collect()
    assert all(r.round_trip for r in got) and [len(r.ids) for r in got][:2] == [0, 0]
    assert [r.decoded for r in bpe.encode_and_decode(docs, "text", PATH).collect()] == [t or "" for t in texts]


def test_the_word_table_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 2000)
    words = bpe.Vocabulary(open(PATH, encoding="utf-8").read()).words
    for i in range(100):
        words[f" word{i}"]
    assert 0 < len(words) < 12 and 0 < len(words.old) < 12 and words.held <= 2000
