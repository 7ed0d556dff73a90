"""Byte-pair encoding and decoding with a public byte-level vocabulary.

A short word is held as a contiguous array of part boundaries with the rank of each adjacent pair: scan for
the smallest rank, delete that boundary, refresh the two neighbouring ranks, until no pair has a rank. A
word of more than ``SHORT`` bytes, where repeated scans would be quadratic, keeps the same pairs in a heap.

Null texts count as empty, empty texts have no ids, texts of any length are encoded whole. Repeated rows are
encoded each for itself. Other columns are carried, except one that has the name of a result column, which
is replaced. Ids outside the vocabulary, and null id arrays, decode to nothing.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bounded_batches, map_batches

SHORT = 160
#: bytes of words, ids and table entries that one generation of the word table may hold
CACHED_BYTES = 24 << 20
ENTRY_BYTES = 200
NO_RANK = 1 << 40
# fixed value: the published split pattern of the vocabulary
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for texts in which letters and digits are all that ``\w`` takes in; the standard engine is twice as fast
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNSETTLED = r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0530-\U0010ffff]"
#: below this code point every Unicode version puts each character into the same class
SETTLED = 0x530


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks, pieces and special tokens of a tokenizer file, ready to encode and decode."""

    def __init__(self, source: str, special: bool = True):
        spec = json.loads(source)
        back = _byte_chars()
        ids = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.piece = {i: token for token, i in ids.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(self.piece) + 1
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: rank by pair of ids (left << 20 | right), and the id that each rank makes
        self.rank: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(back[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[ids[left] << 20 | ids[right]] = rank
            self.makes.append(ids[left + right])
        self.split = regex.compile(SPLIT)
        self.plain_split = re.compile(PLAIN_SPLIT)
        self.unsettled = re.compile(UNSETTLED)
        self.beyond = re.compile(f"[{chr(SETTLED)}-{chr(0x10FFFF)}]")
        self.control = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.alike: dict[str, bool] = {}
        self.words = _Words(self)
        self._library = None

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        """``parts[i]`` begins at boundary i; dropping a boundary joins its two neighbours into one part."""
        rank, makes = self.rank.get, self.makes
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            del parts[i + 1], ranks[i]
            joined = parts[i] = makes[low]
            if i < len(ranks):
                ranks[i] = rank(joined << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | joined, NO_RANK)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], NO_RANK)) < NO_RANK]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            low, i = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or rank(parts[i] << 20 | parts[j]) != low:
                continue
            gone[j] = 1
            parts[i] = self.makes[low]
            after[i] = after[j]
            before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (k := after[left]) < n and (r := rank(parts[left] << 20 | parts[k], NO_RANK)) < NO_RANK:
                    heapq.heappush(heap, (r, left))
        return [p for p, lost in zip(parts, gone) if not lost]

    def _as_library(self, char: str) -> bool:
        """Whether this build's pattern engine puts a character into the class that the library gives it."""
        if char not in self.alike:
            probe = f"a{char}1 {char}{char} b"
            self.alike[char] = self.split.findall(probe) == self._library_split(probe)
        return self.alike[char]

    def _library_split(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        if not self.unsettled.search(text):
            return self.plain_split.findall(text)
        if all(map(self._as_library, set(self.beyond.findall(text)))):
            return self.split.findall(text)
        return self._library_split(text)

    def ordinary(self, text: str) -> bytes:
        """Ids, as packed 32-bit integers, of a text whose control strings, if any, are plain characters."""
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def packed(self, text: str) -> bytes:
        if not self.control or not self.control.search(text):
            return self.ordinary(text)
        out, at = [], 0
        for m in self.control.finditer(text):
            out += self.ordinary(text[at : m.start()]), pack_ids([self.special[m.group()]])
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])

    def encode(self, text: str) -> list[int]:
        return unpack_ids(self.packed(text))

    def decode(self, ids: list[int]) -> str:
        piece = self.piece
        return b"".join([piece.get(i, b"") for i in ids]).decode("utf-8", "replace")


def pack_ids(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def unpack_ids(packed: bytes) -> list[int]:
    return array("i", packed).tolist()


class _Words(dict):
    """Packed ids by word in two generations, each bounded in bytes: when the young one is full it becomes the old
    one, so frequent words stay known."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old, self.held = vocabulary, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = pack_ids(self.vocabulary.merge(word.encode()))
            if len(word) > SHORT:
                return ids
        size = ENTRY_BYTES + 4 * len(word) + len(ids)
        if self.held + size > CACHED_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        self[word] = ids
        self.held += size
        return ids


_loaded: dict[tuple[int, bool], Vocabulary] = {}


class SharedVocabulary:
    """A tokenizer file read once on the driver and shipped to the workers; its size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            self.source = spark.sparkContext.broadcast(f.read())
        self.special = special

    def __getstate__(self) -> dict:
        return self.__dict__

    def get(self) -> Vocabulary:
        text = self.source.value
        key = (hash(text), self.special)
        if key not in _loaded:
            _loaded[key] = Vocabulary(text, self.special)
            gc.freeze()  # the tables live as long as the worker: no collection needs to walk them
        return _loaded[key]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encode_texts(df: DataFrame, text: str, path: str, special: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids``, the token ids of each whole text. ``special=False`` takes control strings as plain text."""
    shared = SharedVocabulary(df.sparkSession, path, special)

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        vocabulary = shared.get()
        return {"ids": id_lists([vocabulary.packed(t.decode("utf-8", "replace")) for t in texts])}

    return map_batches(df, text, run, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), keep)


def decode_ids(df: DataFrame, ids: str, path: str) -> DataFrame:
    """``df`` with ``decoded``, the text of each id array; invalid UTF-8 becomes U+FFFD."""
    bounded_batches(df.sparkSession)
    shared = SharedVocabulary(df.sparkSession, path)
    kept = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        for batch in batches:
            lists = batch.column(kept.index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null lists have no elements
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            texts = pa.array([vocabulary.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [texts], names=kept + ["decoded"])

    return df.select(*kept).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, text: str, path: str, keep: list[str] | None = None, compare: bool = False) -> DataFrame:
    """``df`` with ``ids`` and the text they ``decoded`` to, by one worker with one vocabulary.

    With ``compare`` there is ``round_trip`` in place of the decoded text: whether it is the given one.
    """
    shared = SharedVocabulary(df.sparkSession, path)
    back = T.StructField("round_trip", T.BooleanType()) if compare else T.StructField("decoded", T.StringType())

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        vocabulary = shared.get()
        packed = [vocabulary.packed(t.decode("utf-8", "replace")) for t in texts]
        decoded = (vocabulary.decode(unpack_ids(p)) for p in packed)
        if compare:
            return {"ids": id_lists(packed), "round_trip": pa.array([d.encode() == t for d, t in zip(decoded, texts)], pa.bool_())}
        return {"ids": id_lists(packed), "decoded": pa.array(decoded, pa.string())}

    return map_batches(df, text, run, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), back]), keep)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text."""
    coded = encode_and_decode(docs, "text", path, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
