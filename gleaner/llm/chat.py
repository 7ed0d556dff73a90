"""Chat formatting on token level: segments are encoded apart, reserved ids spliced in, masks made by prefix sums.

A turn is ``### role: text</turn>`` and a line end. Its ids are those of role and text, each encoded for itself, with
three reserved ids beyond the vocabulary in place of the control strings, so no content can produce one. For the
rendered form to be read back as well, a backslash goes before every backslash of role and text, before
every ``#`` that starts ``###``, before every ``<`` that starts ``</turn>``, and before every colon of a role.

Turns of a conversation are ordered by turn, then role, then ids. Null role and text count as empty, a null turn comes
first, rows with a null conv_id form one conversation, repeated rows are turns like any other. Text of any
length is taken whole. Other columns are not used, whatever their names. A conversation is never held as one row:
one row per turn carries its place among the conversation's tokens, and reading back streams over them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import SharedVocabulary, Vocabulary, id_lists, pack_ids
from gleaner.llm.common import bounded_batches, written

OPEN, BODY, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"

_TEXT_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _TEXT_CONTROL).sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def reserved(vocabulary: Vocabulary) -> tuple[int, int, int]:
    return vocabulary.size, vocabulary.size + 1, vocabulary.size + 2


def rendered(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of a turn's ids, control strings in place of reserved ids."""
    names = dict(zip(reserved(vocabulary), (OPEN, BODY, CLOSE)))
    out, run = [], []
    for i in ids:
        if i in names:
            out += vocabulary.decode(run), names[i]
            run = []
        else:
            run.append(i)
    return "".join([*out, vocabulary.decode(run)])


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a rendered conversation."""
    turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in turn.finditer(text)]


def encoded_turns(rows: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, role, ids, mask) per row; the mask is 1 on the text ids of the learned role."""
    bounded_batches(rows.sparkSession)
    shared = SharedVocabulary(rows.sparkSession, path, special=False)
    columns = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        start, body, close = (pack_ids([i]) for i in reserved(vocabulary))
        for batch in batches:
            packed, masks = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                segments = [start, vocabulary.ordinary(escape(role, role=True)), body, vocabulary.ordinary(escape(text)), close]
                # +1 where the text begins and -1 where it ends, placed by the running sum of segment lengths
                ends = np.cumsum([len(s) // 4 for s in segments])
                step = np.zeros(ends[-1] + 1, np.int8)
                if role == LEARNED:
                    step[ends[2]] += 1
                    step[ends[3]] -= 1
                packed.append(b"".join(segments))
                masks.append(np.cumsum(step[:-1], dtype=np.int8))
            ids = id_lists(packed)
            flat = pa.array(np.concatenate(masks) if masks else np.zeros(0, np.int8), pa.int8())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), ids, pa.ListArray.from_arrays(ids.offsets, flat)],
                names=["conv_id", "turn", "role", "ids", "mask"],
            )

    return columns.mapInArrow(run, "conv_id long, turn long, role string, ids array<int>, mask array<tinyint>")


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """(conv_id, place, start, ids, mask): one row per turn; ``start`` is its first token's number in the conversation."""
    turns = encoded_turns(rows, path)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return turns.select(
        "conv_id", F.row_number().over(order).cast("long").alias("place"), F.coalesce(before, F.lit(0)).cast("long").alias("start"), "ids", "mask"
    )


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame, path: str) -> DataFrame:
    """Read formatted conversations back, turn by turn: what was said, what is learned, and how long it is.

    A digest of a whole conversation can only be made in order; one task streams over its turns and holds one batch.
    """
    bounded_batches(formatted.sparkSession)
    shared = SharedVocabulary(formatted.sparkSession, path, special=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.get()
        _, body, close = reserved(vocabulary)
        current, state = None, None

        def row() -> pa.RecordBatch:
            n, said, chars, learned, length = state
            values = (current[0], n, said.hexdigest(), chars, learned.hexdigest(), length)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [c.split()[0] for c in _DIGESTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            ids, masks = batch.column(1), batch.column(2)
            flat, mask = ids.flatten().to_numpy(), masks.flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(ids).to_numpy())
            for conv, a, b in zip(batch.column(0).to_pylist(), [0, *ends[:-1]], ends):
                if current is None or current[0] != conv:
                    if current is not None:
                        yield row()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = flat[a:b]
                at = int(np.flatnonzero(tokens == body)[0])
                role, text = vocabulary.decode(tokens[1:at].tolist()), vocabulary.decode(tokens[at + 1 : -1].tolist())
                learned = unescape(vocabulary.decode(tokens[mask[a:b] == 1].tolist()))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(OPEN) + len(role) + len(BODY) + len(text) + len(CLOSE)
        if current is not None:
            yield row()

    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start", "place")
    return placed.select("conv_id", "ids", "mask").mapInArrow(run, _DIGESTS)


def chat_digests(rows: DataFrame, path: str) -> DataFrame:
    return conversation_digests(written(format_conversations(rows, path), "chat"), path)
