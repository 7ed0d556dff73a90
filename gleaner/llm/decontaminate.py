"""Benchmark decontamination: edit distance to Hamming distance by random walks, bit-sampling, exact verification.

Texts and items are sequences of words (ASCII letters, digits and characters beyond ASCII), all in lower case. An item of
m words is found where a stretch of a text lies within ``floor(EDIT_SHARE * m)`` word edits of it.

0. The distance between walks grows about with the square of the edits, so items of more than ``PIECE`` words are searched by
   pieces of like size: if every piece had more than its share of edits, the item would have more than its own, so some piece
   of every match is within its share.
1. A stretch within k edits of m words shares at least m - 2 - 3k of their 3-word runs. Starts of windows ahead of which
   fewer runs of pieces of one size class stand, by the least such number in the class, cannot match; where that number is
   below 1 (items of five words), the walks leave windows without a common run to step 5.
2. From every remaining start a CGK walk reads the words: at each step it writes the word at its pointer, then moves on or
   stays, as a random bit of (step, word) says. Few edits between two sequences become few differing places.
   Independent walks are made for windows and pieces alike.
3. Each walk is sampled at ``BITS`` places, ``SAMPLES`` times for every size class; a window and a piece with equal samples are
   a candidate. Places lie within what a walk over the smallest piece of the class writes. A class has as many walks as
   find a share of ``TARGET`` of simulated matches, each as far away as allowed and all by left-out words, which part
   walks soonest; ``MOST_WALKS`` at most, which only the smallest items need.
4. Candidates are verified by the exact edit distance of the item to its best stretch around the window.
5. Sampling may still miss a match. So the runs are also counted item by item: where the least number
   of an item's own runs stands within the words that a match may span, and no match found so far, the exact edit distance
   decides. Runs have as many words, 3, 2 or 1, as leave a bound of at least 1, so every match has such a place: with this
   step the recall is 1, whatever the samples. Items of fewer than ``LEAST_WORDS`` words are searched in this way only.

Items are taken in blocks of ``BLOCK`` rows or ``BLOCK_BYTES`` of text, whichever comes first, whose tables go to the workers, each against all texts. Items
without words, null ones included, are found nowhere. Null and empty texts have no match; texts of any length are read whole. Repeated rows and repeated items have a match each; a null id is
carried. Other columns are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LETTERS, bounded_batches, mixed, run_hashes, small_side, word_hashes

EDIT_SHARE = 0.2
LEAST_WORDS = 5
RUN = 3
PIECE = 24
TARGET = 0.95
TRIALS = 500
MOST_WALKS = 16
SAMPLES = 8
BITS = 4
CLASS_RATIO = 1.25
READ_SHARE = 1.6
BLOCK = 5000
BLOCK_BYTES = 8 << 20
STARTS_AT_ONCE = 1 << 15
POSTINGS_AT_ONCE = 1 << 20

_random = np.random.default_rng(771)
_SEEDS = _random.integers(1, 1 << 63, MOST_WALKS, dtype=np.uint64)


def allowed(m: int) -> int:
    return int(EDIT_SHARE * m + 1e-9)


def least_shared(m: int, run: int = RUN) -> int:
    """Runs of an item of ``m`` words that every match shares: an edit touches ``run`` of them at most."""
    return m - run + 1 - run * allowed(m)


def run_length(m: int) -> int:
    """The longest run, up to ``RUN`` words, of which a match of an item of ``m`` words must share one."""
    return next(r for r in range(RUN, 0, -1) if least_shared(m, r) >= 1)


def walk_symbols(words: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The embedding of the sequences that begin at ``starts``: one row each, ``steps`` symbols; 0 past the end."""
    padded = np.append(words, np.uint64(0))
    at = starts.copy()
    out = np.empty((len(starts), steps), np.uint64)
    for j in range(steps):
        if j % 64 == 0:
            coins = mixed(padded ^ (_SEEDS[walk] + np.uint64(j)))
        out[:, j] = padded[at]
        at = np.minimum(at + ((coins[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), len(words))
    return out


def _keys(symbols: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    key = np.full(len(symbols), np.uint64(salt))
    for p in places:
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + symbols[:, p])
    return key


def pieces(m: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces by which an item of ``m`` words is searched."""
    cuts = np.linspace(0, m, -(-m // PIECE) + 1).round().astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def _simulated(m: int, steps: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``TRIALS`` sequences of ``m`` words and as many with the allowed edits, a row each, other words behind them."""
    items = draw.integers(1, 1 << 63, (TRIALS, m + steps), dtype=np.uint64)
    order = np.argsort(draw.random((TRIALS, m)), axis=1)
    kept = np.sort(order[:, allowed(m) :], axis=1)
    behind = draw.integers(1, 1 << 63, (TRIALS, allowed(m) + steps), dtype=np.uint64)
    return items, np.concatenate([np.take_along_axis(items, kept, axis=1), behind], axis=1)


@lru_cache(maxsize=256)
def sampled_walks(sizes: tuple[int, ...]) -> list[list[np.ndarray]]:
    """The places of each sample of each walk: as many walks as find ``TARGET`` of the matches of every one of ``sizes``."""
    draw = np.random.default_rng([90, *sizes])
    reach = max(BITS, int(READ_SHARE * min(sizes)))
    trials = [_simulated(m, reach, draw) for m in sizes]
    starts = [np.arange(TRIALS) * items.shape[1] for items, _ in trials]
    found = np.zeros((len(sizes), TRIALS), bool)
    walks: list[list[np.ndarray]] = []
    while len(walks) < MOST_WALKS and found.mean(axis=1).min() < TARGET:
        walks.append([np.sort(draw.choice(reach, BITS, replace=False)) for _ in range(SAMPLES)])
        for n, (items, edited) in enumerate(trials):
            same = walk_symbols(items.ravel(), starts[n], len(walks) - 1, reach) == walk_symbols(edited.ravel(), starts[n], len(walks) - 1, reach)
            for places in walks[-1]:
                found[n] |= same[:, places].all(axis=1)
    return walks


@dataclass
class SizeClass:
    """Pieces of like size: where their windows may start, and their sampled walks."""

    longest: int  # words that a match may span
    least_runs: int  # runs that every match shares
    steps: int
    walks: int
    tables: list[tuple[int, np.ndarray, int, np.ndarray, np.ndarray]]  # walk, places, salt, sorted keys, pieces in that order


class ItemIndex:
    """Sampled walks of a block of items, by size class."""

    def __init__(self, items: list[tuple[int, bytes]]):
        sized = [(i, w) for i, t in items if len(w := word_hashes(t, LETTERS))]
        self.ids = [i for i, _ in sized]
        self.words = [w for _, w in sized]
        #: item, first word and end of each piece
        self.pieces = [(n, a, b) for n, w in enumerate(self.words) if len(w) >= LEAST_WORDS for a, b in pieces(len(w))]
        members: dict[int, list[int]] = {}
        for p, (_, a, b) in enumerate(self.pieces):
            members.setdefault(int(np.log(b - a) / np.log(CLASS_RATIO)), []).append(p)
        self.classes = [self._size_class(number, group) for number, group in enumerate(map(members.get, sorted(members)))]
        owner: dict[int, int] = {}
        for number, group in enumerate(map(members.get, sorted(members))):
            for n, a, b in map(self.pieces.__getitem__, group):
                for run in run_hashes(self.words[n][a:b], RUN).tolist():
                    owner[run] = owner.get(run, 0) | 1 << number
        self.runs = np.array(sorted(owner), np.uint64)
        self.owners = np.array([owner[r] for r in self.runs.tolist()], np.int64)
        self.span = np.array([len(w) + allowed(len(w)) for w in self.words], np.int64)
        lengths = [run_length(len(w)) for w in self.words]
        self.shared = np.array([least_shared(len(w), r) for w, r in zip(self.words, lengths)], np.int64)
        self.postings = [self._postings(r, [n for n, x in enumerate(lengths) if x == r]) for r in sorted(set(lengths))]

    def _postings(self, length: int, group: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Run length, distinct runs, where the items of each begin (one more at the end), items."""
        each = [np.unique(run_hashes(self.words[n], length)) for n in group]
        runs, items = np.concatenate(each), np.repeat(group, [len(e) for e in each])
        order = np.argsort(runs, kind="stable")
        distinct, first = np.unique(runs[order], return_index=True)
        return length, distinct, np.append(first, len(runs)), items[order]

    def _size_class(self, number: int, group: list[int]) -> SizeClass:
        places_of = [self.pieces[p] for p in group]
        sizes = tuple(sorted({b - a for _, a, b in places_of}))
        walks, tables = sampled_walks(sizes), []
        steps = max(int(places[-1]) + 1 for samples in walks for places in samples)
        owners = sorted({n for n, _, _ in places_of})
        past = np.zeros(steps, np.uint64)  # what a walk reads behind the end of an item
        begin = dict(zip(owners, np.cumsum([0] + [len(self.words[n]) + steps for n in owners]).tolist()))
        row = np.concatenate([x for n in owners for x in (self.words[n], past)])
        starts = np.array([begin[n] + a for n, a, _ in places_of])
        for walk, samples in enumerate(walks):
            symbols = walk_symbols(row, starts, walk, steps)
            for sample, places in enumerate(samples):
                salt = (number * MOST_WALKS + walk) * SAMPLES + sample + 1
                keys = _keys(symbols, places, salt)
                order = np.argsort(keys, kind="stable")
                tables.append((walk, places, salt, keys[order], np.array(group)[order]))
        least = min(max(1, least_shared(m)) for m in sizes)
        return SizeClass(max(m + allowed(m) for m in sizes), least, steps, len(walks), tables)

    def starts(self, words: np.ndarray, runs: np.ndarray) -> Iterator[tuple[SizeClass, np.ndarray]]:
        """Per size class, the window starts with enough runs of its items ahead of them."""
        if not len(runs) or not len(self.runs):
            return
        place = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
        owners = np.where(self.runs[place] == runs, self.owners[place], 0)
        if not owners.any():
            return
        for number, sizes in enumerate(self.classes):
            hit = owners >> number & 1
            if hit.sum() >= sizes.least_runs:
                total = np.concatenate([[0], np.cumsum(hit)])
                ends = np.minimum(np.arange(len(runs)) + sizes.longest, len(runs))
                if len(found := np.flatnonzero(total[ends] - total[:-1] >= sizes.least_runs)):
                    yield sizes, found

    def candidates(self, words: np.ndarray, runs: np.ndarray | None = None) -> set[tuple[int, int]]:
        """(item, where the item would start) for pieces and windows with an equal sample; a start may lie ahead of the text."""
        found: set[tuple[int, int]] = set()
        for sizes, starts in self.starts(words, run_hashes(words, RUN) if runs is None else runs):
            for at in range(0, len(starts), STARTS_AT_ONCE):
                part = starts[at : at + STARTS_AT_ONCE]
                symbols = [walk_symbols(words, part, walk, sizes.steps) for walk in range(sizes.walks)]
                for walk, places, salt, keys, members in sizes.tables:
                    mine = _keys(symbols[walk], places, salt)
                    left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                    for w in np.flatnonzero(right > left):
                        for n, first, _ in map(self.pieces.__getitem__, members[left[w] : right[w]].tolist()):
                            found.add((n, int(part[w]) - first))
        return found

    def counted(self, words: np.ndarray, runs: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per item, the (first word, end) of stretches that may hold a match: all that have enough of its own runs."""
        found: dict[int, list[tuple[int, int]]] = {}
        for posting in self.postings:
            self._count(words, runs if posting[0] == RUN else run_hashes(words, posting[0]), *posting, found)
        return found

    def _count(
        self,
        words: np.ndarray,
        runs: np.ndarray,
        length: int,
        known: np.ndarray,
        run_from: np.ndarray,
        items: np.ndarray,
        found: dict[int, list[tuple[int, int]]],
    ) -> None:
        place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        at = np.flatnonzero(known[place] == runs)
        first, count = run_from[place[at]], run_from[place[at] + 1] - run_from[place[at]]
        total, longest, begin = np.concatenate([[0], np.cumsum(count)]), int(self.span.max()), 0
        while begin < len(at):  # a part of the text at a time, the parts overlapping by more than any match
            end = max(np.searchsorted(total, total[begin] + POSTINGS_AT_ONCE), np.searchsorted(at, at[begin] + 2 * longest))
            end = min(int(end), len(at))
            n, f = count[begin:end], first[begin:end]
            item = items[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            where = np.repeat(at[begin:end], n)
            order = np.argsort(item, kind="stable")
            item, where = item[order], where[order]
            last = np.arange(len(item)) + self.shared[item] - 1
            inside = np.minimum(last, len(item) - 1)
            good = (last < len(item)) & (item[inside] == item) & (where[inside] + length - where <= self.span[item])
            for i in np.flatnonzero(good):
                span, places = int(self.span[item[i]]), found.setdefault(int(item[i]), [])
                low, high = max(0, int(where[inside[i]]) + length - span), min(len(words), int(where[i]) + span)
                if places and low <= places[-1][1]:
                    places[-1] = (min(places[-1][0], low), max(places[-1][1], high))
                else:
                    places.append((low, high))
            if end == len(at):
                break
            begin = max(begin + 1, int(np.searchsorted(at, at[end - 1] - longest)))


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, end) of the stretch of ``text`` nearest to ``item``; the earliest end among equals."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        change = np.concatenate([[i], cost[:-1] + (text != word)])
        from_change = np.concatenate([[0], begin[:-1]])
        drop = cost + 1
        low = np.minimum(change, drop)
        source = np.where(change <= drop, from_change, begin)
        # insertions: the best earlier column plus the distance to it
        reach = np.minimum.accumulate(low - steps)
        origin = np.maximum.accumulate(np.where(low - steps == reach, steps, 0))
        cost, begin = reach + steps, source[origin]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(index: ItemIndex, text: bytes) -> list[tuple[int, int, int, int]]:
    """(item number, first word, last word, edits) of every place of an item in a text."""
    words = word_hashes(text, LETTERS)
    runs = run_hashes(words, RUN)
    by_item: dict[int, list[int]] = {}
    for n, start in index.candidates(words, runs):
        by_item.setdefault(n, []).append(start)
    counted = index.counted(words, runs)
    out = []
    for n in sorted(by_item.keys() | counted.keys()):
        item, k = index.words[n], allowed(len(index.words[n]))
        starts = sorted(by_item.get(n, ()))
        groups = [[s, s] for s in starts[:1]]
        for s in starts[1:]:
            if s - groups[-1][1] <= len(item) // 2 and s - groups[-1][0] <= len(item):
                groups[-1][1] = s
            else:
                groups.append([s, s])
        seen = set()
        for a, b in groups:
            low = max(0, a - k)
            edits, first, end = best_stretch(item, words[low : max(0, b + len(item) + k)])
            if edits <= k and end > first and (low + first, low + end) not in seen:
                seen.add((low + first, low + end))
                out.append((n, low + first, low + end - 1, edits))
        left = [gap for place in counted.get(n, ()) for gap in _gaps(*place, sorted(seen))]
        while left:
            low, high = left.pop()
            if high - low < len(item) - k:
                continue
            edits, first, end = best_stretch(item, words[low:high])
            if edits <= k and end > first:
                out.append((n, low + first, low + end - 1, edits))
                left += [(low, low + first), (low + end, high)]
    return out


def _gaps(low: int, high: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of low..high between the stretches ``taken``."""
    gaps = []
    for first, end in taken:
        if first < high and end > low:
            gaps.append((low, first))
            low = max(low, end)
    return [*gaps, (low, high)]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block: list[tuple[int, bytes]] = []
    size = 0
    for item, text in items.select(F.col("item_id").cast("long"), F.lower(F.coalesce("text", F.lit("")))).toLocalIterator():
        block.append((item, text.encode()))
        size += len(block[-1][1])
        if len(block) == BLOCK or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


_MATCHES = "doc_id long, item_id long, first_word long, last_word long, edits long"


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, edits): one row per place of a benchmark item in a document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.lower("text").cast("binary").alias("text"))
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _MATCHES.split(", ")])

    def search(block: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [
                    (doc, index.ids[n], first, last, edits)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for n, first, last, edits in (matches(index, text) if text else ())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 5)], schema=schema)

        return texts.mapInArrow(run, _MATCHES)

    return reduce(DataFrame.union, [search(block) for block in _blocks(items)])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item. Documents without an id stay."""
    hit = small_side(find_items(docs, items).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
