"""Near-duplicates by an LSH forest: several sorted orders of one signature, compared by longest common prefix.

1. Words are split at ASCII white space, A-Z in lower case; a document's set is its distinct ``k``-word runs
   (fewer words: the whole sequence is one run; no words: the empty set, linked with nothing).
2. Documents with equal sets form a class, named by its least doc_id. Only classes go on.
3. A signature has ``POSITIONS`` minimum hashes. Each of ``TREES`` sorted orders begins with ``DEPTH`` positions of
   its own and goes on with further ones. Classes whose common prefix reaches the depth are a region; within it rows come
   sorted by the rest, so neighbours have the longest common prefix. A region of up to ``REGION`` classes is
   compared throughout, from its shared depth on. A denser one grows deeper: it is sorted anew in ``SPLITS`` orders of
   ``STEP`` further positions each, and those that share them are regions of their own, which may grow deeper again. A pair
   at 80 % that shares a region shares one of its deeper ones with probability ``q = 1 - (1 - 0.8 ** STEP) ** SPLITS`` = 0.94, and
   it shares a region in a third of the trees: were all of these to grow to the end, ``(1 - 0.8 ** DEPTH * q ** LEVELS) ** TREES`` of such
   pairs, one in 15,000, would be missed. A region stays at its depth if going deeper would not halve the comparisons, as with thousands
   of texts that are all alike: it is dealt into parts of about ``REGION`` classes, and each pair of parts is compared
   throughout by itself, wherever it lands, so that every two classes meet. Comparison counts agreeing low bytes
   of the signature.
4. Pairs that may reach the similarity come out: all of a small group, of a larger one the tree of greatest agreement that
   spans it. The larger group itself is kept for step 6, so this is no cap.
5. Each pair is confirmed on the full sets of the whole texts, in whole numbers:
   ``100 * common >= PERCENT * union``. Confirmed links are joined into components.
6. Kept groups that still hold several components are joined into families. Every text of a family is sent once, and
   every possible pair with ends in different components is confirmed in place; only links that join two components
   come out. A family of more than ``FAMILY`` classes is split, and each pair of parts is a task of its own.

Rows with a null doc_id are not linked and have no component; an id that comes several times names several rows,
each with the component of its own text. Nothing is dropped: every row of the input has one row in the result.
Null texts count as empty; texts of any length are read whole. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import BROADCAST_ROWS, SPACED, bounded_batches, fresh_name, map_batches, mixed, shingle_hashes, small_side, word_hashes, written
from gleaner.llm.graph import components

PERCENT = 80
POSITIONS = 128
TREES = 32
DEPTH = 5
FURTHER = 8
COMPARED = 64
#: how often a dense region may grow deeper, and by how many orders of how many positions
LEVELS, SPLITS, STEP = 4, 4, 3
#: agreeing low bytes of 64 below which a pair is left: 4.6 deviations under the 51.2 of a pair at 80 %
AGREEING = 37
REGION = 2048
SMALL_GROUP = 8
FAMILY = 4096

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.array([_random.permutation(POSITIONS)[: DEPTH + FURTHER] for _ in range(TREES)])
#: per level and order, the positions by which a region grows; those of one level are all different
_DEEPER = [_random.permutation(COMPARED)[: SPLITS * STEP].reshape(SPLITS, STEP).tolist() for _ in range(LEVELS)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``POSITIONS`` hash functions over the set, as 32-bit numbers."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _FACTORS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) per row; digest and signature are null for an empty set."""
    fields = T.StructType([
        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType()),
    ])

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        sizes, digests, signatures = [], [], []
        for t in texts:
            shingles = shingle_hashes(word_hashes(t.lower(), SPACED), k)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signatures.append(signature(shingles).tobytes() if len(shingles) else None)
        return {
            "n_shingles": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "signature": pa.array(signatures, pa.binary()),
        }

    renamed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_batches(renamed, "text", run, fields, keep=["doc_id"])


_FOREST = "tree short, prefix long, further binary, id long, n long, low binary"


def forest(classes: DataFrame) -> DataFrame:
    """One row per class and sorted order: the shared positions as a key, the further ones to sort by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(m, POSITIONS)
            bytes_ = (signs & np.uint32(255)).astype(np.uint8)
            low = pa.array([r.tobytes() for r in bytes_[:, :COMPARED]], pa.binary())
            for tree, order in enumerate(_ORDERS):
                key = np.full(m, np.uint64(tree))
                for p in order[:DEPTH]:
                    key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + signs[:, p])
                further = pa.array([r.tobytes() for r in np.ascontiguousarray(bytes_[:, order[DEPTH:]])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, tree, np.int16)), pa.array(key.view(np.int64)), further, batch.column(0), batch.column(1), low],
                    names=["tree", "prefix", "further", "id", "n", "low"],
                )

    return classes.select("id", "n", "signature").mapInArrow(run, _FOREST)


def _possible(n: np.ndarray, low: np.ndarray, at: int, to: int) -> np.ndarray:
    """Agreeing bytes of rows at..to with all rows; 0 where agreement or the set sizes rule a pair out."""
    agree = (low[at:to, None, :] == low[None, :, :]).sum(axis=2, dtype=np.uint8)
    small, large = np.minimum(n[at:to, None], n[None, :]), np.maximum(n[at:to, None], n[None, :])
    agree[(agree < AGREEING) | (100 * small < PERCENT * large)] = 0
    return agree


def _agreement(n: np.ndarray, low: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // (len(n) * COMPARED))
    table = np.concatenate([_possible(n, low, at, min(at + step, len(n))) for at in range(0, len(n), step)])
    np.fill_diagonal(table, 0)
    return table


def _groups(table: np.ndarray) -> list[np.ndarray]:
    """Rows that possible pairs connect, for groups of two and more."""
    left, out = table.any(axis=1), []
    while left.any():
        member = np.zeros(len(table), bool)
        fresh = np.zeros(len(table), bool)
        fresh[np.argmax(left)] = True
        while fresh.any():
            member |= fresh
            fresh = table[fresh].any(axis=0) & ~member
        left &= ~member
        out.append(np.flatnonzero(member))
    return out


def _spanning_tree(table: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a connected group that span it with the greatest agreement."""
    best, near = table[0].copy(), np.zeros(len(table), np.int64)
    done = np.zeros(len(table), bool)
    done[0] = True
    pairs = []
    for _ in range(len(table) - 1):
        i = int(np.argmax(np.where(done, 0, best)))
        pairs.append((int(near[i]), i))
        done[i] = True
        closer = table[i] > best
        best[closer], near[closer] = table[i][closer], i
    return pairs


def _chosen(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to confirm first: all of a small group, else a spanning tree."""
    if len(table) <= SMALL_GROUP:
        return np.nonzero(np.triu(table))
    tree = np.array(_spanning_tree(table))
    return tree[:, 0], tree[:, 1]


_PAIRS = "a long, b long, block long, id long, n long, low binary"


def _pair_rows(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    keep = a != b
    pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], axis=1), axis=0)
    return {"a": pairs[:, 0], "b": pairs[:, 1]}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), and the rows (block, id, n, low) of large groups, from rows that come sorted by region."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("low", pa.binary())])
    found_a, found_b, waiting = [], [], []

    def pairs_out() -> Iterator[pa.RecordBatch]:
        if found_a:
            made = _pair_rows(np.concatenate(found_a), np.concatenate(found_b))
            found_a.clear(), found_b.clear()
            none = {c: pa.nulls(len(made["a"]), schema.field(c).type) for c in ("block", "id", "n", "low")}
            yield pa.RecordBatch.from_pydict({"a": pa.array(made["a"]), "b": pa.array(made["b"])} | none, schema=schema)

    def compare(key: int, ids: np.ndarray, n: np.ndarray, low: np.ndarray) -> None:
        table = _agreement(n, low)
        for group in _groups(table):
            sub = table[np.ix_(group, group)]
            i, j = _chosen(sub)
            found_a.append(ids[group[i]])
            found_b.append(ids[group[j]])
            if len(group) > SMALL_GROUP:
                block = int.from_bytes(hashlib.blake2b(f"{key}:{ids[group[0]]}:{len(group)}".encode(), digest_size=8).digest(), "big", signed=True)
                waiting.append(pa.RecordBatch.from_pydict({
                    "a": pa.nulls(len(group), pa.int64()), "b": pa.nulls(len(group), pa.int64()), "block": pa.array(np.full(len(group), block)),
                    "id": pa.array(ids[group]), "n": pa.array(n[group]), "low": pa.array([r.tobytes() for r in low[group]], pa.binary()),
                }, schema=schema))

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COMPARED)
        rows = (keys, ids, n, low)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        keys = rows[0]
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        sizes = np.diff(starts)
        # pairs of their own, all at once; the last region may go on in the next batch
        two = starts[:-1][(sizes == 2) & (np.arange(len(sizes)) < len(sizes) - 1)]
        if len(two):
            i, j = two, two + 1
            agree = (rows[3][i] == rows[3][j]).sum(axis=1)
            small, large = np.minimum(rows[2][i], rows[2][j]), np.maximum(rows[2][i], rows[2][j])
            good = (agree >= AGREEING) & (100 * small >= PERCENT * large)
            found_a.append(rows[1][i[good]])
            found_b.append(rows[1][j[good]])
        for r in np.flatnonzero(sizes[:-1] > 2):
            at, end = starts[r], starts[r + 1]
            compare(int(keys[at]), *(x[at:end] for x in rows[1:]))
        held = tuple(x[starts[-2] :].copy() for x in rows)
        yield from waiting
        waiting.clear()
        if sum(map(len, found_a)) > 100_000:
            yield from pairs_out()
    if held is not None and len(held[0]) > 1:
        compare(int(held[0][0]), *held[1:])
    yield from waiting
    yield from pairs_out()


def _deeper(dense: DataFrame, level: int) -> DataFrame:
    """Rows of dense regions once per order of the level, with ``child``, the deeper region that each falls in."""
    orders = [
        F.xxhash64(F.lit(level), F.lit(i), "region", *[F.substring("low", p + 1, 1) for p in places])
        for i, places in enumerate(_DEEPER[level])
    ]
    return dense.select("region", "m", "further", "id", "n", "low", F.explode(F.array(*orders)).alias("child"))


def _dealt(dense: DataFrame, region: int) -> DataFrame:
    """Rows of dense regions, each sent to every pair of parts that its own part is in."""
    parted = dense.withColumn("parts", F.ceil(F.col("m") / F.lit(region)).cast("int"))
    part = F.pmod(F.xxhash64("id", "n", "low"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part)
    pair = F.xxhash64("region", F.least(part, F.col("other")), F.greatest(part, F.col("other")))
    return parted.select("*", F.explode(others).alias("other")).select(pair.alias("region"), "further", "id", "n", "low")


def regions(rows: DataFrame, region: int = REGION) -> DataFrame:
    """(region, further, id, n, low): the rows of a forest by the regions in which they are compared throughout."""
    columns = ["region", "further", "id", "n", "low"]
    counts = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > region)
    many = written(counts, "dense-regions")
    number = many.count()
    if not number:
        return rows.withColumnRenamed("prefix", "region").select(*columns)
    many = F.broadcast(many) if number <= BROADCAST_ROWS else many
    placed = [rows.join(many.select("tree", "prefix"), ["tree", "prefix"], "left_anti").withColumnRenamed("prefix", "region").select(*columns)]
    dense = written(rows.join(many, ["tree", "prefix"]).withColumnRenamed("prefix", "region").select(*columns, "m"), "dense")
    for level in range(LEVELS):
        children = _deeper(dense, level)
        sizes = written(children.groupBy("region", "m", "child").agg(F.count(F.lit(1)).alias("k")), "deeper")
        worth = sizes.groupBy("region", "m").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("work"))
        worth = small_side(worth.filter(2 * F.col("work") < F.col("m").cast("double") * F.col("m")).select("region"), "growing")
        placed.append(_dealt(dense.join(worth, "region", "left_anti"), region))
        # a class that is alone in a deeper region has no partner there
        going = sizes.join(worth, "region", "left_semi").filter("k > 1").select(F.col("child").alias("c"), "k")
        down = children.join(small_side(going, "children"), F.col("child") == F.col("c")).select(
            F.col("child").alias("region"), "further", "id", "n", "low", F.col("k").alias("m")
        )
        down = written(down, "down")
        placed.append(down.filter(F.col("m") <= region).select(*columns))
        dense = down.filter(F.col("m") > region)
        if dense.isEmpty():
            break
    else:
        placed.append(_dealt(dense, region))
    return reduce(DataFrame.unionByName, placed)


def candidate_pairs(rows: DataFrame, region: int = REGION) -> DataFrame:
    bounded_batches(rows.sparkSession)
    placed = regions(rows, region).repartition("region").sortWithinPartitions("region", "further", "id")
    return placed.select("region", "id", "n", "low").mapInArrow(_candidates, _PAIRS)


def _joining_links(rows: list[tuple], k: int) -> list[tuple[int, int]]:
    """Links between different components of one family part; once two components are linked they count as one."""
    ids, n, comp = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 5))
    low = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, COMPARED)
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_hashes(word_hashes(rows[i][6].lower(), SPACED), k)
        return sets[i]

    links = []
    step = max(1, (1 << 22) // (len(ids) * COMPARED))
    for at in range(0, len(ids), step):
        agree = _possible(n, low, at, min(at + step, len(ids)))
        for r, cols in ((at + r, np.flatnonzero(agree[r])) for r in range(len(agree))):
            for c in cols[(cols > r) & (comp[cols] != comp[r])]:
                if comp[c] != comp[r]:
                    a, b = shingles(r), shingles(int(c))
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * common >= PERCENT * (len(a) + len(b) - common):
                        links.append((int(ids[r]), int(ids[c])))
                        comp[comp == comp[c]] = comp[r]
    return links


def family_links(groups: DataFrame, comps: DataFrame, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """Step 6: confirmed links (a, b) between components that kept groups (block, id, n, low) still hold."""
    labelled = groups.join(comps, groups["id"] == comps["node"], "left").select(
        "block", "id", "n", "low", F.coalesce("component", "id").alias("component")
    )
    labelled = written(labelled, "groups")
    ends = labelled.groupBy("block").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first <> last")
    open_rows = labelled.join(ends.select("block", "first"), "block")
    families = components(open_rows.select(F.col("component").alias("a"), F.col("first").alias("b")).distinct(), "families")
    families = families.select(F.col("node").alias("component"), F.col("component").alias("family"))
    members = open_rows.select("id", "n", "low", "component").dropDuplicates(["id"]).join(families, "component")
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))
    members = written(members, "members")
    parts = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAMILY)).cast("int").alias("parts"))
    texts = whole.join(small_side(members.select("id"), "family-ids"), F.col("doc") == F.col("id"), "left_semi")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    sent = (
        members.join(parts, "family").join(texts, F.col("id") == F.col("doc"))
        .select("family", part.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "id", "n", "low", "component", "t")
        .select("family", (F.least("mine", "other") * 100_000 + F.greatest("mine", "other")).alias("pair"), "id", "n", "low", "component", "t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(rows: list[tuple]) -> pa.RecordBatch:
            found = _joining_links(rows, k) if len({r[5] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:2] != row[:2]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    bounded_batches(docs.sparkSession)
    return sent.repartition("family", "pair").sortWithinPartitions("family", "pair", "id").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) that reach the similarity on the full sets of their texts; one text row stands for each class."""
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = whole.join(small_side(ends, "ends"), "id", "left_semi")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def shingles(t: bytes) -> set:
        words = t.lower().split()
        return {tuple(words)} if len(words) <= k else set(zip(*(words[i:] for i in range(k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, held = [], None, set()
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tb != last:
                    last, held = tb, shingles(tb)
                other = shingles(ta)
                common = len(held & other)
                good.append(100 * common >= PERCENT * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable) and kept."""
    sketched = written(sketches(docs, k, doc_id, text), "sketches")
    named = sketched.filter("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("id"))
    members = named.select("doc_id", "digest", F.col("n_shingles").alias("n"), "signature")
    rows = classes.join(members, (classes["digest"] == members["digest"]) & (classes["id"] == members["doc_id"])).select(
        "id", "n", "signature"
    ).dropDuplicates(["id", "n", "signature"])

    found = written(candidate_pairs(forest(written(rows, "classes"))), "candidates")
    pairs = found.filter("a is not null").select("a", "b").distinct()
    links = written(confirmed(pairs, docs, k, doc_id, text), "confirmed")
    comps = components(links)
    kept_groups = found.filter("block is not null").select("block", "id", "n", "low")
    if not kept_groups.isEmpty():
        more = written(family_links(kept_groups, comps, docs, k, doc_id, text), "family-links")
        if not more.isEmpty():
            comps = components(links.union(more))
    labels = classes.join(comps, classes["id"] == comps["node"], "left").select(
        F.col("digest").alias("class"), F.coalesce("component", "id").alias("component_id")
    )
    joined = sketched.drop("signature").join(labels, sketched["digest"] == labels["class"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id. Rows without an id stay."""
    name = fresh_name(docs, "gone_id")
    gone = near_duplicates(docs, k, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    found = small_side(gone, "gone")
    return docs.join(found, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
