"""The LSH forest: regions that grow deeper, those that cannot, and whole results against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm.minhash import POSITIONS, _dealt, candidate_pairs, forest, near_duplicates, regions

REGION = 64


def classes(spark, signs):
    return spark.createDataFrame([(i, 100, row.astype(np.uint32).tobytes()) for i, row in enumerate(signs)], "id long, n long, signature binary")


def family(rng, rows, share):
    """Signatures that agree with one base in ``share`` of the positions."""
    base = rng.integers(0, 1 << 32, POSITIONS)
    own = rng.integers(0, 1 << 32, (rows, POSITIONS))
    return np.where(rng.random((rows, POSITIONS)) < share, base, own)


def near(rng, signs, share=0.8):
    """A partner of each row that agrees in just ``share`` of the positions."""
    own = rng.integers(0, 1 << 32, signs.shape)
    keep = np.argsort(rng.random(signs.shape), axis=1) < round(share * POSITIONS)
    return np.where(keep, signs, own)


@pytest.fixture(scope="module")
def template(spark):
    """5000 classes of one template, any two about 0.36 alike, and 500 planted partners at 80 %."""
    rng = np.random.default_rng(5)
    signs = family(rng, 5000, 0.6)
    signs = np.concatenate([signs, near(rng, signs[:500])])
    rows = forest(classes(spark, signs)).persist()
    yield rows
    rows.unpersist()


def found(rows, planted):
    """Of the planted pairs (i, 5000 + i), those whose ends a candidate pair or a kept group brings together."""
    out = candidate_pairs(rows, REGION).collect()
    pairs = {(r.a, r.b) for r in out if r.a is not None}
    groups = defaultdict(set)
    for r in out:
        if r.block is not None:
            groups[r.block].add(r.id)
    kept = list(groups.values())
    return sum((i, j) in pairs or any(i in g and j in g for g in kept) for i, j in planted)


def test_a_dense_region_grows_deeper_and_keeps_its_pairs(spark, template):
    planted = [(i, 5000 + i) for i in range(500)]
    sizes = template.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m"))
    dense = sizes.filter(F.col("m") > REGION)
    assert dense.count() > 10
    placed = regions(template, REGION).groupBy("region").agg(F.count(F.lit(1)).alias("k"))
    work = placed.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    plain = sizes.agg(F.sum(F.col("m") * F.col("m"))).first()[0]
    assert placed.filter(F.col("k") > 3 * REGION).count() == 0  # two parts at most
    assert 2 * work < plain
    assert found(template, planted) >= 495


def test_regions_that_cannot_grow_bring_every_two_classes_together(spark):
    """600 classes that are all alike: no order parts them, and all pairs of parts meet."""
    rng = np.random.default_rng(6)
    rows = forest(classes(spark, family(rng, 600, 0.995))).filter("tree = 0")
    largest = rows.groupBy("prefix").count().orderBy(F.desc("count")).first()
    assert largest["count"] > 4 * REGION
    ids = {r.id for r in rows.filter(F.col("prefix") == largest["prefix"]).collect()}
    met = defaultdict(set)
    for r in regions(rows.filter(F.col("prefix") == largest["prefix"]), REGION).collect():
        met[r.region].add(r.id)
    partners = defaultdict(set)
    for group in met.values():
        for i in group:
            partners[i] |= group
    assert all(partners[i] == ids for i in ids)


def test_dealt_parts_hold_about_two_regions(spark):
    dense = spark.range(5000).select(
        F.lit(1).cast("long").alias("region"), F.lit(b"").alias("further"), "id", F.lit(1).cast("long").alias("n"),
        F.lit(b"x").alias("low"), F.lit(5000).cast("long").alias("m"),
    )
    sizes = [r["count"] for r in _dealt(dense, REGION).groupBy("region").count().collect()]
    assert max(sizes) < 3 * REGION and len(sizes) == 79 * 78 // 2


def components_of(texts, k):
    """Component of each document by comparing every two sets."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in words).split(" ") if w]
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset()
    component = {i: i for i in texts}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    holders = defaultdict(list)
    for i, shingles in sets.items():
        for s in shingles:
            holders[s].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for x, i in enumerate(ids):
            for j in ids[x + 1 :]:
                common[i, j] += 1
    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            component[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}, sets


@pytest.mark.parametrize("k", [2, 5])
def test_documents_against_every_two_sets(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = docs.limit(0)
    base = docs.orderBy("doc_id").limit(40).collect()
    rng = np.random.default_rng(7)
    copies = []
    for n, r in enumerate(base):  # copies with a few words changed, about as far apart as the threshold
        words = (r.text or "").split()
        for j in range(3):
            changed = list(words)
            for at in rng.choice(len(words), max(1, len(words) * (j + 1) // 40), replace=False) if words else ():
                changed[at] = f"new{n}x{j}"
            copies.append((1_000_000 + 10 * n + j, " ".join(changed)))
    copies += [(2_000_000, None), (2_000_001, ""), (2_000_002, " \n"), (2_000_003, "One"), (2_000_004, "one"), (2_000_005, "two words"),
               (2_000_006, "Two words"), (2_000_007, "TWO words")]
    every = docs.unionByName(own).unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in every.collect()}
    want, sets = components_of(texts, k)
    got = {r.doc_id: r for r in near_duplicates(every, k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())
