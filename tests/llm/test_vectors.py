"""Operators on embeddings against brute force on small tables with odd rows."""

import math

import numpy as np
import pytest

from gleaner.llm import hard_negatives as hard
from gleaner.llm import vector_dedup as dedup
from gleaner.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, node int, n long"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """``rows`` of (id, vector, label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "k", 0, 1, None) for i, v, label in rows], SCHEMA)


def floats(m):
    return [[float(x) for x in row] for row in np.asarray(m, np.float32)]


def odd(d):
    return [(901, None, 1), (902, [NAN] * d, 1), (903, [INF] + [0.0] * (d - 1), 1), (904, [None] + [1.0] * (d - 1), 1), (905, [], 1), (906, [1.0], 1)]


def test_whitening_equals_brute_force(spark):
    d, draw = 11, np.random.default_rng(1)
    m = floats(draw.normal(size=(60, d)) @ np.diag(np.linspace(1, 4, d)))
    rows = [(i, v, 0) for i, v in enumerate(m)] + [(100 + i, m[3], None) for i in range(70)] + [(None, m[5], 0), (7, m[7], 0)]
    got = whiten(table(spark, rows + odd(d))).collect()
    kept = [(i, v) for i, v, _ in rows]
    assert len(got) == 8 * len(kept)
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == n and r.identity_error < 1e-9 and str(r.deviation) == r.deviation_digits
        e = values[::-1][r.component - 1]
        assert math.isclose(r.explained, e / values.sum(), rel_tol=1e-10)
    assert set(by_row) == {(i, int(dev)) for (i, _), dev in zip(kept, deviation)}
    for at, (i, _) in enumerate(kept):
        for r in by_row[i, int(deviation[at])]:
            axis = vectors[:, ::-1][:, r.component - 1]
            assert math.isclose(abs(r.whitened), abs(y[at] @ axis) / math.sqrt(values[::-1][r.component - 1]), rel_tol=1e-7, abs_tol=1e-9)


def test_whitening_by_distinct_vectors_few_rows_and_none(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(9)] + [(10, [0.0, 1.0, 0.0], 0), (11, [0.5, 0.0, 1.0], 0)]
    got = whiten(table(spark, rows), weight="one").collect()
    assert {r.n for r in got} == {3} and {r.component for r in got} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component == 3) for r in got) and got[0].identity_error < 1e-12
    got = whiten(table(spark, [(1, [2.0, 3.0], 0), (2, [2.0, 3.0], 0)])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in got] == [(None, None, None, 0)] * 4
    assert whiten(table(spark, [])).count() == 0 and whiten(table(spark, odd(3)[:5])).count() == 0
    got = whiten(table(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 0.0], 0)])).collect()
    assert len(got) == 6 and got[0].deviation is None and int(got[0].deviation_digits) > 1 << 63


def links_by_hand(rows, cosine=0.9):
    used = [(at, i, np.array(v, float)) for at, (i, v, _) in enumerate(rows) if i is not None and v and not any(c is None or not math.isfinite(c) for c in v) and any(v)]
    near = {at: set() for at in range(len(rows))}
    for a, _, x in used:
        for b, _, y in used:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                near[a].add(b)
    out = []
    for at, (i, _, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = i if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(near[at]), least, i == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [2048, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(dedup, "PART", part)
    d, draw = 24, np.random.default_rng(2)
    centres = draw.normal(size=(5, d))
    near = [centres[i % 5] + draw.normal(size=d) * [0.05, 0.2, 0.3, 0.4, 0.5][i % 5] for i in range(150)]
    rows = [(1000 - i, v, 0) for i, v in enumerate(floats(near))] + [(2000 + i, v, None) for i, v in enumerate(floats(draw.normal(size=(80, d))))]
    rows += [(3000 + i, rows[4][1], 0) for i in range(40)] + [(3100, [2 * c for c in rows[4][1]], 0), (3101, [0.0] * d, 0), (3102, [-0.0] * d, 0)]
    rows += [(None, rows[4][1], 0), (5, rows[9][1], 0), (5, rows[200][1], 0), (3103, [0.0, 1.0], 0), (3104, [-0.0, 5.0], 0), (3105, [0.0, 1.0], 0)] + odd(d)
    got = dedup.near_vectors(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == links_by_hand(rows)
    assert dedup.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in dedup.near_vectors(table(spark, odd(3)[:1])).collect()] == [(901, 0, 901, True)]


def test_pairs_at_the_least_cosine_are_found_in_the_recall_stated(spark):
    d, pairs, draw = 64, 4000, np.random.default_rng(3)
    a = dedup.unit_vectors(draw.normal(size=(pairs, d)))
    b = draw.normal(size=(pairs, d))
    b = dedup.unit_vectors(b - (a * b).sum(axis=1)[:, None] * a)
    b = 0.9001 * a + math.sqrt(1 - 0.9001**2) * b
    rows = [(2 * i, [float(x) for x in v], 0) for i, v in enumerate(a)] + [(2 * i + 1, [float(x) for x in v], 0) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = dedup.near_vectors(df)
    assert got.filter("n_links > 0").count() >= 2 * pairs * 0.999
    assert dedup.table_shape(10**9)[0] > dedup.table_shape(10**5)[0]


def mined_by_hand(rows, every=100, positives=5, negatives=10):
    d = max({len(v) for _, v, _ in rows if v}, key=lambda n: sum(len(v or []) == n for _, v, _ in rows))
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v and len(v) == d and not any(c is None or not math.isfinite(c) for c in v):
            used.append((i, label, [max(min(math.floor(256 * float(c)), 1 << 23), -(1 << 23)) for c in v]))
    out = []
    for i, label, v in used:
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, other) for j, other, w in used if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k, _) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("block", [65_536, 32])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard, "BLOCK", block)
    monkeypatch.setattr(hard, "LEAST_BLOCK", block)
    d, draw = 20, np.random.default_rng(4)
    m = floats(draw.normal(size=(260, d)) + 0.5)
    rows = [(i, v, int(draw.integers(0, 3))) for i, v in enumerate(m)] + [(300 + i, m[4], i % 3) for i in range(30)]
    rows += [(None, m[1], 1), (500, m[2], None), (600, [0.0] * d, 1), (700, [3e38] * d, 2), (701, [-3e38] * d, 2), (-100, m[9], 0), (702, m[0], 0)] + odd(d)
    got = [tuple(r) for r in hard.hard_negatives(table(spark, rows)).collect()]
    assert sorted(got) == mined_by_hand(rows) and len(got) > 100
    assert hard.hard_negatives(table(spark, [])).count() == 0
    assert hard.hard_negatives(table(spark, [(1, m[0], 1), (2, m[1], 2)])).count() == 0
    assert hard.hard_negatives(table(spark, [(100, m[0], 1)] * 3)).count() == 0


def test_products_in_residues_are_exact():
    draw = np.random.default_rng(5)
    for d, largest in ((1, 1), (64, 150), (2500, 100_000), (100, 1 << 23)):
        a, b = draw.integers(-largest, largest + 1, (7, d)), draw.integers(-largest, largest + 1, (9, d))
        a[0], b[0], b[1] = largest, largest, -largest
        assert (hard.exact_products(a, b, hard.primes_for(d, largest)) == a.astype(object) @ b.astype(object).T).all()
    assert hard.window_of(-10) == (-3, -9) and hard.window_of(15) == (5, 13)
