"""Blocks of the license scan: notices over lines, words far apart, long texts, and every block by brute force."""

import re
import time

import numpy as np

from gleaner.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, WORD, least_common, scan_licenses, window_of

BSD = "Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that"


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, words string, hits string, near string")
    return scan_licenses(df).collect()


def by_hand(text):
    """(places, labels, score) by looking at every block of every template."""
    words = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {label for _, label in places}, 0.0
    for t, label in TEMPLATES:
        wanted, span = set(t.split()), window_of(t)
        most = max((len(wanted & set(words[i : i + span])) for i in range(len(words))), default=0)
        if most >= least_common(len(wanted), THRESHOLD):
            labels.add(label)
            best = max(best, most / len(wanted))
    return len(words), sorted(i for i, _ in places), ",".join(sorted(labels)), 1.0 if places else best


def test_a_wrapped_notice_is_one_block(spark):
    row, = scan(spark, [(1, f"int main\n/*\n * {BSD} * the following\n */")])
    assert row.labels == "bsd" and row.base_labels == "" and row.score == 1.0


def test_words_far_apart_are_no_notice(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    row, = scan(spark, [(1, f"all {filler} rights {filler} reserved")])
    assert row.labels == "" and row.score == 0.0
    row, = scan(spark, [(1, f"{filler} All rights, strictly\nreserved {filler}")])
    assert row.labels == "all-rights-reserved"


def test_every_block_by_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = sorted({w for t, _ in TEMPLATES for w in t.split()})
    rows = [(1, None), (2, ""), (3, " ;\n"), (4, "Under the MIT\nLicense under the mit license. CC-BY-NC"), (4, BSD), (None, BSD), (7, BSD), (7, BSD)]
    for n in range(400):  # notices with words lost, added and in other order, among template words at random
        t = TEMPLATES[n % len(TEMPLATES)][0].split()
        words = [w for w in t if rng.random() > 0.08]
        for _ in range(rng.integers(0, 5)):
            words.insert(rng.integers(0, len(words) + 1), "é" if rng.random() < 0.5 else str(rng.choice(vocabulary)))
        if rng.random() < 0.3:
            rng.shuffle(words)
        around = [str(w) for w in rng.choice(vocabulary, rng.integers(0, 12))]
        words = around + words + around[::-1]
        seps = [" ", "\n", ", ", " \t", "-"]
        rows.append((100 + n, "".join(w.upper() + seps[rng.integers(0, 5)] if rng.random() < 0.2 else w + " " for w in words)))
    got = {}
    for r in scan(spark, rows):
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    met = 0
    for doc_id, text in rows:
        if doc_id == 4:
            continue  # rows of one id share their labels
        n, places, labels, score = by_hand(text)
        for r in got[doc_id]:
            assert (r.n_words, r.n_base, r.labels) == (n, len(places), labels), text
            assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
            assert abs(r.score - score) < 1e-12
        met += bool(labels)
    assert 100 < met < 400
    assert {r.labels for r in got[4]} == {"bsd,cc-by-nc,mit", "bsd"}


def test_long_texts_of_notices(spark):
    scan(spark, [(1, "warm")])
    rows = [(1, "cc by nc " * 40_000), (2, "under the mit license\n" * 20_000), (3, "license " * 100_000)]
    start = time.time()
    got = {r.doc_id: r for r in scan(spark, rows)}
    assert time.time() - start < 60
    assert got[1].n_base == 40_000 and got[1].last_word == 119_997
    assert got[2].n_base == 20_000 and got[2].base_labels == "mit" and got[3].labels == ""
