"""Near-duplicate components against all pairs of a small corpus."""

import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

import flowwatch.llm.neardup as N
from flowwatch.llm.neardup import near_duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, _) in enumerate(docs):
        for q in range(p):
            j, both, union = docs[q][0], sets[p] & sets[q], sets[p] | sets[q]
            if i is not None and j is not None and union and 100 * len(both) >= 75 * len(union):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for (i, _), s in zip(docs, sets, strict=True)), key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    passage = [word() for _ in range(60)]
    docs = []
    for family in range(8):
        base = passage + [word() for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    docs += [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(30)]
    docs += ["ab cd", "ab  CD", "ab cd ef", None, "", " \n", "x " * 30_000, "x " * 30_001]
    rng.shuffle(docs)
    rows = [(10 + i, t) for i, t in enumerate(docs)]
    return rows + [(None, docs[3]), (None, docs[3]), (12, docs[2]), (13, docs[2]), (9, docs[0])]


@pytest.mark.parametrize("short, block", [(32, 2048), (2, 5)])
def test_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(N, "SHORT", short)
    monkeypatch.setattr(N, "BLOCK", block)
    docs = corpus()
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rep int")
    assert sorted(map(tuple, near_duplicates(table).collect()), key=str) == brute(docs)


def test_estimate_keeps_links_of_unlike_sizes(spark):
    """Pairs just above the threshold whose sets have 65 to 170 shingles: the sketch of the
    smaller set reaches farther, and the estimate must cut both at the same place."""
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for inter, size, other in ((72, 72, 96), (80, 80, 106), (90, 90, 120), (100, 100, 133), (120, 120, 160), (110, 115, 141)):
        assert 100 * inter >= 75 * (size + other - inter)
        for _ in range(400):
            values = rng.integers(0, 1 << 64, size + other - inter, np.uint64)
            a, b = 2 * len(want), 2 * len(want) + 1
            for rep, own in ((a, values[:size]), (b, values[size - inter :])):
                rows.append((rep, len(own), N.smallest(np.unique(own)).tolist()))
            want.add((a, b))
    classes = spark.createDataFrame(rows, "rep long, n long, sketch array<long>")
    got = N.estimated(spark.createDataFrame(sorted(want), "a long, b long"), classes)
    assert want == {tuple(r) for r in got.collect()}
    assert all(sorted(s) == s for _, _, s in rows)


def test_empty(spark):
    table = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_duplicates(table.limit(0)).collect() == []


def test_query(spark):
    same_as_sql(spark, "op9_minhash_neardup")
