"""Source mixing: targets and fits against plain searches, and the promises of a mix."""

import random
import re
from collections import Counter, defaultdict

import pytest

from flowwatch.llm.mixing import fit, mix


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= over
        if not free:
            return out


def test_fit_against_all_sums():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 6) for _ in range(rng.randint(1, 6))}
        total = sum(n * c for n, c in counts.items())
        budget = rng.randint(0, total)
        took = fit(dict(counts), budget)
        assert all(0 < k <= counts[n] for n, k in took.items())
        got = sum(n * k for n, k in took.items())
        assert abs(got - budget) <= max(counts)
        assert got == sum(n * k for n, k in fit(dict(counts), budget).items())
    many = {n: 3 for n in range(1, 200)}
    assert all(sum(n * k for n, k in fit(dict(many), b).items()) == b for b in range(0, 59700, 371))


def rows():
    rng = random.Random(4)
    out = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "É", "\U0001f600", None, "c"])
        out.append((i, "w " * rng.choice([0, 1, 5, 5, 5, 17, 40, 300]), source, 9))
    out += [(900, None, "empty", 9), (None, "x y", "b", 9), (3, "x y z", "b", 9), (3, "x y z", "b", 9), (901, "q\x0b" * 9000, "c", 9)]
    return out


def test_mix(spark):
    data = rows()
    table = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mix(table).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s, _ in data
    )
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats
    for source, want in plain_targets(sizes).items():
        assert target[source] == pytest.approx(want, rel=1e-12)
        # sums of few and large documents cannot meet every target: allow half the longest
        longest = max(r.size for r in got if r.source == source)
        assert abs(taken[source] - want) <= max(1, longest / 2)
    assert {r.source_size for r in got if r.source == "a"} == {sizes["a"]}
    again = mix(table.repartition(7).orderBy("text")).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.repeats)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slices_and_empty(spark, monkeypatch):
    import flowwatch.llm.mixing as M

    monkeypatch.setattr(M, "SLICE", 8)  # the most common length spans many slices
    data = rows() + [(2000 + i, "w " * 5, "a", 9) for i in range(500)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mix(table).collect()
    assert len(got) == len(data)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, max(r.size for r in own) / 2)
    assert mix(table.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mix(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
