"""Weak labels: recovered accuracies on made votes, and held-out accuracy on labelled rows."""

import random

import numpy as np

from pyspark.sql import functions as F

from flowwatch.llm.quality import LABELLERS, Sparse, code, decode, digest, expectation_maximisation, judged, train, votes


def test_votes_and_codes():
    clean = b"It was a plain day, and the river ran on. " * 5
    assert votes(clean, clean.split())[0:5] == (1, 1, 1, 1, 1)
    for junk in (b"BUY!! NOW!! " * 20, b"one### two$$$ " * 20, b"same same " * 20, b"a | list | of | cells | " * 9):
        assert -1 in votes(junk, junk.split())
    assert votes(b"", []) == (0,) * len(LABELLERS)
    assert all(decode(code(v)) == v for v in [(1, 0, -1, 1, 0, 0, -1), (0,) * 7, (-1,) * 7])


def test_em_recovers_accuracies():
    rng = random.Random(1)
    wrong = [0.01, 0.02, 0.005, 0.01, 0.02, 0.01, 0.01]
    counts: dict[int, int] = {}
    truth: dict[int, list[int]] = {}
    for _ in range(20_000):
        y = int(rng.random() < 0.8)
        kind = rng.randrange(3)  # junk for one of three reasons, each caught by one labeller or two
        rate = wrong if y else [0.9 if k == kind else 0.7 if k == kind + 3 else wrong[k] for k in range(7)]
        v = tuple(-1 if rng.random() < rate[k] else rng.choice([0, 1]) for k in range(7))
        counts[code(v)] = counts.get(code(v), 0) + 1
        truth.setdefault(code(v), []).append(y)
    posterior, rate, prior = expectation_maximisation(counts, trust=0.985)  # as these labellers err
    assert abs(prior - 0.8) < 0.05
    assert np.abs(rate[:, 0] - wrong).max() < 0.015
    hit = sum(sum((posterior[p] >= 0.5) == y for y in ys) for p, ys in truth.items())
    assert hit / 20_000 > 0.92  # 8 % of clean texts have a wrong vote here, 3 % of junk has none


def test_scorer():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6))
    every = np.arange(6)
    y = (x[:, 0] > x[:, 1]).astype(float)
    w = train(Sparse([(every, row) for row in x], 6, step=64), y, np.ones(400))
    assert (((x @ w[:-1] + w[-1]) > 0) == (x[:, 0] > x[:, 1])).mean() > 0.95
    # a row that counts three times is three rows, and slices change nothing
    # (weights are relative to their mean, 1.25 here, the ridge to the number of rows)
    again = train(Sparse([(every, row) for row in [*x, *x[:50], *x[:50]]], 6), np.r_[y, y[:50], y[:50]], np.ones(500))
    weighted = train(Sparse([(every, row) for row in x], 6, step=64), y, np.r_[np.full(50, 3.0), np.ones(350)])
    assert np.abs(again - weighted).max() < 1e-2 * np.abs(again).max()


def test_sample_is_the_same_however_rows_lie(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choices(["the", "river", "ran", "BUY!!", "so", "###", "quiet", "and"], k=rng.randrange(4, 60))) for _ in range(300)]
    rows = [(k, rng.choice(pool)) for k in range(600)] + [(1000 + k, pool[0]) for k in range(400)]  # one text holds a large share
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.score, r.kept) for r in digest(judged(docs.repartition(n).orderBy(F.rand(n)), fit_rows=100)).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_whole_words():
    from flowwatch.llm.quality import Shapes

    # words that differ after 64 bytes have shapes of their own
    start = b"Ab1" * 30
    assert Shapes()[start] != Shapes()[start + b"!!##$$"]


def test_held_out_accuracy(spark):
    from flowwatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [got[i].kept == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.98
    clean = [got[i].kept for i, q in labels.items() if q]
    assert sum(clean) / len(clean) > 0.99


def test_defined_cases(spark):
    text = "The day went on and nothing of note was said by anyone there. " * 4
    rows = [(1, text, 1), (2, None, 1), (3, "", 1), (None, text, 1), (1, text, 1), (4, "OK!! " * 30_000, 1), (5, "word", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = digest(judged(docs)).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.kept) for r in got if r.n_words == 0} == {(2, False), (3, False)}
    assert len({r.score for r in got if r.doc_id in (1, None)}) == 1
    assert digest(judged(docs.limit(0))).collect() == []
    assert all(not r.kept for r in digest(judged(docs.where("text = ''"))).collect())
