"""Decontamination against a plain search of word lists."""

import hashlib
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm.benchmark import contamination, digest
from flowwatch.llm.benchmark import hit_texts as PLAIN_HIT_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(docs, items, width):
    out = []
    for doc, text in docs:
        w = WORD.findall(fold(text))
        hit, ids = set(), set()
        for item, question in items:
            q = WORD.findall(fold(question))
            for i in range(max(1, len(q) - width + 1) if q else 0):
                win = q[i : i + width]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rng = random.Random(3)
    vocabulary = ["a", "B", "ñu", "É", "x1", "the", "OF"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    items = [(i, text(rng.randint(0, 9))) for i in range(25)]
    docs += [(50, None), (51, ""), (None, docs[3][1]), (3, docs[3][1]), (52, "!!"), (53, "a b " * 3000)]
    items += [(None, "the OF the"), (30, None), (31, "..."), (5, items[5][1]), (32, items[5][1])]
    return docs, items


def test_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    for bound in (1 << 20, 300):  # one automaton, and several
        found = contamination(d, b, width=4, bound=bound)
        assert sorted(map(tuple, digest(found).collect()), key=str) == brute(docs, items, 4)
    for r in found.collect():
        for s, run in zip(r.hits.spans, r.hits.runs, strict=True):
            assert len(WORD.findall(fold(r.text[s.start : s.end]))) == run.end - run.start


def test_shards_are_built_once_per_worker(spark, tmp_path, monkeypatch):
    """Five or more shards and batches of ten rows: no worker builds an automaton twice."""
    from flowwatch.llm import benchmark

    log = str(tmp_path)
    docs, items = data()
    d = spark.createDataFrame([(i, t) for i, t in docs * 6], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(benchmark, "hit_texts", lambda shared, key: _logged(shared, key, log))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = sorted(map(tuple, digest(contamination(d, b, width=4, bound=400)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute(docs, items, 4) * 6, key=str)
    counts = {name: os.path.getsize(os.path.join(log, name)) for name in os.listdir(log)}
    assert len({name.split("-")[1] for name in counts}) >= 5 and set(counts.values()) == {1}


def _logged(shared, key, log):
    """`hit_texts` that writes down which worker builds which shard."""
    plain = PLAIN_HIT_TEXTS(shared, key)

    def run(batches):
        from flowwatch.llm import benchmark

        if key not in benchmark._AUTOMATA:
            with open(os.path.join(log, f"{os.getpid()}-{key[-12:].replace('-', '_')}"), "a") as f:
                f.write("x")
        yield from plain(batches)

    return run


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in digest(contamination(d, b)).collect()] == [False]
    assert digest(contamination(d.limit(0), b)).collect() == []


def test_query(spark):
    same_as_sql(spark, "op8_benchmark_decontamination")
