"""Vector links against all pairs."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm.nndescent import near_vectors


def brute(rows, threshold=0.93):
    unit = {}
    for k, (_, label, v) in enumerate(rows):
        if label is not None and v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                unit[k] = x / np.linalg.norm(x)
    ids = [r[0] for r in rows]
    links = {k: set() for k in range(len(rows))}
    for a in unit:
        for b in unit:
            if a < b and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        named = [ids[j] for j in seen if ids[j] is not None]
        c = min(named) if named else None
        n = len({ids[j] for j in links[k]} - {ids[k]}) if ids[k] is not None else len(links[k])
        out.append((ids[k], n, c, c == ids[k] if ids[k] is not None and c is not None else n == 0))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for size in (120, 7, 2, 2, 1, 1):
            base = rng.standard_normal(16)
            for _ in range(size):
                noise = rng.standard_normal(16) * 0.06 * np.linalg.norm(base) * rng.random()
                rows.append((len(rows), label, (base + noise).astype(np.float32).tolist()))
        chain = rng.standard_normal(16)
        for step in range(12):  # links that reach along a chain only
            other = np.roll(chain, 1)
            a = 0.3 * step
            rows.append((len(rows), label, (np.cos(a) * chain + np.sin(a) * other).astype(np.float32).tolist()))
        rows += [(len(rows) + i, label, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(60)]
    v = rows[0][2]
    rows += [(1000, 0, None), (1001, 0, []), (1002, 0, [0.0] * 16), (1003, 0, [float("nan")] + v[1:]), (1004, 0, [float("inf")] + v[1:])]
    rows += [(1005, 0, [None] + v[1:]), (1006, 0, v), (1007, 0, [2 * x for x in v]), (0, 0, v), (1008, 0, v[:8]), (1009, 0, v[:8]), (None, 1, rng.standard_normal(16).tolist())]
    return rows


def test_brute_force(spark):
    rows, recall = corpus(), []
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, node int")
    got = near_vectors(table, keep_recall=recall).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, la, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, la, v in rows])
    assert recall[-1] >= 0.9
    assert near_vectors(table.limit(0)).collect() == []


def test_query(spark):
    same_as_sql(spark, "op4_embedding_neardup")
