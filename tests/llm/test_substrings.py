"""Window removal against plain word lists."""

import hashlib
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm.substrings import digest, removals


def brute(docs, width):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    big = float("inf")
    for i, w in split:
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (big if i is None else i):
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "ñu", "x y", "the,", " "])
    common = [word() for _ in range(9)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            w[5:5] = common
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(70, None), (71, ""), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (3, docs[6][1])]
    docs += [(72, " ".join(common * 4000)), (-5, "  \n a B  ")]
    table = spark.createDataFrame([(i, t, b"x") for i, t in docs], "doc_id long, text string, hashes binary").repartition(5)
    for buckets in (1, 7):
        found = removals(table, width=5, buckets=buckets)
        assert sorted(map(tuple, digest(found).collect()), key=str) == brute(docs, 5)
    assert removals(table.limit(0)).collect() == []


def test_query(spark):
    same_as_sql(spark, "op7_substring_dedup")
