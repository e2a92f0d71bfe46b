"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm import tries
from flowwatch.llm.tries import digest, prefix_trie


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == p))).encode()).hexdigest())
        for p, m in members.items()), key=str)


def rows_of(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string"


def conversations(rng):
    rows = [(rng.choice([rng.randrange(-250, 700), None]), rng.choice([0, 1, 2, 3, 4, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é\U0001f600", "", None])) for _ in range(900)]
    rows += [(5000 + k, d, "user", f"same {d}") for k in range(40) for d in range(7)]  # copies, with bases and without
    rows += [(7000 + k * 100, d, "user", f"step {d}") for k in range(30) for d in range(k)]  # each a prefix of the next
    rows += [(9000 + k * 100, d, "user", "shared" if d < 60 else f"{k} {d}") for k in range(6) for d in range(80)]  # long common prefix
    rows += [(12_300, d, "user", "x" * 90) for d in range(400)]  # alone and long
    rows += [(12_400, 1, "user", "twice"), (12_400, 1, "user", "twice"), (12_400, 2, "u", "ser:a"), (12_400, 3, "us", "er:a")]
    return [(*r, "extra", "extra") for r in rows]


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_brute_force(spark, limit):
    rows = conversations(random.Random(limit))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(digest(prefix_trie(df, limit))) == brute(rows)


def test_packs(spark, monkeypatch):
    monkeypatch.setattr(tries, "PACK", 3)
    rows = [(k * 100, d, "user", f"t{d}", "", "") for k in range(50) for d in range(3)]
    assert rows_of(digest(prefix_trie(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "user", "x", "", "")], SCHEMA)
    assert digest(prefix_trie(df)).collect() == []
    rows = [(1, 0, "user", "only", "", "")]  # its only turn is cut away, and there is no base
    assert zlib.crc32(b"1") % 6 > 0
    assert rows_of(digest(prefix_trie(spark.createDataFrame(rows, SCHEMA), 1))) == brute(rows)


def test_query(spark):
    same_as_sql(spark, "op11_prefix_trie")
    same_as_sql(spark, "op11_prefix_trie", "/root/testdata/sf0.01")
