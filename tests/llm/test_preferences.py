"""Preference pairs against plain lists of turns."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm.preferences import FIRST, cut_replies, preferences


def ordered(rows, pair):
    mine = sorted({(FIRST if t is None else t, r or "", x or "") for p, t, r, x in rows if p == pair})
    out, ties = [], {}
    for t, r, x in mine:
        ties[t] = ties.get(t, 0) + 1
        out.append(((t, ties[t]), r, x))
    return out


def brute(chosen, rejected):
    out = []
    for pair in {r[0] for r in chosen + rejected} - {None}:
        c, r = ({k: (a, b) for k, a, b in ordered(side, pair)} for side in (chosen, rejected))
        differ = [k for k in {*c, *r} if c.get(k) != r.get(k)]
        if not c or not r or not differ:
            continue
        for part, side, keep in (("prompt", c, lambda k: k < min(differ)), ("chosen", c, lambda k: k >= min(differ)), ("rejected", r, lambda k: k >= min(differ))):
            for k, (role, text) in side.items():
                if keep(k):
                    head = f"<|{role}|>\n"
                    full = f"{head}{text}<|end|>\n"
                    on = part != "prompt" and role == "assistant"
                    out.append((pair, part, None if k[0] == FIRST else k[0], k[1], role, full, len(head) if on else 0, len(full) if on else 0))
    return sorted(out, key=str)


def test_brute_force(spark):
    rng = random.Random(8)
    make = lambda: [
        (rng.choice([1, 2, 3, 4, 5, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é\U0001f600", "", None]))
        for _ in range(40)
    ]
    same = [(7, 0, "user", "q"), (7, 1, "assistant", "a"), (8, 0, "user", "q"), (8, 1, "assistant", "a b")]
    schema = "conv_id long, turn long, role string, text string"
    long = [(10, i, "user" if i % 2 == 0 else "assistant", f"t{i}" * 50) for i in range(3000)]
    for chosen, rejected in (
        (make() + same, make() + same[:3]), (make(), make()), (same + long, same[:3] + long[:-1] + [(10, 2999, "assistant", "no")]), (same, []),
    ):
        c, r = (spark.createDataFrame([(*x, "extra") for x in side], schema + ", part string") for side in (chosen, rejected))
        assert sorted(map(tuple, preferences(c, r).collect()), key=str) == brute(chosen, rejected)


def test_cut_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one two three four five"), (2, 0, "user", "alone"), (3, 0, "assistant", "word")]
    got = cut_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.text) for r in got) == [(1, 0, "q"), (1, 1, "one two"), (3, 0, "word")]


def test_query(spark):
    same_as_sql(spark, "op6_preference_format")
