"""Fill-in-the-middle rows against plain string work, and the exact way back."""

import hashlib
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import same_as_sql

from flowwatch.llm import middles
from flowwatch.llm.middles import digest, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng):
    pieces = ["a", "héé", "\U0001f600", " ", "  ", "\n", "\t\x0b", " ", " ", "<P", ">", "<S>", "<M>", "word", "\x00", "\x1c"]
    for _ in range(300):
        yield "".join(rng.choices(pieces, [5, 5, 3, 8, 2, 2, 1, 1, 1, 1, 1, 0.1, 0.1, 6, 1, 1], k=rng.randrange(40)))
    yield from (None, "", " ", "\n\n", "one", " one ", "x " * 40_000, "y" * 100_000, "é" * 1000 + " ")


def test_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts(rng))]
    rows += [(None, "no id here at all", "kept", 7), (3, rows[3][1], "kept", 7), (3, "another text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    for rate, spm in ((50, 80), (100, 50), (0, 0)):
        made = fill_in_middle(docs, rate=rate, spm=spm)
        got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.where("doc_id is not null").collect())
        want = sorted((r[0], *brute(r[0], r[1], 42, rate, spm)) for r in rows if r[0] is not None)
        assert [str(x) for x in got] == [str(x) for x in want]
        back = restored(made)
        assert sorted((r.doc_id or -1, r.restored) for r in back.collect()) == sorted((r[0] or (-1 if r[0] is None else 0) or -1, r[1] or "") for r in rows)
    assert {r.source for r in made.where("doc_id = 5").collect()} == {"kept"}


def test_chunks_agree(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    rows = list(enumerate(texts(rng)))
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["i", "t"])
    whole = middles.turn(batch, "i", "t", 42, 100, 50).to_pylist()
    monkeypatch.setattr(middles, "CHUNK", 64)
    parts = [middles.turn(batch.slice(a, b - a), "i", "t", 42, 100, 50).to_pylist() for a, b in middles.chunks(batch.column("t"))]
    assert len(parts) > 20 and [r for p in parts for r in p] == whole


def test_empty_and_digest(spark):
    docs = spark.createDataFrame([(1, "one two three", "x")], "doc_id long, text string, output string")
    assert digest(fill_in_middle(docs.limit(0))).collect() == []
    (row,) = digest(fill_in_middle(docs)).collect()
    assert row.output_sha256 == hashlib.sha256(brute(1, "one two three")[4].encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(b"one two three").hexdigest()


def test_query(spark):
    same_as_sql(spark, "op13_fill_in_middle")
