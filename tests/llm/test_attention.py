"""Language-model scores: counts against plain Python, gradients and windows against slow forms."""

import collections
import math
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SMALL

from flowwatch.llm import attention as A

LINES = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]  # None is the end of the text


def base_of(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = collections.Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in words_of(t))
    n, v = sum(count.values()), len(count)
    for (i, t), h in zip(rows, held, strict=True):
        words = words_of(t)
        yield i, h, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def model_of(texts, steps=30):
    import pyarrow as pa

    words = A.Vocabulary.of(LINES)
    row = A.packed(pa.array(range(len(texts))), pa.array(texts, pa.string()), np.zeros(len(texts), bool), words, 3)
    pieces = A.array(row["pieces"], np.uint16).astype(int)
    weight = np.repeat(A.array(row["count"], np.int32), A.array(row["n_pieces"], np.int32))
    count = np.bincount(pieces, weight, words.size).astype(np.int64)
    classes = A.Classes(count, np.random.default_rng(1).normal(size=(words.size, 2 * A.NEIGHBOURS)) * (count > 0)[:, None])
    ids, begin = A.streams(row)
    windows = A.cut(ids, begin, *A.windows_of(begin), words.end)
    return row, classes, windows, A.start_weights(classes), words


TEXTS = ["The river ran on, and the day was plain. " * 9, "", None, "one", "Änderung über alles " * 30, "x" * 700 + "   end\n\n"]


def test_streams_and_windows():
    row, _, windows, _, words = model_of(TEXTS)
    ids, begin = A.streams(row)
    for k, text in enumerate(TEXTS):
        mine = ids[begin[k]:begin[k + 1]]
        assert mine[-1] == words.end and (mine[:-1] != words.end).all()
        lower = (text or "").translate(LOWER)
        assert words.coder.decode(mine[:-1].tolist()).split(" ")[1:] == WORD.findall(lower)
    text, place = A.windows_of(begin)
    scored = [(t, p + k) for t, p, w in zip(text, place, windows, strict=True) for k in range(A.SCORED) if w[A.WIDE + k] != A.OUTSIDE]
    assert scored == [(t, p) for t in range(len(TEXTS)) for p in range(begin[t + 1] - begin[t])]  # each id once
    for t, p, w in zip(text, place, windows, strict=True):
        for j in range(A.WIDE):
            source = p + j - A.CONTEXT - 1
            size = begin[t + 1] - begin[t]
            want = words.end if source == -1 else ids[begin[t] + source] if 0 <= source < size - 1 else A.OUTSIDE
            assert w[j] == want


def test_gradients():
    _, classes, windows, w, _ = model_of(TEXTS)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    part = windows[[0, 1, 4, len(windows) - 1]]
    g, _ = A.gradients(w, classes, part)
    rng = np.random.default_rng(2)
    used = np.unique(classes.entry[A.opened(part)[0]])
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(s) for s in w[name].shape)
            if name == "embed":
                at = (rng.choice(used), at[1])
            keep = w[name][at]
            w[name][at] = keep + 1e-4
            high = A.gradients(w, classes, part)[1]
            w[name][at] = keep - 1e-4
            low = A.gradients(w, classes, part)[1]
            w[name][at] = keep
            assert abs((high - low) / 2e-4 - g[name][at]) < 2e-4 * max(1, abs(g[name][at])), name


def test_causal_and_normalised():
    row, classes, windows, w, words = model_of(TEXTS)
    w, _ = A.local_steps(w, classes, windows, 1, 0.02)
    scorer = A.Scorer(w, classes)
    begin = A.streams(row)[1]
    first = A.windows_of(begin)[1] == 0
    got = scorer(windows, first)
    # what comes later changes nothing, and a longer batch changes nothing
    changed = windows.copy()
    changed[:, A.CONTEXT + 8:A.WIDE][changed[:, A.CONTEXT + 8:A.WIDE] != A.OUTSIDE] = 77
    assert np.allclose(scorer(changed, first)[:, :8], got[:, :8], atol=1e-4)
    assert np.allclose(np.concatenate([scorer(windows[k:k + 1], first[k:k + 1]) for k in range(len(windows))]), got, atol=1e-4)
    # training helps, and the loss is what the scorer says, up to the shares within entries
    loss = A.gradients(w, classes, windows)[1]
    _, _, target, counts = A.opened(windows)
    assert abs(loss + (got - np.where(counts, classes.share[target], 0)).sum() / counts.sum()) < 1e-3
    assert loss < A.gradients(A.start_weights(classes), classes, windows)[1] - 0.5
    # probabilities of all ids after one context add up to one
    every = np.repeat(windows[1:2], words.size, 0)
    every[:, A.WIDE:] = A.OUTSIDE
    every[:, A.WIDE] = np.arange(words.size)  # one target each
    assert abs(np.exp(scorer(every, np.repeat(first[1:2], words.size))[:, 0]).sum() - 1) < 1e-3


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2000)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "no id"), (3, TEXTS[3]), (3, "other"), (41, "words " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, score string").repartition(3)
    got = A.scored(docs, LINES, rounds=1)
    want = sorted(((*x[:5], round(x[5], 6)) for x in base_of(rows)), key=str)
    assert [tuple(map(str, r[:5])) for r in rows_of(got)] == [tuple(map(str, r[:5])) for r in want]
    assert np.allclose([r[5] for r in rows_of(got)], [r[5] for r in want], rtol=1e-6)
    assert all(r.score < 0 for r in got.collect())
    assert A.scored(docs.limit(0), LINES).collect() == []
    alone = A.scored(docs.where("doc_id % 5 = 1 and crc32(cast(doc_id as string)) % 5 = 1"), LINES, rounds=1).collect()
    assert alone and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in alone)


def test_packed_slices():
    """A slice of a batch without nulls gives what a copy of it gives."""
    import pyarrow as pa

    texts = ["First Text " * 3, "a Second one, LONGER", "and The third", "É last"]
    words = A.Vocabulary.of(LINES)
    for a in range(len(texts)):
        ids, held = pa.array(range(len(texts) - a)), np.zeros(len(texts) - a, bool)
        got = A.packed(ids, pa.array(texts, pa.string())[a:], held, words, 3)
        assert got == A.packed(ids, pa.array(texts[a:], pa.string()), held, words, 3)
        assert got["n_words"] == [len(words_of(t)) - 1 for t in texts[a:]]


def test_learns_from_every_window(spark, monkeypatch):
    """Every window of every training text is in one round, and none of the held-out ones."""
    row, classes, windows, w, words = model_of(TEXTS)
    row = {**row, "held": [False, False, True, False, False, True]}
    text = A.windows_of(A.streams(row)[1])[0]
    want = sorted(windows[~np.array(row["held"])[text]].tolist())
    assert sorted(x for k in range(3) for x in A.train_windows(row, words.end, k, 3).tolist()) == want
    # blocks one after another: as many steps as they need
    seen = []
    monkeypatch.setattr(A, "gradients", lambda w, c, part: (seen.append(len(part)), ({k: np.zeros_like(v) for k, v in w.items()}, 0.0))[1])
    many = np.repeat(windows, 1000, 0)
    A.local_steps(w, classes, iter([many, many[:10], many]), 1, 0.02)
    assert sum(seen) == 2 * len(many) + 10
    monkeypatch.setattr(A, "LEAST_WINDOWS", 4)
    assert [len(x) for x in A.gathered(iter([windows[:1], windows[:0], windows[:5], windows[:2]]))] == [6, 2]


def test_query(spark):
    from flowwatch.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op12_lm_scores"](spark, SMALL).toPandas()
    want = {x[0]: x[1:] for x in base_of(docs)}
    assert len(got) == len(docs)
    for r in got.itertuples():
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    # on texts it has not seen, the model is far better than an equal chance of all ids
    out = got[got.held_out]
    assert out.score.sum() / out.n_tokens.sum() > -6


def test_encode():
    """Words all at once give what each word gives alone, wherever empty words stand."""
    words = A.Vocabulary.of(LINES)
    assert "seen" not in vars(words)  # nothing is remembered by word
    some = [b"", b"one", "\u00e4 \u65e5\u672c".split()[0].encode(), b"", b"x" * 700, b"\xff\xfe", b"<|endoftext|>", b"end", b""]
    for part in (some, some[1:3], [b""], []):
        hashes, pieces, size = words.encode(part)
        alone = [words.encode([w]) for w in part]
        assert hashes == b"".join(h for h, _, _ in alone)
        assert pieces == b"".join(p for _, p, _ in alone)
        assert size.tolist() == [n for _, _, one in alone for n in one.tolist()]


def test_exponentials():
    """Rows of a matrix and rows one after another, in the range of float32 or far from it."""
    for factor in (1, 30, 1000):
        z = np.random.default_rng(3).normal(size=(6, 5)) * factor
        want = np.exp(z - z.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        for begin in (None, np.arange(0, 30, 5)):
            got = z.astype(np.float32) if begin is None else z.astype(np.float32).ravel()
            total = A.exponentials(got, begin)
            assert np.allclose(got.reshape(6, 5) / total[:, None], want, atol=1e-4)
    assert len(A.exponentials(np.zeros(0, np.float32), np.zeros(0, int))) == 0


def test_windows_that_do_not_count():
    """A step without a target, or with one, and the order of the windows in it."""
    _, classes, windows, w, _ = model_of(TEXTS)
    none = windows[:1].copy()
    none[:, A.WIDE:] = A.OUTSIDE
    g, loss = A.gradients(w, classes, none)
    assert loss == 0 and not any(np.any(x) for x in g.values())
    a, b = A.gradients(w, classes, windows), A.gradients(w, classes, windows[::-1])
    assert abs(a[1] - b[1]) < 1e-4 and all(np.allclose(a[0][k], b[0][k], atol=1e-5) for k in w)
    # what is looked up is by entry, not by id
    assert len(A.Scorer(w, classes).q) == len(w["embed"])


def test_blocks_are_dealt(spark, monkeypatch):
    """Where there are many, every block is read by one round alone, and none is left out."""
    docs = spark.createDataFrame([(i, f"some words {i} " * 60) for i in range(60)], "doc_id long, text string").repartition(4)
    store = A.keep(A.blocks(docs, LINES, "doc_id", "text", 8, 1500), "lm-test")
    seen = []

    def averaged(store, w, classes, end, turn, turns, seed, rate):
        seen.append((sorted(r.block for r in store.select("block").collect()), turn, turns))
        return w

    monkeypatch.setattr(A, "averaged", averaged)
    monkeypatch.setattr(A, "LEAST_WINDOWS", 16)
    every = sorted(r.block for r in store.select("block").collect())
    assert len(every) >= 24
    A.trained(store, LINES, 3)
    assert sorted(x for blocks, _, _ in seen for x in blocks) == every and all(x[1:] == (0, 1) for x in seen)
    seen.clear()
    monkeypatch.setattr(A, "BLOCKS_A_TURN", len(every))
    A.trained(store, LINES, 3)
    assert seen == [(every, k, 3) for k in range(3)]
