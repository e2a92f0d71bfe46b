"""Quality classifier from weak labels.

Seven heuristic labellers look at a text and vote junk, clean or nothing. They overlap and
err, so expectation-maximisation over the counts of vote patterns (at most 3^7 rows reach
the driver, whatever the corpus) estimates how often each labeller votes what on either
class, and with that the posterior of every pattern. Posteriors are the training labels of
a linear scorer on hashed word shapes: letters count as upper or lower case, runs as one,
and a word that repeats the one before has a bucket of its own. It is fitted on
the `fit_rows` distinct texts of the smallest hashes (a documented bound; features only), weighted
by how often each is there, and scores every whole text. Documents whose score
is below one half are rejected. No labelled row is used; the labels table measures it.

Defined cases: texts without a word, null included, get score 0 and are rejected; texts
that no labeller judges get the prior as posterior; equal texts get equal scores; null
ids pass through; an empty table gives an empty one; with no sample the posterior itself
is the score; a column of `docs` named like the new one is replaced.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowwatch.llm.common import ship

WIDTH = 1024
SAMPLE = "struct<pattern:int,at:array<int>,share:array<double>>"
LABELLERS = ("symbols", "upper", "repeats", "separators", "marks", "length", "lines")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#$%&*|<>=+@^~_\\{}[]"
_ALONE = re.compile(rb"(?<![^\x20\x09-\x0D])[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_SHAPES = bytes(85 if 65 <= b <= 90 else 108 if 97 <= b <= 122 or b >= 128 else 100 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class Shapes(dict):
    """Feature of a word: bucket of its shape; made once per word while below `most`."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.most:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPES))
        found = 1 + xxhash.xxh3_64_intdigest(shape) % (WIDTH - 1)
        if len(word) <= 64:  # longer ones aren't remembered, as they take room and seldom come back
            self[word] = found
        return found


_SHAPE = Shapes()


def vote(value: float, clean: float, junk: float) -> int:
    """1 for clean, -1 for junk, 0 between; `junk` may lie on either side of `clean`."""
    if junk > clean:
        return 1 if value <= clean else -1 if value >= junk else 0
    return 1 if value >= clean else -1 if value <= junk else 0


def votes(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    n, size = len(words), len(raw)
    if not n:
        return (0,) * len(LABELLERS)
    upper, lower = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _LOWER))
    same = sum(map(operator.eq, words, islice(words, 1, None)))
    few = n < 5
    mean = sum(map(len, words)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        vote((size - len(raw.translate(None, _SYMBOLS))) / size, 0.01, 0.06),
        0 if few else vote(upper / max(1, upper + lower), 0.2, 0.5),
        0 if few else vote(same / n, 0.03, 0.25),
        0 if few else vote(len(_ALONE.findall(raw)) / n, 0.03, 0.2),
        0 if few else vote(raw.count(b"!") / n, 0.05, 0.4),
        0 if few or 3 <= mean <= 4 or 9 <= mean <= 11 else 1 if 4 < mean < 9 else -1,
        0 if len(lines) < 4 else vote(len(set(lines)) / len(lines), 0.9, 0.3),
    )


def features(words: list[bytes]) -> np.ndarray:
    """Share of each bucket; bucket 0 counts words equal to the one before."""
    found = np.bincount(np.fromiter(map(_SHAPE.__getitem__, words), np.int64, len(words)), minlength=WIDTH).astype(np.float64)
    found[0] = sum(map(operator.eq, words, islice(words, 1, None)))
    return found / max(1, len(words))


def code(found: tuple[int, ...]) -> int:
    """Votes as one number in base three."""
    out = 0
    for v in found:
        out = out * 3 + v + 1
    return out


def decode(pattern: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def expectation_maximisation(
    counts: dict[int, int], rounds: int = 500, trust: float = 0.997, weight: float = 0.5
) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of clean by pattern, P(junk vote | class) as [labeller, class], prior of clean.

    Classes are clean (the first) and one kind of junk per labeller: a text is junk for
    one reason at a time, and labellers of other reasons overlap with it more or less.
    Votes for clean and abstentions are both "no junk vote". The prior belief, worth
    `weight` of the corpus, is that a labeller spares `trust` of the clean texts; a kind
    of junk starts as what its labeller finds. That keeps the classes from swapping, and
    EM learns from overlaps and counts how accurate each labeller is.
    """
    patterns = sorted(counts)
    size = len(LABELLERS)
    if not patterns:
        return {}, np.full((size, size + 1), 0.5), 0.5
    n = np.array([counts[p] for p in patterns], np.float64)
    fired = np.array([[v == -1 for v in decode(p)] for p in patterns], np.float64)
    belief = np.full((size, size + 1), 2.0)  # votes that a class is believed to have had
    junk_votes = np.full((size, size + 1), 0.1) + 1.7 * np.eye(size, size + 1, 1)
    belief[:, 0] = weight * n.sum()
    junk_votes[:, 0] = (1 - trust) * belief[:, 0]
    rate, share = (junk_votes / belief).clip(1e-6, 1 - 1e-6), np.r_[0.9, np.full(size, 0.1 / size)]
    before = np.zeros(len(n))
    for _ in range(rounds):
        logs = fired @ np.log(rate) + (1 - fired) @ np.log1p(-rate) + np.log(share)
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        if np.abs(post[:, 0] - before).max() < 1e-9:
            break
        before = post[:, 0]
        mass = n[:, None] * post
        rate = ((fired.T @ mass + junk_votes) / (mass.sum(0) + belief)).clip(1e-6, 1 - 1e-6)
        share = (mass.sum(0) + 1) / (n.sum() + size + 1)
    return dict(zip(patterns, before.tolist(), strict=True)), rate, float(share[0])


class Sparse:
    """Rows of few features; products are made a slice of rows at a time, with a last column of ones."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int, step: int = 512):
        self.size, self.width, self.step = len(rows), width + 1, step
        self.edge = np.cumsum([0, *(len(at) for at, _ in rows)])
        self.at = np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)

    def slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, self.size, self.step):
            b = min(a + self.step, self.size)
            x = np.zeros((b - a, self.width), np.float32)
            x[:, -1] = 1
            part = slice(self.edge[a], self.edge[b])
            x[np.repeat(np.arange(b - a), np.diff(self.edge[a:b + 1])), self.at[part]] = self.value[part]
            yield slice(a, b), x


def train(x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression on soft labels by Newton steps; the last is the bias.

    One square of the number of features and one slice of rows are held at a time.
    """
    weight = weight / weight.mean()
    w = np.zeros(x.width)
    damp = np.full(x.width, ridge * x.size)
    damp[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = damp * w, np.diag(damp)
        for rows, part in x.slices():
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += ((p - y[rows]) * weight[rows]) @ part
            curve += (part * ((p * (1 - p) + 1e-6) * weight[rows])[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6 * max(1, np.abs(w).max()):
            break
    return w


def _words(value: pa.Scalar) -> tuple[bytes, list[bytes]]:
    raw = value.as_py() or b""
    return raw, raw.split()


def pattern_of(text: pa.Array) -> pa.Array:
    return pa.array([code(votes(*_words(v))) for v in text.cast(pa.large_binary())], pa.int32())


def sample_of(text: pa.Array) -> pa.Array:
    out = []
    for value in text.cast(pa.large_binary()):
        raw, words = _words(value)
        x = features(words)
        at = np.flatnonzero(x)
        out.append({"pattern": code(votes(raw, words)), "at": at.tolist(), "share": x[at].tolist()})
    return pa.array(out, pa.struct([("pattern", pa.int32()), ("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float64()))]))


def fit(docs: DataFrame, text_col: str = "text", fit_rows: int = 8192) -> tuple[dict[int, float], np.ndarray | None]:
    """Posterior by vote pattern over all documents, and the scorer's weights."""
    ship(docs.sparkSession)
    text = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(23)).alias("h"))
    counts = {r.pattern: r["count"] for r in text.select(arrow_udf(pattern_of, "int")("text").alias("pattern")).groupBy("pattern").count().collect()}
    posterior, _, _ = expectation_maximisation(counts)
    # the distinct texts of the smallest hashes, and how often each of them is there
    some = text.where("text is not null")
    drawn = {r.h: r["count"] for r in some.groupBy("h").count().orderBy("h").limit(fit_rows).collect()}
    if not drawn:
        return posterior, None
    sample = (
        some.where(F.col("h") <= max(drawn)).select("h", arrow_udf(sample_of, SAMPLE)("text").alias("x"))
        .groupBy("h").agg(F.any_value("x").alias("x")).orderBy("h").select("h", "x.*").toArrow()
    )
    at, share = sample.column("at").combine_chunks(), sample.column("share").combine_chunks()
    rows = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(at, share)]
    y = np.array([posterior[p] for p in sample.column("pattern").to_pylist()])
    weight = np.array([drawn[h] for h in sample.column("h").to_pylist()], np.float64)
    return posterior, train(Sparse(rows, WIDTH), y, weight)


def judged(docs: DataFrame, text_col: str = "text", fit_rows: int = 8192, name: str = "quality") -> DataFrame:
    """`docs` with a struct column (n_words, posterior, score, kept) for each text."""
    posterior, weights = fit(docs, text_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, None if weights is None else weights.tolist()))
    kind = pa.struct([("n_words", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    @arrow_udf("struct<n_words:long,posterior:double,score:double,kept:boolean>")
    def judge(text: pa.Array) -> pa.Array:
        by_pattern, w = shared.value
        w = None if w is None else np.array(w)
        out = []
        for value in text.cast(pa.large_binary()):
            raw, words = _words(value)
            post = by_pattern.get(code(votes(raw, words)), 0.5)
            if not words:
                score = 0.0
            elif w is None:
                score = post
            else:
                score = float(1 / (1 + np.exp(-np.clip(features(words) @ w[:-1] + w[-1], -30, 30))))
            out.append({"n_words": len(words), "posterior": post, "score": round(score, 6), "kept": bool(words) and score >= 0.5})
        return pa.array(out, kind)

    others = [c for c in docs.columns if c != name]
    return docs.select(*others, judge(F.col(text_col)).alias(name))


def digest(found: DataFrame, id_col: str = "doc_id", name: str = "quality") -> DataFrame:
    return found.select(id_col, f"{name}.*")
