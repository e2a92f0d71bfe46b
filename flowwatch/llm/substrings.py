"""Removal of repeated word windows by Rabin-Karp hashes.

Every run of `width` words gets a polynomial hash: 64 bits of one base within the bucket
that the top bits of a second base name, so that a chance match among n windows needs
about 2^(64 + log2 buckets) > n^2 to hold; buckets grow with the input. Per batch of
texts, equal (window, document) pairs collapse and a window that several documents of the
batch hold goes out once, for the smallest id; the others are known to be repeats and
pass through buckets of their own. A window thus reaches its bucket at most once per
batch, however many documents share it. A bucket finds the smallest id per window and
returns the windows that have one below their own, dealt by document. Those meet the text
again, where covered words merge into maximal removal intervals.

Defined cases: null or short texts have no window; a null id counts as larger than any
other and rows without id don't repeat each other; rows with one id are one document that
does not repeat itself, and each gets its own result row; ties cannot arise, ids decide;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import arrow_map, buckets_for, ship

#: Odd bases of the two polynomials, and the place of a null id.
BASE, SIDE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
LAST = np.iinfo(np.int64).max
_MASK = (1 << 64) - 1
_CHUNK = 2 << 20


class Codes(dict):
    """64-bit code of a word, made once per word while the table is below `most`."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = Codes()


def codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def window_hashes(code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every window, by Horner's rule over whole columns."""
    n = len(code) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(width):
        part = code[j : j + n]
        first *= np.uint64(BASE)
        first += part
        second *= np.uint64(SIDE)
        second += part
    return mixed(first), mixed(second)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits mixed in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def bucket_of(second: np.ndarray, buckets: int) -> np.ndarray:
    return ((second >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def split(texts: pa.Array) -> Iterator[list[bytes]]:
    """Words of each text of a string column, as bytes."""
    for value in texts.cast(pa.large_binary()):
        raw = value.as_py()
        yield raw.split() if raw else []


def planes(values: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane, compressed: planes that vary little cost little."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), "zstd", asbytes=True)


def unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def packed(hashes: np.ndarray) -> bytes:
    """Numbers of one row: differences of neighbours, which are small where they ascend."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplaned(data, n, np.uint64), dtype=np.uint64)


def pair_rows(
    first: np.ndarray, bucket: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int
) -> pa.RecordBatch:
    """Rows (bucket, known, hashes, docs, n, ids, n_ids) of one batch's (window, document) pairs.

    `doc` numbers `ids`, which ascends, so the smallest number of a window is its
    smallest id.
    """
    order = np.lexsort((doc, first, bucket))
    first, bucket, doc = first[order], bucket[order], doc[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    later = fresh & ~new
    known_at = doc[later].astype(np.uint64) % np.uint64(buckets)
    again = np.argsort(known_at, kind="stable")
    rows: list[tuple] = []
    for known, b, h, d in (
        (False, bucket[new], first[new], doc[new]), (True, known_at[again], first[later][again], doc[later][again])
    ):
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, int)
        for i, j in zip(cut, np.append(cut, len(b))[1:], strict=True):
            used, local = np.unique(d[i:j], return_inverse=True)
            local = local.astype(np.uint32)
            rows.append((int(b[i]), known, packed(h[i:j]), planes(local), j - i, packed(ids[used].view(np.uint64)), len(used)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32()))],
        names=["bucket", "known", "hashes", "docs", "n", "ids", "n_ids"],
    )


def repeats(width: int, buckets: int):
    """mapInArrow function: the pairs of a batch of texts."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        own = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, number = np.unique(own, return_inverse=True)
        parts, size = [], 0
        for doc, words in zip(number, split(batch.column(1)), strict=True):
            if len(words) < width:
                continue
            first, second = window_hashes(codes(words), width)
            parts.append((first, bucket_of(second, buckets).astype(np.int32), np.full(len(first), doc, np.uint32)))
            size += len(first)
            if size >= _CHUNK:
                yield pair_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)), ids, buckets)
                parts, size = [], 0
        if parts:
            yield pair_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)), ids, buckets)

    return run


def judge(buckets: int):
    """applyInArrow function of one bucket: the windows of each document that a smaller
    document also holds, as rows (place, docs, hashes, n), a place being a bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        h, d, out_h, out_d = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for known, hashes, docs, n, ids, n_ids in zip(
            *(table.column(c).to_pylist() for c in ("known", "hashes", "docs", "n", "ids", "n_ids")), strict=True
        ):
            ds = unpacked(ids, n_ids).view(np.int64)[unplaned(docs, n, np.uint32)]
            (out_h if known else h).append(unpacked(hashes, n))
            (out_d if known else d).append(ds)
        if h:
            hs, ds = np.concatenate(h), np.concatenate(d)
            order = np.argsort(hs)
            hs, ds = hs[order], ds[order]
            start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            least = np.minimum.reduceat(ds, start)
            worse = ds > np.repeat(least, np.diff(np.r_[start, len(hs)]))
            out_h.append(hs[worse])
            out_d.append(ds[worse])
        hs, ds = np.concatenate(out_h), np.concatenate(out_d)
        place = (mixed(ds.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((hs, place))
        hs, ds, place = hs[order], ds[order], place[order]
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(ds) else np.empty(0, int)
        rows = list(zip(start, np.append(start, len(ds))[1:], strict=True))
        return pa.table({
            "place": pa.array(place[start], pa.int32()), "docs": pa.array([planes(ds[i:j]) for i, j in rows], pa.binary()),
            "hashes": pa.array([packed(hs[i:j]) for i, j in rows], pa.binary()), "n": pa.array([j - i for i, j in rows], pa.int32()),
        })

    return run


def gathered(table: pa.Table) -> pa.Table:
    """Of one place: the repeated windows of each document, (doc, repeated)."""
    cells = list(zip(*(table.column(c).to_pylist() for c in ("docs", "hashes", "n")), strict=True))
    ds = np.concatenate([unplaned(d, n, np.int64) for d, _, n in cells])
    hs = np.concatenate([unpacked(h, n) for _, h, n in cells])
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    start = np.flatnonzero(np.r_[True, ds[1:] != ds[:-1]])
    end = np.append(start, len(ds))[1:]
    return pa.table({
        "doc": pa.array(ds[start], pa.int64()),
        "repeated": pa.array([hs[i:j].tobytes() for i, j in zip(start, end, strict=True)], pa.binary()),
    })


def removals(
    docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """(id, n_words, intervals, kept): per text its words, the maximal removed intervals
    (word numbers, end exclusive) and what is left, joined by one space."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if buckets is None:
        buckets = buckets_for(rows)
    pairs = arrow_map(
        rows, repeats(width, buckets), "bucket int, known boolean, hashes binary, docs binary, n int, ids binary, n_ids int"
    )
    found = (
        pairs.groupBy("bucket").applyInArrow(judge(buckets), "place int, docs binary, hashes binary, n int")
        .groupBy("place").applyInArrow(gathered, "doc long, repeated binary")
    )
    joined = (
        rows.withColumn("key", F.coalesce("doc", F.lit(int(LAST)))).join(
            found.withColumnRenamed("doc", "key"), "key", "left"
        ).select("doc", "text", "repeated")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(joined, cut_out(width), "doc long, n_words long, intervals array<struct<start:long,end:long>>, kept string")
    return out.select(F.col("doc").cast(kind).alias(id_col), "n_words", "intervals", "kept")


def cut_out(width: int):
    """mapInArrow function: words covered by repeated windows, and the rest of the text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        count, intervals, kept = [], [], []
        for words, repeated in zip(split(batch.column(1)), batch.column(2), strict=True):
            count.append(len(words))
            parts = repeated.as_py()
            if not parts:
                intervals.append([])
                kept.append(b" ".join(words))
                continue
            bad = np.frombuffer(parts, np.uint64)
            hit = np.isin(window_hashes(codes(words), width)[0], bad)
            step = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(step, at, 1)
            np.add.at(step, at + width, -1)
            covered = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, covered, False]))
            runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            intervals.append([{"start": a, "end": b} for a, b in runs])
            left, before = [], 0
            for a, b in runs:
                left += words[before:a]
                before = b
            kept.append(b" ".join(left + words[before:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(intervals, kind),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc", "n_words", "intervals", "kept"],
        )

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
