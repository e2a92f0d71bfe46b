"""Language-model scores: word counts of the corpus, and a small causal self-attention model.

Texts are read once and packed into blocks of about BLOCK bytes: the distinct words of the
block with their counts in training documents and their subword ids, and every text as word
numbers. Blocks are stored; all that follows reads their columns.

Counts. Each block sends the hashes and counts of its words to buckets of the hash, a bucket
adds them up and answers every block with the totals of its words. A word of the corpus is
one entry per block, however often it stands there.

Model. Subwords are those of a public byte-level vocabulary (words in front of which a space
is put, letters lower-cased; an end-of-text id closes a text). Their counts and neighbours
over all training documents give classes of ids. One layer of causal self-attention with
relative places and a residual ReLU layer predicts the next id's class and which of the
frequent ids of the class it is; rarer ids share one entry of their class by their counts, so
all ids of the vocabulary have a probability and the sum is one. As there is one head, the matrices of
queries and keys, and those of values and output, are multiplied first. It is written in numpy:
every partition of blocks makes Adam steps from the same weights, and the weights are averaged,
`rounds` times. It learns from all windows of all training documents: they are dealt to the
rounds, as long as each round has LEAST_WINDOWS; of fewer, a round takes all. Blocks are dealt
whole where there are many (BLOCKS_A_TURN), else every block's windows.

Scores. A text's ids are cut into windows of SCORED new ids behind CONTEXT ids that were
scored before, so each id is scored once with CONTEXT to CONTEXT + SCORED - 1 ids before it
(fewer only where the text begins), batched with one mask.

Words are told apart by 64 bits of a hash and their bucket by other bits: for 1e9 distinct
words, the chance that any two are taken for one is below 3 %.

Defined cases: a null text is an empty one and has the end token alone; a null id is never
held out; repeated rows come back as they are, and count as often; without training
documents every base score is 0 and the model knows ids' uniform shares only; an empty table
gives an empty one; other columns are not read. A text is never cut, so a block is as long
as its longest text.
"""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.llm.common import buckets_for, keep, ship

BLOCK = 2 << 20
CONTEXT, SCORED = 8, 24
WIDE = CONTEXT + SCORED
CLASSES, HEADS = 32, 512
DIM, HIDDEN, NEIGHBOURS = 16, 16, 24
LEAST_WINDOWS, BATCH, STEPS = 32_768, 64, 100
BLOCKS_A_TURN = 8
_PIECES = r"\x20[^\x20]{0,200}|[^\x20]{1,200}"
_VOCABULARIES: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Subword ids of lower-cased words; `end` is one more id."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        assert self.size <= 1 << 16, "ids are kept in two bytes"
        self.coder = tiktoken.Encoding("words", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True

    @classmethod
    def of(cls, lines: bytes) -> "Vocabulary":
        key = str(hash(lines))
        if key not in _VOCABULARIES:
            _VOCABULARIES.clear()
            _VOCABULARIES[key] = cls(lines)
        return _VOCABULARIES[key]

    def encode(self, words: list[bytes]) -> tuple[bytes, bytes, np.ndarray]:
        """Hashes of words, 16 bytes each, their ids in a row, two bytes each, and how many each
        has. The empty word is the end of a text."""
        import xxhash

        real = np.fromiter(map(len, words), np.int64, len(words)) > 0
        full = words if real.all() else [w for w in words if w]
        ids = self.coder.encode_to_numpy((b" " + b" ".join(full)).decode(errors="replace"), disallowed_special=()) if full else np.zeros(0, np.uint32)
        begin = np.flatnonzero(self.begins[ids])
        size = np.ones(len(words), np.int64)
        size[real] = np.diff(begin, append=len(ids))
        ends = np.cumsum(size)[~real] - 1
        pieces = np.insert(ids.astype(np.uint16), ends - np.arange(len(ends)), self.end)
        return b"".join(map(xxhash.xxh3_128_digest, words)), pieces.tobytes(), size


def release() -> None:
    """Gives back what the process remembers of an earlier stage, and freed memory."""
    _VOCABULARIES.clear()
    trim()


def hold() -> None:
    """Keeps freed memory of steps, as far as the C library can: each step needs the same again."""
    call = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if call:
        call(-3, 32 << 20)  # M_MMAP_THRESHOLD
        call(-1, 64 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Gives freed memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    call = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if call:
        call(0)


# --- blocks -------------------------------------------------------------------------


def block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("n_words", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.BinaryType()) for c in ("at", "key", "count", "bound", "pieces", "n_pieces")],
    ])


def packed(ids: pa.Array, text: pa.Array, held: np.ndarray, vocabulary: Vocabulary, buckets: int) -> dict:
    """One block: word numbers of all texts (`at`), and by word, in the order of its bucket:
    hash, count in training texts, subword ids. `bound` has the first word of each bucket."""
    # `text` is a slice: lowered before it is cast, as Arrow lowers the wrong bytes of a slice of a large type
    words = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")).cast(pa.large_string()))
    flat = words.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    size = np.diff(np.asarray(words.offsets))
    before = np.r_[0, np.cumsum(real)]
    stops = np.cumsum(size)
    n_words = before[stops] - before[stops - size]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = [b"", *coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()]
    at = np.zeros(n_words.sum() + len(ids), np.int64)  # the empty word stands for the end of each text
    ends = np.cumsum(n_words + 1) - 1
    inner = np.ones(len(at), bool)
    inner[ends] = False
    at[inner] = np.asarray(coded.indices) + 1
    hashes, pieces, n_pieces = vocabulary.encode(names)
    hashes = np.frombuffer(hashes, ">u8").reshape(-1, 2)
    bucket = (hashes[:, 0] % buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at = place[at]
    trained = np.repeat(~held, n_words + 1)
    # the pieces in the order of the buckets as well
    start = (np.cumsum(n_pieces) - n_pieces)[order]
    n_pieces = n_pieces[order]
    edge = np.cumsum(n_pieces) - n_pieces
    pieces = np.frombuffer(pieces, np.uint16)[np.repeat(start - edge, n_pieces) + np.arange(n_pieces.sum())]
    return {
        "ids": ids.to_pylist(), "held": held.tolist(), "n_words": n_words.tolist(), "at": at.astype(np.int32).tobytes(),
        "key": hashes[order, 1].astype(np.uint64).tobytes(), "count": np.bincount(at[trained], minlength=len(names)).astype(np.int32).tobytes(),
        "bound": np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32).tobytes(),
        "pieces": pieces.tobytes(), "n_pieces": n_pieces.astype(np.int32).tobytes(),
    }


def blocks(docs: DataFrame, vocabulary: bytes, id_col: str, text_col: str, buckets: int, size: int = BLOCK) -> DataFrame:
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    schema = block_schema(docs.schema[id_col].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, made = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, text, out = batch.columns
            bytes_of = np.asarray(pc.binary_length(text).fill_null(0)).astype(np.int64)
            # a block begins where the bytes before a text pass a multiple of its size
            cut = np.flatnonzero(np.diff((np.cumsum(bytes_of) - bytes_of) // size, prepend=-1))
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                row = packed(ids[a:b], text[a:b], np.asarray(out[a:b]), Vocabulary.of(vocabulary), buckets)
                yield pa.RecordBatch.from_pylist([{"block": made, **row}], kind)
                made += 1
                del row
                trim()

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), held.alias("h")).mapInArrow(run, schema)


def array(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value, kind)


def each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, which are large, one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# --- counts -------------------------------------------------------------------------


def totals(store: DataFrame) -> DataFrame:
    """(block, bucket, counts, fresh): training counts of a block's words in a bucket; `fresh` adds
    up to the distinct words of the training texts."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            bound, key, count = array(r["bound"], np.int32), array(r["key"], np.uint64), array(r["count"], np.int32)
            some = np.flatnonzero(np.diff(bound))
            yield pa.record_batch([
                pa.array(some.astype(np.int32)), pa.array([r["block"]] * len(some), pa.int64()),
                pa.array([key[bound[k]:bound[k + 1]].tobytes() for k in some], pa.binary()),
                pa.array([_small(count[bound[k]:bound[k + 1]]) for k in some], pa.binary()),
            ], ["bucket", "block", "key", "count"])

    def add(group: pa.Table) -> pa.Table:
        keys = [array(k.as_py(), np.uint64) for k in group.column("key")]
        counts = [_large(c.as_py(), len(k)) for c, k in zip(group.column("count"), keys, strict=True)]
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        # whole numbers below 2^53 add up exactly
        total = np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)
        edges = np.cumsum([0, *map(len, keys)])
        fresh = np.zeros(len(keys), np.int64)
        fresh[0] = (total > 0).sum()
        return pa.table([
            group.column("block"), group.column("bucket"),
            pa.array([_small(total[where[a:b]]) for a, b in zip(edges, edges[1:])], pa.binary()), pa.array(fresh),
        ], ["block", "bucket", "counts", "fresh"])

    return (
        store.select("block", "key", "count", "bound")
        .mapInArrow(send, "bucket int, block long, key binary, count binary")
        .groupBy("bucket").applyInArrow(add, "block long, bucket int, counts binary, fresh long")
    )


def _small(values: np.ndarray) -> bytes:
    """Numbers in four bytes each where all fit, else in eight."""
    return values.astype(np.uint32 if len(values) and values.max() < 1 << 32 else np.uint64).tobytes()


def _large(value: bytes, size: int) -> np.ndarray:
    return array(value, np.uint32 if len(value) == 4 * size else np.uint64)


# --- subwords and classes ---------------------------------------------------------------


def subword_profiles(store: DataFrame, vocabulary_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count of every subword, and the sums of random signs of its left and right
    neighbours within words. At most one row per id of the vocabulary reaches the driver."""
    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the words of the blocks
        signs = np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (NEIGHBOURS, vocabulary_size + 1))
        count, near = np.zeros(vocabulary_size), np.zeros((2, NEIGHBOURS, vocabulary_size))
        for r in each(batches):
            weight = np.repeat(array(r["count"], np.int32).astype(np.float64), array(r["n_pieces"], np.int32))
            pieces = array(r["pieces"], np.uint16).astype(np.int64)
            first = np.zeros(len(pieces) + 1, bool)
            first[np.r_[0, np.cumsum(array(r["n_pieces"], np.int32))]] = True
            count += np.bincount(pieces, weight, vocabulary_size)
            left = np.where(first[:-1], vocabulary_size, np.r_[0, pieces[:-1]])
            right = np.where(first[1:], vocabulary_size, np.r_[pieces[1:], 0])
            for side, other in enumerate((left, right)):
                for k in range(NEIGHBOURS):  # one at a time, in memory of one
                    near[side, k] += np.bincount(pieces, weight * np.take(signs[k], other), vocabulary_size)
        ids = np.flatnonzero(count)
        for some in np.array_split(ids, -(-len(ids) // 4096)) if len(ids) else []:
            sums = pa.ListArray.from_arrays(
                np.arange(len(some) + 1, dtype=np.int32) * (2 * NEIGHBOURS), near[:, :, some].reshape(2 * NEIGHBOURS, -1).T.ravel())
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some].astype(np.int64)), sums], ["id", "count", "near"])

    # sums of signs times counts are whole numbers: exact and the same in any order
    sides = [F.sum(F.col("near")[k]).alias(f"s{k}") for k in range(2 * NEIGHBOURS)]
    rows = (
        store.select("count", "pieces", "n_pieces").mapInArrow(profile, "id int, count long, near array<double>")
        .groupBy("id").agg(F.sum("count").alias("count"), *sides).toArrow()
    )
    count, near = np.zeros(vocabulary_size, np.int64), np.zeros((vocabulary_size, 2 * NEIGHBOURS))
    ids = np.asarray(rows.column("id"))
    count[ids] = np.asarray(rows.column("count"))
    for k in range(2 * NEIGHBOURS):
        near[ids, k] = np.asarray(rows.column(f"s{k}"))
    return count, near


class Classes:
    """Two levels of the ids: CLASSES clusters by neighbours, and in each of them its heads, which
    are among the HEADS most frequent ids, and one entry for all of its other ids.

    entry of every id, log share of the id in its entry; class of every entry, `low` the first
    entry of each class (entries are ordered by class).
    """

    def __init__(self, count: np.ndarray, near: np.ndarray):
        near = near / np.maximum(1, count)[:, None]
        near /= np.maximum(1e-9, np.sqrt((near ** 2).sum(1)))[:, None]
        ranked = np.argsort(-count, kind="stable")
        seen = ranked[count[ranked] > 0]
        centre = near[seen[:CLASSES]]
        cluster = np.zeros(len(count), np.int64)
        if len(centre):
            weight = np.sqrt(count[seen])
            for _ in range(12):
                mine = (near[seen] @ centre.T).argmax(1)
                sums = np.stack([np.bincount(mine, weight * near[seen, k], len(centre)) for k in range(near.shape[1])], 1)
                norm = np.sqrt((sums ** 2).sum(1))
                centre = np.where(norm[:, None] > 0, sums / np.maximum(1e-9, norm)[:, None], centre)
            cluster = (near @ centre.T).argmax(1)
        head = np.zeros(len(count), bool)
        head[seen[:HEADS]] = True
        # entries: the heads and, after those of a class, its other ids
        owner = np.r_[cluster[head], np.arange(CLASSES)]
        order = np.argsort(owner, kind="stable")
        place = np.argsort(order, kind="stable")
        self.of_entry = owner[order]
        self.low = np.searchsorted(self.of_entry, np.arange(CLASSES + 1))
        self.entry = place[head.sum() + cluster]
        self.entry[head] = place[: head.sum()]
        mass = count + 0.5
        self.mass = np.bincount(self.entry, mass, len(owner))
        self.share = (np.log(mass) - np.log(self.mass[self.entry])).astype(np.float32)
        # of every id of two bytes, to look up places outside of a text as well
        self.entry_or_first = np.r_[self.entry, np.zeros((1 << 16) - len(count), np.int64)].astype(np.uint16)
        self.cells = np.arange(len(owner) * DIM).reshape(-1, DIM)  # numbers of an entry's embedding, row by row


# --- the model ----------------------------------------------------------------------------


def start_weights(classes: Classes) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)

    def made(*shape, scale=0.25):
        return rng.normal(0, scale, shape).astype(np.float32)

    entry = classes.mass + 1e-3
    whole = np.bincount(classes.of_entry, entry, CLASSES)
    return {
        "embed": made(len(entry), DIM), "wq": made(DIM, DIM), "wk": made(DIM, DIM), "wv": made(DIM, DIM), "wo": made(DIM, DIM),
        "near": np.zeros(WIDE, np.float32), "w1": made(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": made(HIDDEN, DIM, scale=0.1),
        "out": made(DIM, CLASSES, scale=0.1), "bias": np.log(whole / whole.sum()).astype(np.float32),
        "out_entry": made(DIM, len(entry), scale=0.1), "bias_entry": np.log(entry / whole[classes.of_entry]).astype(np.float32),
    }


#: Key j of a window is d = CONTEXT + i - j places before query i; only d >= 0 is seen, so places
#: behind the end of a text need no mask of their own: only queries that don't count see them.
_BACK = CONTEXT + np.arange(SCORED)[:, None] - np.arange(WIDE)[None, :]
_UNSEEN = np.where(_BACK < 0, np.float32(-1e9), np.float32(0))
_NEAR, _SEEN = np.maximum(_BACK, 0), (_BACK >= 0).ravel()


def exponentials(z: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """Makes logits exponentials in place, up to a factor of each row, and returns the rows' sums. Rows lie one after
    another, each beginning at its place of `begin`, or are those of a matrix. They are shifted only if one is out of range."""
    if z.size and (z.max() > 70 or z.min() < -50):
        z -= z.max(1, keepdims=True) if begin is None else np.repeat(np.maximum.reduceat(z, begin), np.diff(begin, append=len(z)))
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype) if begin is None else np.add.reduceat(z, begin) if len(begin) else z


def with_row(table: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty((len(table) + 1, table.shape[1]), table.dtype)
    out[:-1], out[-1] = table, row
    return out


def folded(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Products of the matrices of queries and keys, and of values and what follows: with them, attention reads the
    embeddings themselves as keys and values."""
    return w["wq"] @ w["wk"].T * w["wq"].dtype.type(DIM ** -0.5), w["wv"] @ w["wo"]


def gradients(w: dict, classes: Classes, windows: np.ndarray) -> tuple[dict, float]:
    """Of the mean cross-entropy of the targets' classes and of their entries in these."""
    kind, look, shape = w["embed"].dtype, np.take(classes.entry_or_first, windows), (-1, WIDE, DIM)
    c = look[:, :WIDE].ravel().astype(np.int64)
    x = np.take(w["embed"], c, axis=0)
    keys = x.reshape(shape)
    turned = np.take(w["embed"].T.copy(), c, axis=1).reshape(DIM, -1, WIDE).transpose(1, 0, 2)
    xq, (to_key, to_h) = keys[:, CONTEXT:].reshape(-1, DIM), folded(w)
    # masked attention of the queries of each window over its keys
    q = (xq @ to_key).reshape(-1, SCORED, DIM)
    s = np.matmul(q, turned)
    s += np.take(w["near"], _NEAR) + _UNSEEN
    begins = np.flatnonzero(windows[:, 0] == OUTSIDE)
    s[begins, :, :CONTEXT] = -1e9  # only what is missing in front of a text
    if s.max() > 60:
        np.minimum(s, kind.type(60), out=s)
    np.exp(s, out=s)
    s *= (1 / (s.reshape(-1, WIDE) @ np.ones(WIDE, kind))).reshape(-1, SCORED, 1)
    a = np.matmul(s, keys).reshape(-1, DIM)
    h1 = a @ to_h
    h1 += xq
    r = h1 @ w["w1"]
    r += w["b1"]
    np.maximum(r, 0, out=r)
    h = np.empty((len(r), DIM + 1), kind)  # a column of ones adds biases
    h[:, DIM] = 1
    np.add(r @ w["w2"], h1, out=h[:, :DIM])
    # the rows that count, in the order of their entries and so of their classes
    on, goal_entry = np.flatnonzero(windows[:, WIDE:].ravel() != OUTSIDE), look[:, WIDE:].ravel()
    if len(on) < len(goal_entry):
        goal_entry = goal_entry[on]
    order = np.argsort(goal_entry, kind="stable")  # two bytes are sorted by digits
    on, goal_entry, n = on[order], goal_entry[order].astype(np.int64), max(1, len(on))
    hs = np.take(h, on, axis=0)
    edges = np.searchsorted(goal_entry, classes.low)
    size, wide = edges[1:] - edges[:-1], classes.low[1:] - classes.low[:-1]

    def step(z: np.ndarray, begin: np.ndarray, at: np.ndarray, widths: np.ndarray | None) -> float:
        """Makes logits the derivatives by them, and returns the loss."""
        total, flat, at = exponentials(z, None if widths is None else begin), z.reshape(-1), begin + at
        share = np.take(flat, at) / total
        factor = 1 / (n * total)
        z *= factor[:, None] if widths is None else np.repeat(factor, widths)
        flat[at] = (share - 1) / n
        return float(-np.log(np.maximum(share, 1e-30)).sum() / n)

    out = with_row(w["out"], w["bias"])
    d = hs @ out
    loss = step(d, np.arange(0, d.size, CLASSES), np.repeat(np.arange(CLASSES), size), None)
    g_out, dhs = hs.T @ d, np.zeros((len(on) + 1, DIM), kind)  # one row more, for those that don't count
    np.dot(d, w["out"].T, dhs[:-1])
    # logits of the entries of each row's class, one row after another
    to_entry, back = with_row(w["out_entry"], w["bias_entry"]), w["out_entry"].T
    g_entry, dhs_entry = np.zeros(to_entry.T.shape, kind), np.empty((len(on), DIM), kind)
    widths = np.repeat(wide, size)
    begin = np.cumsum(widths)
    flat = np.empty(begin[-1] if len(on) else 0, kind)
    begin -= widths
    parts, at, ends, low = [], 0, edges.tolist(), classes.low.tolist()
    for a0, a1, low0, low1 in zip(ends, ends[1:], low, low[1:]):
        if a0 < a1:
            to = at + (a1 - a0) * (low1 - low0)
            rows, z = hs[a0:a1], flat[at:to].reshape(a1 - a0, low1 - low0)
            np.matmul(rows, to_entry[:, low0:low1], out=z)
            parts.append((rows, z, back[low0:low1], g_entry[low0:low1], dhs_entry[a0:a1]))
            at = to
    loss += step(flat, begin, goal_entry - np.repeat(classes.low[:-1], size), widths)
    for rows, z, its, g_its, d_rows in parts:
        np.dot(z.T, rows, g_its)
        np.matmul(z, its, out=d_rows)
    dhs[:-1] += dhs_entry
    g = {"out": g_out[:DIM], "bias": g_out[DIM], "out_entry": g_entry[:, :DIM].T, "bias_entry": g_entry[:, DIM]}
    # the layer and the attention
    row_of = np.full(len(h), len(on))
    row_of[on] = np.arange(len(on))
    dh = np.take(dhs, row_of, axis=0)
    dr = dh @ w["w2"].T
    dr *= r > 0
    g |= {"w2": r.T @ dh, "w1": h1.T @ dr, "b1": np.ones(len(dr), kind) @ dr}
    dh += dr @ w["w1"].T
    by_h = a.T @ dh
    da = dh @ to_h.T
    inner = ((da * a) @ np.ones(DIM, kind)).reshape(-1, SCORED, 1)
    da = da.reshape(q.shape)
    ds = np.matmul(da, turned)
    ds -= inner
    ds *= s
    dx = np.matmul(s.transpose(0, 2, 1), da)
    dx += np.matmul(ds.transpose(0, 2, 1), q)
    dq = np.matmul(ds, keys).reshape(-1, DIM)
    by_place = np.ones(len(ds), kind) @ ds.reshape(len(ds), -1)
    by_key = xq.T @ dq * kind.type(DIM ** -0.5)
    g |= {"near": np.bincount(_NEAR.ravel(), by_place * _SEEN, WIDE), "wq": by_key @ w["wk"], "wk": by_key.T @ w["wq"],
          "wv": by_h @ w["wo"].T, "wo": w["wv"].T @ by_h}
    dh += dq @ to_key.T
    dx[:, CONTEXT:] += dh.reshape(q.shape)
    g["embed"] = np.bincount(np.take(classes.cells, c, axis=0).ravel(), dx.ravel(), w["embed"].size).reshape(-1, DIM)
    return g, loss


def local_steps(w: dict, classes: Classes, windows: np.ndarray | Iterable[np.ndarray], seed: int, rate: float) -> tuple[dict, int]:
    """Adam over all windows of one partition, one block after another; where they are few, again until STEPS are made."""
    flat = np.concatenate([value.ravel() for value in w.values()])
    edges = np.cumsum([0, *[value.size for value in w.values()]])
    w = {name: flat[a:b].reshape(value.shape) for (name, value), a, b in zip(w.items(), edges, edges[1:])}
    first, second, g, step = (np.zeros_like(flat) for _ in range(4))
    rng, done, few, n = np.random.default_rng(seed), 0, [], 0

    def over(windows: np.ndarray) -> None:
        nonlocal done
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            by_name, _ = gradients(w, classes, windows[order[a:a + BATCH]])
            np.concatenate([by_name[name].ravel() for name in w], out=g, casting="same_kind")
            done += 1
            # all weights at once, in memory that is there
            np.subtract(g, first, out=step)
            np.multiply(step, 0.1, out=step)
            np.add(first, step, out=first)
            np.multiply(g, g, out=g)
            np.subtract(g, second, out=g)
            np.multiply(g, 0.01, out=g)
            np.add(second, g, out=second)
            np.divide(second, 1 - 0.99 ** done, out=g)
            np.sqrt(g, out=g)
            np.add(g, 1e-8, out=g)
            np.divide(first, g, out=step)
            np.multiply(step, rate / (1 - 0.9 ** done), out=step)
            np.subtract(flat, step, out=flat)

    for part in [windows] if isinstance(windows, np.ndarray) else windows:
        over(part)
        if n < STEPS * BATCH:
            few.append(part)
            n += len(part)
    while n and done < STEPS:
        over(np.concatenate(few))
    return w, done


def log_sum(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials by row; rows are shifted only if one is out of range."""
    with np.errstate(over="ignore"):
        total = np.exp(logits) @ np.ones(logits.shape[1], np.float32)
    if len(total) and not (total.min() > 1e-25 and total.max() < 1e35):
        top = logits.max(1)
        return top + np.log(np.exp(logits - top[:, None]).sum(1))
    return np.log(total)


class Scorer:
    """Log probability of windows' targets; what depends on an entry alone is looked up."""

    def __init__(self, w: dict, classes: Classes):
        to_key, self.to_h = folded(w)
        self.w, self.classes, self.turned = w, classes, w["embed"].T.copy()
        self.q, self.near = w["embed"] @ to_key, w["near"][_NEAR] + _UNSEEN
        self.out, self.out_entry = with_row(w["out"], w["bias"]), with_row(w["out_entry"], w["bias_entry"])

    def hidden(self, c: np.ndarray, first: np.ndarray, h: np.ndarray) -> None:
        """Fills `h` with the hidden rows of the queries of windows, of which `first` begin their text
        (nothing in front of it)."""
        w = self.w
        keys = np.take(w["embed"], c, axis=0)
        turned = np.take(self.turned, c.ravel(), axis=1).reshape(DIM, -1, WIDE).transpose(1, 0, 2)
        s = np.matmul(np.take(self.q, c[:, CONTEXT:], axis=0), turned)
        s += self.near
        s[first, :, :CONTEXT] = -1e9
        if s.max() > 60:
            np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)
        a = np.matmul(s, keys).reshape(-1, DIM)
        a *= (1 / (s.reshape(-1, WIDE) @ np.ones(WIDE, np.float32)))[:, None]
        h1 = a @ self.to_h
        h1 += keys[:, CONTEXT:].reshape(-1, DIM)
        r = h1 @ w["w1"]
        r += w["b1"]
        np.maximum(r, 0, out=r)
        np.add(r @ w["w2"], h1, out=h)

    def __call__(self, windows: np.ndarray, first: np.ndarray, step: int = 64) -> np.ndarray:
        """Natural log of the probability of each window's targets, 0 where there is none."""
        classes = self.classes
        c, h = np.take(classes.entry_or_first, windows), np.empty((len(windows) * SCORED, DIM + 1), np.float32)
        h[:, DIM] = 1  # adds biases
        for a in range(0, len(c), step):
            part = slice(a, a + step)
            self.hidden(c[part, :WIDE].astype(np.int64), np.flatnonzero(first[part]), h[a * SCORED:(a + step) * SCORED, :DIM])
        targets = windows[:, WIDE:].ravel()
        on, goal_entry = np.flatnonzero(targets != OUTSIDE), c[:, WIDE:].ravel()
        order = np.argsort(goal_entry[on], kind="stable")  # by entry, and so by class; two bytes are sorted by digits
        on = on[order]
        goal_entry, goal_id = goal_entry[on].astype(np.int64), targets[on]
        found = np.take(classes.share, goal_id).astype(np.float64)
        edges = np.searchsorted(goal_entry, classes.low).tolist()
        for kind, (a, b) in enumerate(zip(edges, edges[1:])):
            low, high = classes.low[kind], classes.low[kind + 1]
            for at in range(a, b, 1024):  # in memory that stays near
                rows = slice(at, min(at + 1024, b))
                hs = np.take(h, on[rows], axis=0)
                z, top = hs @ self.out_entry[:, low:high], hs @ self.out
                hit = np.take(z.ravel(), np.arange(-low, len(z) * (high - low) - low, high - low) + goal_entry[rows]) + top[:, kind]
                found[rows] += hit - log_sum(z) - log_sum(top)
        out = np.zeros(targets.size)
        out[on] = found
        return out.reshape(-1, SCORED)


# --- windows --------------------------------------------------------------------------------

#: Marks places of a window outside of its text; no vocabulary has this id.
OUTSIDE = 0xFFFF


def streams(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts of a block in a row, ends included, and where each text starts."""
    n_pieces, pieces = array(row["n_pieces"], np.int32).astype(np.int64), array(row["pieces"], np.uint16)
    at = array(row["at"], np.int32)
    size = n_pieces[at]
    starts = (np.cumsum(n_pieces) - n_pieces)[at]
    edge = np.r_[0, np.cumsum(size)]
    ids = pieces[np.repeat(starts - edge[:-1], size) + np.arange(edge[-1])]
    n_words = np.array(row["n_words"], np.int64)
    return ids, edge[np.r_[0, np.cumsum(n_words + 1)]]


def windows_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first scored place (in its stream) of every window."""
    size = np.diff(begin)
    n = -(-size // SCORED)
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SCORED


def cut(ids: np.ndarray, begin: np.ndarray, text: np.ndarray, place: np.ndarray, end: int) -> np.ndarray:
    """Windows, at places of `windows_of`, as WIDE + SCORED ids: inputs and targets, OUTSIDE where the text
    has none. The input before a text's first id is the end id."""
    before = np.full(CONTEXT + 1, OUTSIDE, np.uint16)  # the input is the id before
    padded = np.concatenate([before, ids, np.full(SCORED, OUTSIDE, np.uint16)])
    start, left = begin[text] + place, begin[text + 1] - begin[text] - place
    near = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + 1 + SCORED)[start]
    out = np.concatenate([near[:, :WIDE], near[:, CONTEXT + 1:]], 1)
    first, last = np.flatnonzero(place == 0), np.flatnonzero(left < SCORED)
    out[first, :CONTEXT], out[first, CONTEXT] = OUTSIDE, end
    # behind the last id, which is no input
    over = np.r_[np.arange(-CONTEXT, SCORED), np.arange(SCORED)] >= left[last, None]
    out[last] = np.where(over, OUTSIDE, out[last])
    return out


def opened(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input ids and which are there, target ids and which are there (0 stands for the others)."""
    ids, target = windows[:, :WIDE].astype(np.int64), windows[:, WIDE:].astype(np.int64)
    valid, counts = ids != OUTSIDE, target != OUTSIDE
    return np.where(valid, ids, 0), valid, np.where(counts, target, 0), counts


def train_windows(row: dict, end: int, turn: int = 0, turns: int = 1) -> np.ndarray:
    """Windows of the training texts of a block, one in `turns` of them."""
    ids, begin = streams(row)
    text, place = windows_of(begin)
    mine = np.flatnonzero(~np.array(row["held"], bool)[text])[turn::turns]
    return cut(ids, begin, text[mine], place[mine], end)


def gathered(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Blocks' windows together, LEAST_WINDOWS or more at a time, so that steps mix texts of several blocks."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += len(part)
        if n >= LEAST_WINDOWS:
            yield np.concatenate(some)
            some, n = [], 0
    if n:
        yield np.concatenate(some)


def averaged(
    store: DataFrame, w: dict, classes: Classes, end: int, turn: int, turns: int, seed: int, rate: float, parts: int = 32
) -> dict:
    """One round: local steps in every partition, weights averaged by steps in `parts` slices."""
    spark = store.sparkSession
    shared = spark.sparkContext.broadcast((w, classes))  # sized by the vocabulary

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold()
        task = TaskContext.get().partitionId()
        windows = gathered(train_windows(r, end, turn, turns) for r in each(batches))
        made, steps = local_steps(*shared.value, windows, seed + task, rate)
        if steps:
            flat = np.concatenate([made[name].ravel() for name in sorted(made)]).astype(np.float64)
            for k, slice_ in enumerate(np.array_split(flat, parts)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([steps], pa.int64()), pa.array([slice_.tobytes()], pa.binary())],
                                      ["slice", "task", "steps", "weights"])

    def mean(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["task"])
        total = sum(r["steps"] for r in rows)
        value = sum(array(r["weights"], np.float64) * (r["steps"] / total) for r in rows)
        return pa.table([pa.array([rows[0]["slice"]], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["slice", "weights"])

    found = (
        store.select("held", "n_words", "at", "pieces", "n_pieces").mapInArrow(train, "slice int, task int, steps long, weights binary")
        .groupBy("slice").applyInArrow(mean, "slice int, weights binary").collect()
    )
    shared.unpersist()
    if not found:
        return w
    flat = np.concatenate([array(r.weights, np.float64) for r in sorted(found)])
    edges = np.cumsum([0, *[w[name].size for name in sorted(w)]])
    return {name: flat[a:b].reshape(w[name].shape).astype(np.float32) for name, a, b in zip(sorted(w), edges, edges[1:])}


def text_scores(scorer: Scorer, row: dict, end: int, batch: int = 2048) -> np.ndarray:
    """log10 probability of each text of a block."""
    ids, begin = streams(row)
    text, place = windows_of(begin)
    out = np.zeros(len(text))
    for a in range(0, len(text), batch):
        part = slice(a, a + batch)
        out[part] = scorer(cut(ids, begin, text[part], place[part], end), place[part] == 0).sum(1)
    return np.bincount(text, out, len(begin) - 1) / np.log(10)


def base_scores(row: dict, totals_of: np.ndarray, n: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log10 shares of each text's words, and how many of them training texts have."""
    words = np.log10((totals_of + 0.5) / (n + 0.5 * (distinct + 1)))
    at = array(row["at"], np.int32)
    text = np.repeat(np.arange(len(row["n_words"])), np.array(row["n_words"], np.int64) + 1)
    return np.bincount(text, words[at], len(row["n_words"])), np.bincount(text, totals_of[at] > 0, len(row["n_words"]))


# --- the operator ------------------------------------------------------------------------------


def trained(store: DataFrame, vocabulary: bytes, rounds: int) -> tuple[dict, Classes]:
    words = Vocabulary.of(vocabulary)
    count, near = subword_profiles(store, words.size)
    classes = Classes(count, near)
    w = start_weights(classes)
    ids = int(count.sum())
    if ids:
        turns = max(1, min(rounds, int(ids / SCORED / LEAST_WINDOWS)))
        # STEPS or more for each task
        dealt = store.coalesce(max(1, int(max(ids / SCORED / turns, LEAST_WINDOWS) / STEPS / BATCH)))
        whole = store.count() >= BLOCKS_A_TURN * turns  # whole blocks to a round, or some windows of each
        for k in range(rounds):
            mine = dealt.where((F.shiftright("block", 32) + F.col("block")) % turns == k % turns) if whole else dealt
            w = averaged(mine, w, classes, words.end, *((0, 1) if whole else (k % turns, turns)), 1000 * k, 0.02 / (1 + k))
    return w, classes


def scored(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    `vocabulary` is the content of a file of base64 pieces and ranks, one a line.
    """
    spark = docs.sparkSession
    store = keep(blocks(docs, vocabulary, id_col, text_col, buckets_for(docs, 1)), "lm-blocks")
    answers = keep(totals(store), "lm-totals")
    distinct = answers.agg(F.sum("fresh")).first()[0] or 0
    model = trained(store, vocabulary, rounds)
    end = Vocabulary.of(vocabulary).end
    shared = spark.sparkContext.broadcast(model)  # sized by the vocabulary
    n = _train_tokens(store)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    cache: list[Scorer] = []

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not cache:
            hold()
            cache.append(Scorer(*shared.value))
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
        out = []
        for row in left.to_pylist():  # one block
            bound = np.diff(array(row["bound"], np.int32))
            total = np.concatenate([_large(value, bound[bucket]).astype(np.int64) for bucket, value in parts])
            base, known = base_scores(row, total, n, distinct)
            model_score = text_scores(cache[0], row, end)
            columns = [row["ids"], row["held"], [x + 1 for x in row["n_words"]], known.astype(np.int64), [n] * len(base), base, model_score]
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], to_arrow_schema(schema)))
        return pa.concat_tables(out)

    mine = store.select("block", "ids", "held", "n_words", "at", "bound", "pieces", "n_pieces")
    return mine.groupBy("block").cogroup(answers.select("block", "bucket", "counts").groupBy("block")).applyInArrow(score, schema)


def _train_tokens(store: DataFrame) -> int:
    """Tokens of all training texts, ends included."""
    per_text = F.arrays_zip("held", "n_words")
    total = F.aggregate(per_text, F.lit(0).cast("long"), lambda s, x: s + F.when(~x["held"], x["n_words"] + 1).otherwise(0))
    return store.agg(F.sum(total)).first()[0] or 0
