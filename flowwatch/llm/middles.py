"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one array of bytes. A scan of its white space gives the end of every
unit (white space and the word after it; a trailing run of white space is a unit of its
own), two hashed draws per document pick its cuts, and every cut changes how far the bytes
after it move: these changes go into a difference array, its cumulative sum is the shift of
each byte, and one scatter builds all outputs of the batch. `restored` reads the markers of
an output, makes the same kind of shifts from them and gathers the bytes back.

Draws depend on seed and id alone, so reruns and other partitionings agree. Bytes are cut
between units only, so never inside a code point.

Defined cases: a null text is an empty one; an empty text and one that holds a marker stay
plain, as do the documents that the draw leaves; equal rows give equal rows; a null id draws
like the empty string; other columns of the input are passed on, unless they are named like
a column that is added; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.llm.common import arrow_map

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ADDED = [
    ("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()),
    ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()),
    ("output", T.StringType(), pa.string()),
]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Order of the parts of a form (0 prefix, 1 middle, 2 suffix) and the marker before each.
FORMS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
#: Bytes of text that are turned at once; a longer text is turned alone.
CHUNK = 4 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts (one entry more than texts); null is empty."""
    texts = pa.array(texts.cast(pa.large_binary()).fill_null(b""), pa.large_binary())
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def unit_ends(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End (exclusive) of every unit of every text, and how many units come before each text."""
    space = _SPACE[raw]
    last = np.zeros(len(raw), bool)
    last[:-1] = space[1:] & ~space[:-1]  # a word ends where white space follows it,
    last[at[1:][at[1:] > at[:-1]] - 1] = True  # and a text's last unit where the text does
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, at, "right")


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per id."""
    hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 4).astype(np.int64)


def scattered(raw: np.ndarray, at: np.ndarray, cuts: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all outputs in a row, and where each output starts.

    `cuts` has the byte at which the middle and the suffix of each text start.
    """
    size = np.diff(at)
    turned = np.array([f != "plain" for f in forms], bool)
    marks = sum(map(len, (PREFIX, SUFFIX, MIDDLE)))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(size + marks * turned, out=out_at[1:])
    lengths = np.stack([cuts[:, 0] - at[:-1], cuts[:, 1] - cuts[:, 0], at[1:] - cuts[:, 1]], 1)
    starts = np.stack([at[:-1], cuts[:, 0], cuts[:, 1]], 1)  # of each part in the input
    goal = starts - at[:-1, None] + out_at[:-1, None]  # and in the output: plain texts only move as a whole
    out = np.zeros(out_at[-1], np.uint8)
    for form, parts in FORMS.items():
        mine = np.flatnonzero([f == form for f in forms])
        place = out_at[mine].copy()
        for part, mark in parts:
            for k, byte in enumerate(mark):
                out[place + k] = byte
            place += len(mark)
            goal[mine, part] = place
            place += lengths[mine, part]
    out[np.arange(len(raw)) + shifts(starts, goal, lengths, len(raw))] = raw
    return out, out_at


def shifts(starts: np.ndarray, goal: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """How far each of `size` bytes moves, if the runs of `lengths` at `starts`, which cover all
    of them, move to `goal`: cumulative sum of what changes where a run starts."""
    some = lengths.ravel() > 0
    begin, move = starts.ravel()[some], (goal - starts).ravel()[some]
    change = np.zeros(size, np.int64)
    change[begin] = np.diff(move, prepend=0)
    return np.cumsum(change)


def gathered(raw: np.ndarray, at: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made of, from the outputs and their forms alone."""
    whole = raw.tobytes()
    starts = np.repeat(at[:-1, None], 3, 1)  # of prefix, middle, suffix in the output
    lengths = np.zeros((len(forms), 3), np.int64)
    for k, form in enumerate(forms):
        a, b = int(at[k]), int(at[k + 1])
        if form == "plain":
            lengths[k, 0] = b - a
            continue
        found = [(part, whole.index(mark, a, b), len(mark)) for part, mark in FORMS[form]]
        for (part, here, mark), end in zip(found, [*(f[1] for f in found[1:]), b], strict=True):
            starts[k, part], lengths[k, part] = here + mark, end - here - mark
    text_at = np.zeros(len(at), np.int64)
    np.cumsum(lengths.sum(1), out=text_at[1:])
    goal = text_at[:-1, None] + np.cumsum(lengths, 1) - lengths  # place of each part in the text
    return raw[np.arange(text_at[-1]) + shifts(goal, starts, lengths, int(text_at[-1]))], text_at


def chars(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position of `at`: bytes that continue none."""
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at]


def strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    data = pa.py_buffer(raw.tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), data]).cast(pa.string())


def chunks(texts: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    at = flat(texts)[1]
    out, low = [], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
        out.append((low, high))
        low = high
    return out


def turn(batch: pa.RecordBatch, id_col: str, text_col: str, seed: int, rate: int, spm: int) -> pa.RecordBatch:
    """The added columns of a batch."""
    raw, at = flat(batch.column(text_col))
    ends, before = unit_ends(raw, at)
    n = np.diff(before)
    h = draws(batch.column(id_col).to_pylist(), seed)
    picked = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)], 1), 1)
    edges = np.r_[ends, 0]  # the last entry serves texts without units
    cuts = np.where(picked > 0, edges[np.where(picked > 0, before[:-1, None] + picked - 1, -1)], at[:-1, None])
    whole = raw.tobytes()
    forms = []
    for k in range(batch.num_rows):
        a, b = int(at[k]), int(at[k + 1])
        marked = any(whole.find(m, a, b) >= 0 for m in (PREFIX, SUFFIX, MIDDLE))
        forms.append("plain" if a == b or marked or h[k, 2] % 100 >= rate else "spm" if h[k, 3] % 100 < spm else "psm")
    plain = np.array([f == "plain" for f in forms], bool)
    cuts[plain] = at[1:][plain, None]
    place = chars(raw, np.concatenate([at[:-1, None], cuts], 1))
    out, out_at = scattered(raw, at, cuts, forms)
    return pa.record_batch([
        pa.array(n, pa.int64()), pa.array(forms, pa.string()),
        pa.array(place[:, 1] - place[:, 0], pa.int64(), mask=plain), pa.array(place[:, 2] - place[:, 1], pa.int64(), mask=plain),
        strings(out, out_at),
    ], [name for name, _, _ in ADDED])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
) -> DataFrame:
    """`docs` with n (units), form, prefix_chars, middle_chars and output in place of the text.

    `rate` per cent of documents are turned, `spm` per cent of these with the suffix first.
    """
    names = {name for name, _, _ in ADDED}
    others = [c for c in docs.columns if c not in names and c != text_col]
    # the id and text under names of their own, so that no column of the input can clash
    source = docs.select(F.col(id_col).alias("_fim_id"), F.col(text_col).alias("_fim_text"), *others)
    fields = [docs.schema[c] for c in others] + [T.StructField(name, kind) for name, kind, _ in ADDED]

    def rows(batch: pa.RecordBatch):
        for low, high in chunks(batch.column("_fim_text")):
            part = batch.slice(low, high - low)
            made = turn(part, "_fim_id", "_fim_text", seed, rate, spm)
            yield pa.RecordBatch.from_arrays(part.columns[2:] + made.columns, names=[*others, *made.schema.names])

    return arrow_map(source, rows, T.StructType(fields))


def restored(turned: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """`turned` with the text that each output was made of; the output itself is left out."""
    others = [c for c in turned.columns if c not in (output_col, name)]
    source = turned.select(F.col(output_col).alias("_fim_output"), F.col(form_col).alias("_fim_form"), *others)
    fields = [turned.schema[c] for c in others] + [T.StructField(name, T.StringType())]

    def rows(batch: pa.RecordBatch):
        for low, high in chunks(batch.column("_fim_output")):
            part = batch.slice(low, high - low)
            text = strings(*gathered(*flat(part.column("_fim_output")), part.column("_fim_form").to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[2:], text], names=[*others, name])

    return arrow_map(source, rows, T.StructType(fields))


def digest(turned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hashes of the outputs, and of the texts restored from them."""
    hashed = turned.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", "output", F.sha2("output", 256).alias("output_sha256"))
    return restored(hashed).withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")
