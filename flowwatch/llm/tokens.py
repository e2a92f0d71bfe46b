"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut at the special strings (one token each), each part into pieces by the
vocabulary's pattern, and each piece starts as one symbol per UTF-8 byte. A heap holds
the adjacent pairs that have a rank, a doubly linked list the symbols that are left. The
lowest rank (leftmost on ties) is popped and merged until no ranked pair is left; a
piece's count is its bytes less its merges. No identifier is ever made.

Defined cases: null text counts as empty (0 bytes, 0 tokens); empty text has no token;
repeated rows and null ids come back as they are; an empty table gives an empty one;
other columns are not read. A piece without a boundary costs n log n, so one very long
word is no trouble. Pieces of a very long text are taken in slices.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from flowwatch.llm.common import arrow_map

#: Fixed value: the byte-level pattern that belongs to the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_SLICE = 100_000
_MODELS: dict[int, "Merges"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Counts tokens; keeps the counts of pieces already seen, up to `most` of them."""

    def __init__(self, merges: list, specials: list[str], most: int = 1_000_000):
        import regex

        ids = {letter: b for b, letter in enumerate(byte_letters())}
        #: (rank, symbol made) of each pair of symbols, both symbols in one number.
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, (first, second) in enumerate(merges):
            made = ids.setdefault(first + second, len(ids))
            self.ranks[ids[first] << 32 | ids[second]] = rank << 32, made
        self.pieces = regex.compile(PATTERN)
        self.specials = (
            regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)))
            if specials else None
        )
        self.seen: dict[str, int] = {}
        self.most = most

    def piece(self, piece: str) -> int:
        """Symbols of a piece minus its merges. A heap entry is rank and place in one number."""
        symbols = list(piece.encode("utf-8", "surrogatepass"))
        n = left = len(symbols)
        find = self.ranks.get
        heap = [
            pair[0] | i
            for i in range(n - 1)
            if (pair := find(symbols[i] << 32 | symbols[i + 1])) is not None
        ]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            pair = find(symbols[i] << 32 | symbols[j])
            if pair is None or pair[0] | i != entry:
                continue
            symbols[i], symbols[j] = pair[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := find(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, pair[0] | i)
            h = before[i]
            if h >= 0 and (pair := find(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, pair[0] | h)
        return left

    def _sum(self, pieces: list[str]) -> int:
        seen = self.seen
        try:
            return sum(map(seen.__getitem__, pieces))
        except KeyError:
            if len(seen) > self.most:
                seen.clear()
            total = 0
            for p in pieces:
                count = seen.get(p)
                if count is None:
                    count = self.piece(p)
                    if len(p) < 64:
                        seen[p] = count
                total += count
            return total

    def count(self, text: str) -> int:
        parts = self.specials.split(text) if self.specials else [text]
        total = len(parts) - 1
        for part in parts:
            if len(part) < 4 * _SLICE:
                total += self._sum(self.pieces.findall(part))
            else:
                found = (m.group() for m in self.pieces.finditer(part))
                while chunk := list(islice(found, _SLICE)):
                    total += self._sum(chunk)
        return total


def read_merges(path: str) -> tuple[list, list[str]]:
    """Merges in rank order and special strings of a byte-level BPE file (.json)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    return merges, [t["content"] for t in data["added_tokens"] if t["special"]]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text. One pass, no shuffle.

    `vocabulary` is a file on the driver; its merges (tens of thousands) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def rows(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        key = hash(tuple(shared.value[1])) ^ len(shared.value[0]) ^ id(shared.value)
        model = _MODELS.get(key)
        if model is None:
            _MODELS.clear()
            model = _MODELS[key] = Merges(*shared.value)
        size, count = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            size.append(len(text.encode("utf-8", "surrogatepass")))
            count.append(model.count(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()),
             pa.array([c > limit for c in count], pa.bool_())],
            names=["id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(
        docs.select(id_col, text_col), rows,
        f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )
