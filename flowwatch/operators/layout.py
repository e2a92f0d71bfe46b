"""Packet tables laid out for search, so that a search skips files.

Every row gets a place on a curve that interleaves the ranks of its dimensions (addresses,
ports, time): rows that are near in all of them lie in one file, whose minima and maxima then
tell what it cannot hold. Ranks are counted against quantiles of a bounded sample of rows
(those of the smallest hashes; a parameter). The sample decides how rows are laid out, never
which are found. A place that many rows share goes on by time, so no file grows with it.
Addresses and ports also have Bloom filters, for equality.

A search by an anchored pattern says which texts a match can begin with (`starts`); Parquet
readers compare these with a file's minimum and maximum.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.operators import skew

DIMENSIONS = ["source_address", "destination_address", "destination_port", "source_port", "timestamp"]
_BITS = 4           # ranks of a dimension: 16
_SAMPLE = 10_000    # rows that the quantiles are taken from
_MOST = 64          # beginnings that one pattern may stand for
_SET = re.compile(r"\[(?:([0-9])-([0-9])|([a-f])-([a-f])|([0-9a-f:.]+))\]")


def _rank(column: Column, bounds: list) -> Column:
    """How many bounds are not above the value; 0 for null."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.coalesce(b <= column, F.lit(False))))


def _quantiles(values: list) -> list:
    """2^_BITS - 1 bounds that cut the values into parts of like size."""
    known = sorted(v for v in values if v is not None)
    parts = 1 << _BITS
    return [known[len(known) * k // parts] for k in range(1, parts)] if known else []


def place(rows: DataFrame, dimensions: list[str], sample: int = _SAMPLE) -> Column:
    """Place on the curve: the top bits of all ranks, then the next ones."""
    seen = rows.select(*dimensions).orderBy(F.xxhash64(*dimensions)).limit(sample).collect()
    ranks = [_rank(F.col(c), _quantiles([r[c] for r in seen])) for c in dimensions]
    found = F.lit(0).cast("long")
    for bit in reversed(range(_BITS)):
        for rank in ranks:
            found = found * 2 + F.shiftright(rank, bit).bitwiseAND(F.lit(1))
    return found


def write_clustered(
    packets: DataFrame, path: str, dimensions: list[str] = DIMENSIONS, files: int | None = None, sample: int = _SAMPLE
) -> None:
    """Appends packets to a Parquet table in `files` files of near rows."""
    order = ["_place", "timestamp", "packet_id"]
    placed = packets.withColumn("_place", place(packets, dimensions, sample))
    ranged = placed.repartitionByRange(files or skew.shuffle_width(packets), *order).sortWithinPartitions(*order)
    writer = ranged.drop("_place").write.mode("append")
    for c in dimensions:
        if c != "timestamp":
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def prefixes(pattern: str) -> list[str]:
    """Texts of which every match of the pattern begins with one; none if it doesn't say.

    Read are literal characters, escaped signs and sets of digits or letters behind `^`, up
    to the first thing else.
    """
    if not pattern.startswith("^") or "|" in pattern or "(?" in pattern:
        return []
    found, at = [""], 1
    while at < len(pattern):
        sign, chosen = pattern[at], _SET.match(pattern, at)
        if sign == "\\":
            chars, end = list(pattern[at + 1:at + 2]), at + 2
            if not chars or chars[0].isalnum():
                break
        elif chosen:
            low, high = chosen[1] or chosen[3], chosen[2] or chosen[4]
            chars = [chr(k) for k in range(ord(low), ord(high) + 1)] if low else sorted(set(chosen[5]))
            end = chosen.end()
        elif sign in ".^$*+?()[]{}":
            break
        else:
            chars, end = [sign], at + 1
        repeat = pattern[end:end + 1]
        if not chars or repeat in ("*", "?", "{") or len(found) * len(chars) > _MOST:
            break
        found = [f + c for f in found for c in chars]
        if repeat == "+":
            break
        at = end
    return found if found != [""] else []


def starts(column: str, pattern: str) -> Column:
    """What a match of the pattern begins with, as a test that readers can push down."""
    test = F.lit(True)
    for k, text in enumerate(prefixes(pattern)):
        test = F.col(column).startswith(text) if k == 0 else test | F.col(column).startswith(text)
    return test
