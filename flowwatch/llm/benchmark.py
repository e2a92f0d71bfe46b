"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased in A-Z; words are runs of 0-9, a-z and everything above ASCII. An
item's windows are its runs of `width` words (a shorter item is one window). All windows
go into one automaton as byte strings with a space at either end. A document's words,
joined by single spaces, are scanned once; ends of matches become word numbers, word
numbers become places in the original text.

The window table is broadcast while it is below `bound` bytes, which is checked (an automaton
takes some 40 times that in a worker). Above that, windows are dealt by hash into shards below
the bound, and every text meets every shard in tasks of that shard alone (a stated query set
against all rows, in blocks): a worker goes through the shards one after the other and builds
each automaton once. Only texts with a hit leave these tasks, as the hash of the text with
its runs, once for all copies; the shards' runs are united and joined to the rows.

Defined cases: null text has no word, no hit; an item without words has no window; items
with equal text both count; an item without id marks words and is not listed; repeated
rows are judged one by one; an empty table on either side gives no hits; other columns
are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from flowwatch.llm.common import ship

#: Byte table: A-Z to a-z, ASCII that is no letter or digit to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AUTOMATA: dict[str, object] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows(item: list[bytes], width: int) -> Iterator[bytes]:
    for i in range(max(1, len(item) - width + 1) if item else 0):
        yield b" " + b" ".join(item[i : i + width]) + b" "


def window_table(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(win, wide, ids): each distinct window, its number of words and its items' ids, as strings."""
    ship(items.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            win, ids = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {*windows(words(text), width)}
                win += found
                ids += [item] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(win, pa.binary()), pa.array(ids, pa.string())], names=["win", "id"]
            )

    return (
        items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "win binary, id string")
        .groupBy("win").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )


def automaton(table: list[tuple[bytes, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for win, ids in table:
        found.add_word(win.decode("latin-1"), (len(win), win.count(b" ") - 1, tuple(ids)))
    if table:
        found.make_automaton()
    return found


def scan(built, text: str | None) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """Words of a text, hit runs of words (first, after last; merged) and ids of the items found."""
    have = words(text)
    if not have or not len(built):
        return have, [], set()
    line = (b" " + b" ".join(have) + b" ").decode("latin-1")
    runs: list[tuple[int, int]] = []
    ids: set[str] = set()
    at, last = 0, 0  # words before `last`
    for end, (size, wide, of) in built.iter(line):
        at += line.count(" ", last, end)
        last = end
        ids.update(of)
        if runs and at - wide <= runs[-1][1]:
            first = min(runs[-1][0], at - wide)
            runs[-1] = (first, at)
            while len(runs) > 1 and runs[-2][1] >= first:
                runs[-2:] = [(min(runs[-2][0], first), at)]
        else:
            runs.append((at - wide, at))
    return have, runs, ids


def places(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (start, end) in code points of the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    point = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(point(at[a][0]), point(at[b - 1][1])) for a, b in runs]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    item_id: str = "item_id",
    text_col: str = "text",
    bound: int = 4 << 20,
) -> DataFrame:
    """`docs` with a struct column `hits` (n_words, runs, spans, items) for each text.

    `runs` are hit runs in word numbers, `spans` the same in code points of the text, and
    `items` the sorted ids (as strings) of items with an occurring window. A column of
    `docs` that has that name is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    table = window_table(items, width, item_id, "text").persist()
    total = table.agg(F.sum(F.octet_length("win") + F.size("ids") * 16)).first()[0] or 0
    shards = -(-total // bound) or 1
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", pair), T.StructField("spans", pair),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    plain = docs.select(*[c for c in docs.columns if c != "hits"])
    parts = [table if shards == 1 else table.where(F.pmod(F.hash("win"), F.lit(shards)) == n) for n in range(shards)]
    shared = [spark.sparkContext.broadcast([(bytes(r.win), r.ids) for r in part.collect()]) for part in parts]
    table.unpersist()
    key = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if shards == 1:
        return plain.withColumn("hits", find(shared[0], key, kind)(F.col(text_col)))
    sha = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = plain.where(F.col(text_col).isNotNull()).select(sha.alias("sha"), F.col(text_col).alias("text"))
    runs = "array<struct<start:long,end:long>>"
    found = [
        texts.mapInArrow(hit_texts(part, f"{key}-{n}"), f"sha string, runs {runs}, items array<string>")
        .groupBy("sha").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))  # copies are hit alike
        for n, part in enumerate(shared)
    ]
    united = (
        reduce(DataFrame.unionByName, found).groupBy("sha")  # as many rows as shards at most
        .agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        .select(F.struct("sha", "runs", "items").alias("hits"))
    )
    joined = plain.join(united, sha == F.col("hits.sha"), "left")
    return joined.withColumn("hits", whole(kind)(F.col(text_col), F.col("hits.runs"), F.col("hits.items")))


def built_once(shared, key: str):
    """The automaton of a broadcast window table; a worker keeps one or two."""
    if key not in _AUTOMATA:
        if len(_AUTOMATA) > 1:
            _AUTOMATA.clear()
        _AUTOMATA[key] = automaton(shared.value)
    return _AUTOMATA[key]


def hit_texts(shared, key: str):
    """Arrow function: (sha, text) to (sha, runs, items) of the texts that the shard hits."""
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        built = None
        for batch in batches:
            built = built or built_once(shared, key)
            shas, runs, items = [], [], []
            for sha, text in zip(batch.column(0), batch.column(1), strict=True):
                _, at, ids = scan(built, text.as_py())
                if at:
                    shas.append(sha.as_py())
                    runs.append([{"start": a, "end": b} for a, b in at])
                    items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shas, pa.string()), pa.array(runs, pairs), pa.array(items, pa.list_(pa.string()))],
                names=["sha", "runs", "items"],
            )

    return run


def find(shared, key: str, kind: T.StructType):
    """Column function that scans texts with the automaton of a broadcast window table."""
    store = to_arrow_type(kind)

    @arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        built = built_once(shared, key)
        out = []
        for value in text:
            t = value.as_py()
            have, runs, ids = scan(built, t)
            out.append({
                "n_words": len(have), "runs": [{"start": a, "end": b} for a, b in runs],
                "spans": [{"start": a, "end": b} for a, b in places(t, runs)] if runs else [],
                "items": sorted(ids),
            })
        return pa.array(out, store)

    return run


def whole(kind: T.StructType):
    """Column function: the hit struct of a text from all shards' runs and items."""
    store = to_arrow_type(kind)

    @arrow_udf(kind)
    def run(text: pa.Array, found: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for t, of_shards, ids in zip(text, found, items, strict=True):
            runs: list[tuple[int, int]] = []
            for x in sorted((r["start"], r["end"]) for r in of_shards.as_py() or []):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(runs[-1][1], x[1]))
                else:
                    runs.append(x)
            t = t.as_py()
            out.append({
                "n_words": len(words(t)), "runs": [{"start": a, "end": b} for a, b in runs],
                "spans": [{"start": a, "end": b} for a, b in places(t, runs)] if runs else [],
                "items": sorted({*(ids.as_py() or [])}),
            })
        return pa.array(out, store)

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, hash of the items found, verdict."""
    hit = F.aggregate("hits.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        id_col,
        F.col("hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
