"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles (A-Z lower-cased). Documents of
equal sets form a class first, however many they are; classes are what is compared. A
class keeps the K smallest hashes of its set, as signed numbers like all that Spark sorts. Linked sets have at least NEED of K sketch
values in common but with probability below 1e-8 (all of them that the threshold demands,
where a set is smaller than K); so of its sketch a class can leave out the NEED - 1 values
that most classes hold and still meet every partner in the inverted list of another value.

Lists are not expanded into pairs. First a list names one leader, every member is compared
with it, and what is linked becomes one component; lists whose members are all in one
component are done, which large groups of copies are by then. In what remains only
members of different components are compared. Lists of at most SHORT members give pairs.
Members of longer lists are dealt to blocks of about BLOCK by their longest list, and two
blocks that meet in any list are compared once, full sets against full sets, by a product
of membership matrices inside a task; that has no cap and brings out links only.
A candidate pair passes the estimate of the union's sketch, then exact Jaccard on the
full sets. All of this works on classes; documents come back by one join.

Defined cases: null or empty texts have an empty set and link with nothing; fewer than
five words count as one shingle; a row without id links with nothing, has no component and
is kept; rows of one id with equal text are one document, with different texts they share
the id and so a component; ties go to the smallest id; an empty table gives an empty one;
other columns stay unread.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.llm.common import arrow_map, components, keep, ship
from flowwatch.llm.substrings import codes, window_hashes

K, NEED, SHORT, BLOCK = 64, 28, 32, 2048
PERCENT = 75


def shingles(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    code = codes(words)
    if len(words) < width:  # one shingle of another length
        code = np.concatenate([np.full(width - len(words), len(words) + 1, np.uint64), code])
    return np.unique(window_hashes(code, width)[0])


def smallest(found: np.ndarray) -> np.ndarray:
    """The K smallest of sorted hashes as signed numbers, in the order in which Spark sorts them."""
    at = np.searchsorted(found, np.uint64(1 << 63))
    return np.concatenate([found[at : at + K], found[:at][:K]])[:K].view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, sig, sketch) of every document."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        n, sig, sketch = [], [], []
        for value in batch.column(1).cast(pa.large_binary()):
            found = shingles(value.as_py(), width)
            n.append(len(found))
            sig.append(xxhash.xxh3_128_digest(found.tobytes()))
            sketch.append(smallest(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
            names=["doc", "n", "sig", "sketch"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc long, n long, sig binary, sketch array<long>")


def needed() -> Column:
    """Sketch values that a set of `n` shingles shares with any set it is linked with."""
    return F.least(F.lit(NEED), F.ceil(F.col("n") * PERCENT / 100)).cast("int")


def prefixes(classes: DataFrame) -> DataFrame:
    """(rep, v): the list entries of each class that are left without its most common values."""
    entries = classes.select("rep", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    lists = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = F.col("s") - needed() + 1  # prefix length; values that one class holds come first
    met = entries.join(lists, "v")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "v"))
    shared = F.count("*").over(Window.partitionBy("rep"))
    return met.withColumn("rank", rank).withColumn("shared", shared).where(
        F.col("rank") <= own - (F.col("s") - F.col("shared"))
    ).select("rep", "v")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the threshold possible."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT) & (share >= NEED / K))
        .select("a", "b")
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}"))

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb")
    return arrow_map(joined, run, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))


def full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, hashes) of some classes, from the texts of their smallest documents."""
    wanted = reps.distinct().join(classes.select("rep", "sig"), "rep")
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(wanted, "rep")

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        reps, hashes = [], []
        texts = batch.column(1).cast(pa.large_binary())
        for rep, text, sig in zip(batch.column(0), texts, batch.column(2), strict=True):
            found = shingles(text.as_py(), width).tobytes()
            if xxhash.xxh3_128_digest(found) == sig.as_py():
                reps.append(rep.as_py())
                hashes.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hashes, pa.binary())], names=["rep", "hashes"])

    return arrow_map(rows.select("rep", "text", "sig"), run, "rep long, hashes binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Number of common values of every left and every right set."""
    own = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    place = [np.minimum(np.searchsorted(common, v), len(common) - 1) for v in values]
    hit = [common[p] == v for p, v in zip(place, values, strict=True)]
    for at in range(0, len(common), step):
        sides = []
        for p, h, o, n in zip(place, hit, own, (len(left), len(right)), strict=True):
            use = h & (p >= at) & (p < at + step)
            m = np.zeros((n, min(step, len(common) - at)), np.float32)
            m[o[use], p[use] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def in_blocks(group: pa.Table) -> pa.Table:
    """Links between two blocks, or in one: different components, exact Jaccard."""
    rep, comp = group.column("rep").to_numpy(), group.column("comp").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    size = np.array([len(x) for x in sets])
    i, j = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False).astype(bool)) for c in ("first", "second"))
    x = y = np.empty(0, int)
    if len(i) and len(j):
        common = overlaps([sets[k] for k in i], [sets[k] for k in j])
        union = size[i][:, None] + size[j][None, :] - common
        x, y = np.nonzero((100 * common >= PERCENT * union) & (comp[i][:, None] != comp[j][None, :]))
    a, b = rep[i[x]], rep[j[y]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def rest(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(v, rep, comp, size) of the lists whose members are not yet one component."""
    member = entries.join(found, F.col("rep") == F.col("node"), "left").select(
        "v", "rep", F.coalesce("component", "rep").alias("comp")
    )
    lists = member.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    return keep(member.join(lists.where("low < high").select("v", "size"), "v"), "neardup-rest")


def short_pairs(left: DataFrame) -> DataFrame:
    short = left.where(F.col("size") <= SHORT)
    other = short.select("v", F.col("rep").alias("b"), F.col("comp").alias("other"))
    return short.withColumnRenamed("rep", "a").join(other, "v").where("a < b and comp != other").select("a", "b").distinct()


def long_links(left: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between members of different components that meet in a long list. Blocks are
    smaller where sets are large: on average BLOCK sets of 512 shingles fill one."""
    long = left.where(F.col("size") > SHORT)
    home = long.groupBy("rep").agg(F.max("comp").alias("comp"), F.max(F.struct("size", "v")).alias("home"))
    home = home.join(classes.select("rep", "n"), "rep")
    fill = F.greatest(F.count("*") / BLOCK, F.sum("n") / (BLOCK * 512))
    count = home.groupBy("home").agg(F.ceil(fill).alias("cells"))
    block = keep(
        home.join(count, "home").select(
            "rep", "comp", F.col("home.v").alias("h"), F.pmod(F.xxhash64("rep"), F.col("cells")).alias("cell")
        ).select("rep", "comp", F.struct("h", "cell").alias("block")),
        "neardup-blocks",
    )
    present = long.select("v", "rep").join(block.select("rep", "block"), "rep").select("v", "block").distinct()
    met = (
        present.withColumnRenamed("block", "i").join(present.withColumnRenamed("block", "j"), "v")
        .where("i <= j").select("i", "j").distinct()
    )
    turns = met.select("i", "j", F.col("i").alias("block"), F.lit(True).alias("first"), (F.col("i") == F.col("j")).alias("second")).union(
        met.where("i != j").select("i", "j", "j", F.lit(False), F.lit(True))
    )
    dealt = turns.join(block, "block").join(sets, "rep").select("i", "j", "rep", "comp", "first", "second", "hashes")
    ship(left.sparkSession)
    return dealt.groupBy("i", "j").applyInArrow(in_blocks, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    rows = keep(sketches(docs, width, id_col, text_col), "neardup-sketches")
    classes = keep(
        rows.where("n > 0").groupBy("sig").agg(
            F.min("doc").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch")
        ).where("rep is not null"),
        "neardup-classes",
    )
    entries = keep(prefixes(classes), "neardup-entries")
    leaders = entries.groupBy("v").agg(F.min("rep").alias("lead"))
    led = entries.join(leaders, "v").where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = keep(estimated(led, classes), "neardup-pairs")
    sets = keep(full_sets(docs, classes, ends(pairs), width, id_col, text_col), "neardup-sets")
    links = keep(verified(pairs, sets), "neardup-links")
    left = rest(entries, components(links, "a", "b"))
    pairs = keep(estimated(short_pairs(left), classes), "neardup-pairs")
    several = left.where(F.col("size") > SHORT).select("rep")
    sets = keep(full_sets(docs, classes, ends(pairs).union(several), width, id_col, text_col), "neardup-sets")
    links = links.union(keep(verified(pairs, sets), "neardup-links")).union(keep(long_links(left, sets, classes), "neardup-links"))
    member = keep(
        rows.join(classes.select("sig", "rep"), "sig", "left").select("doc", "n", "rep"), "neardup-members"
    )
    # an id with several texts stands in several classes, which makes them one component
    several = member.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same_id = member.join(several.select("doc"), "doc").where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(same_id), "a", "b")
    kind = docs.schema[id_col].dataType.simpleString()
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return member.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"),
        (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"),
    )
