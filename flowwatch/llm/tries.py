"""Prefix trie of conversations by burst tries.

`rebuilt` puts the first turns of a base conversation in front of each conversation and numbers
the turns. A turn's id is a hash of role, text and the id of the turn before it, so equal ids
mean equal prefixes, and a conversation is its list of ids, 16 bytes a turn. Equal
conversations are one sequence with its members counted, however many there are.

All sequences start in one container below the root. A container that holds more than `limit`
turns bursts: its members move on by their next turn id into containers of their own and the
passed nodes become trie heads (by one id in the first round, by two in the next, then four,
so that a long common prefix takes few rounds). What is left fits a task: containers are dealt
to shards by their head, sorted and swept into nodes with a stack of open nodes. Heads get
their numbers from the containers and the ended sequences below them.

The ids of a sequence's members are sorted over all tasks, packed, and hashed pack by pack, so a
group of copies of any size is never held. One conversation's ids are one row, 20 bytes a turn; texts never are.

Defined cases: turns are in the order of turn (null first), role, text; null role and text are
empty; repeated rows are turns of their own; rows without conv_id are left out; a conversation
without turns is a member of the root only; the root has depth 0 and no parent; an empty table
has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.llm.common import arrow_map, keep, ship

#: Bytes of an id; turns of a container that a task sweeps; ids in a pack.
ID = 16
LIMIT = 4096
PACK = 4096
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "id binary, parent binary, conv_id long, parent_conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- conversations ---------------------------------------------------------------------


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars): turns numbered from 0, key a hash of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn",
        # the length of the role keeps role and text apart
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)).alias("key"),
        role.alias("role"), text.alias("text"), F.char_length(text).cast("int").alias("chars"),
    )
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("pos", F.row_number().over(by) - 1).select("conv_id", "pos", "key", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars) of the rebuilt conversations, and one row with a null pos for each."""
    own = keep(ordered(turns), "trie-turns")
    cut = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = own.where("pos = 0").select("conv_id", base.alias("base"), cut.alias("h"))
    lent = own.where("pos < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "key", "chars")
    head = convs.join(lent, "base").where("pos < h").select("conv_id", "pos", "key", "chars")
    # turns after the first h keep their number: the new ones are numbered when they are listed
    tail = own.where(F.col("pos") >= cut)
    none = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("chars"))
    return head.union(tail).union(none)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, path, chars): ids of each conversation in a row, and the code points of its turns."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "chars")))).alias("t"))

    def chain(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keys, chars = batch.column("key").to_pylist(), batch.column("chars").to_pylist()
        paths = []
        for mine in keys:
            before, out = b"", []
            for key in mine:
                before = hashlib.blake2b(before + key, digest_size=ID).digest()
                out.append(before)
            paths.append(b"".join(out))
        yield pa.record_batch([
            batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array([np.array(c, ">i4").tobytes() for c in chars], pa.binary()),
        ], ["conv_id", "path", "chars"])

    return arrow_map(listed.select("conv_id", "t.key", "t.chars"), chain, "conv_id long, path binary, chars binary")


def merged(sequences: DataFrame) -> DataFrame:
    """(conv_id, path, chars, n, ends): one row per distinct sequence with its smallest member, the
    number of members and the hash of their ids."""
    first = sequences.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"))
    # the last id stands for the path in what is sorted
    last = F.when(F.length("path") > 0, F.substring("path", -ID, ID)).otherwise(F.lit(b""))
    members = sequences.select(last.alias("last"), "conv_id").repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id")
    packs = members.mapInArrow(_packs, "last binary, low long, n long, ids binary")
    counted = packs.repartition("last").sortWithinPartitions("last", "low").mapInArrow(_hashes, "last binary, n long, ends string")
    return first.withColumn("last", last).join(counted, "last").drop("last")


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of one sequence, joined by commas, at most PACK in a row."""
    for batch in batches:
        last, conv = batch.column("last").to_pylist(), batch.column("conv_id").to_pylist()
        begin = [k for k in range(len(last)) if k == 0 or last[k] != last[k - 1]]
        rows = [(k, min(k + PACK, stop)) for start, stop in zip(begin, [*begin[1:], len(last)]) for k in range(start, stop, PACK)]
        if rows:
            yield pa.record_batch([
                pa.array([last[a] for a, _ in rows], pa.binary()), pa.array([conv[a] for a, _ in rows], pa.int64()),
                pa.array([b - a for a, b in rows], pa.int64()), pa.array([",".join(map(str, conv[a:b])).encode() for a, b in rows], pa.binary()),
            ], ["last", "low", "n", "ids"])


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of all packs of a sequence, which come one after the other."""
    mine, state, n = None, None, 0
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.string()))], ["last", "n", "ends"])
        done.clear()
        return made

    for batch in batches:
        for last, size, ids in zip(*(batch.column(c).to_pylist() for c in ("last", "n", "ids"))):
            if last == mine:
                state.update(b"," + ids)
                n += size
                continue
            if state is not None:
                done.append((mine, n, state.hexdigest()))
            mine, state, n = last, hashlib.sha256(ids), size
        if len(done) > 10_000:
            yield flush()
    if state is not None:
        done.append((mine, n, state.hexdigest()))
        yield flush()


# --- bursting ----------------------------------------------------------------------------


def burst(seqs: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Sequences with `at`, the depth of their container's head (null: ended among the heads), and
    whether any container burst."""
    pending = seqs.withColumn("at", F.lit(0))
    step, some = 1, False
    while True:
        pending = keep(pending, "trie-containers")
        size = (F.length("path") / ID).cast("int")
        head = _id_at("path", F.col("at"))
        large = (
            pending.where("at is not null").groupBy(head.alias("head"), "at")
            .agg(F.sum(size - F.col("at") + 1).alias("turns")).where(F.col("turns") > limit).select("head", "at", F.lit(True).alias("large"))
        )
        large = keep(large, "trie-large")
        if large.isEmpty():
            return pending, some
        some = True
        moved = F.when(size >= F.col("at") + step, F.col("at") + step)
        pending = (
            pending.withColumn("head", head).join(large, ["head", "at"], "left")
            .select(*seqs.columns, F.when(F.col("large"), moved).otherwise(F.col("at")).alias("at"))
        )
        step *= 2


def _id_at(path: str, depth: F.Column) -> F.Column:
    """Id of the node at a depth of a path; empty for the root."""
    return F.when(depth > 0, F.substring(F.col(path), (depth - 1) * ID + 1, F.lit(ID))).when(depth == 0, F.lit(b""))


# --- sweeping ------------------------------------------------------------------------------


class Open:
    """A node of the path that the sweep is on."""

    __slots__ = ("id", "depth", "chars", "first", "n", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, id_: bytes, depth: int, chars: int):
        self.id, self.depth, self.chars = id_, depth, chars
        self.first, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending = NOBODY, []

    def take(self, first: int, n: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)

    def closed(self) -> list[tuple]:
        """Rows of the children, now that the smallest member of this node is known."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars if self.depth else 0
        return [(c.id, self.id, c.first, self.first, c.depth, c.n, c.children, c.leaves, c.saved, c.ends) for c in self.pending]


def sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (at, path, chars, conv_id, n, ends) sorted by head and path -> (kind, node row).

    Kind 0: a finished node; kind 1: the top of a container, whose parent is a head.
    """
    stack: list[Open] = []
    before = b""

    def close(depth: int) -> Iterator[tuple]:
        while stack and stack[-1].depth > depth:
            node = stack.pop()
            for row in node.closed():
                yield 0, row
            if stack:
                up = stack[-1]
                up.take(node.first, node.n)
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
                up.pending.append(node)
            else:
                yield 1, (node.id, b"", node.first, None, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)

    head = None
    for at, path, chars, conv, n, ends in rows:
        mine = (at, path[: at * ID])
        if mine != head:
            yield from close(-1)
            head = mine
            shared = at - 1
        else:
            shared = _common(before, path)
            yield from close(shared)
        sizes = np.frombuffer(chars, ">i4")
        for depth in range(shared + 1, len(path) // ID + 1):
            stack.append(Open(path[(depth - 1) * ID:depth * ID] if depth else b"", depth, int(sizes[depth - 1]) if depth else 0))
        stack[-1].take(conv, n)
        stack[-1].ends = ends
        before = path
    yield from close(-1)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix in ids."""
    low, high = 0, min(len(a), len(b)) // ID
    while low < high:  # ids are chained: one equal id means that all before it are equal
        middle = (low + high + 1) // 2
        if a[(middle - 1) * ID:middle * ID] == b[(middle - 1) * ID:middle * ID]:
            low = middle
        else:
            high = middle - 1
    return low


def swept(pending: DataFrame) -> DataFrame:
    """Nodes of all containers: `kind` as in `sweep`."""
    ship(pending.sparkSession)
    schema = T.StructType.fromDDL(f"kind int, {NODE}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), kinds)], kinds)
            out.clear()
            return made

        for kind, row in sweep(rows):
            out.append((kind, *row))
            if len(out) >= 10_000:
                yield flush()
        if out:
            yield flush()

    shard = pending.where("at is not null").withColumn("head", _id_at("path", F.col("at"))).repartition("head")
    return shard.sortWithinPartitions("head", "path").select("at", "path", "chars", "conv_id", "n", "ends").mapInArrow(run, schema)


# --- heads -----------------------------------------------------------------------------------


def heads(pending: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes that containers burst at. Each container and each sequence that ended among the heads
    is a twig; what it has goes to all heads above it."""
    columns = ["conv_id", "path", "chars", "at"]
    # a container's smallest member stands for it
    bound = pending.where("at > 0").select(*columns, F.col("conv_id").alias("twig")).join(
        tops.select(F.col("conv_id").alias("twig"), F.col("depth").alias("at"), "n_convs", "n_leaves", "saved_tokens"), ["twig", "at"]
    ).select("twig", "path", "chars", "at", F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    ended = pending.where("at is null").select(
        F.col("conv_id").alias("twig"), "path", "chars", (F.length("path") / ID).cast("int").alias("at"), "n",
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "ends",
    )
    twigs = bound.union(ended)
    # a container's own top is no head; an ended sequence's last node is one
    last = F.when(F.col("ends").isNull(), F.col("at") - 1).otherwise(F.col("at"))
    passed = twigs.withColumn("depth", F.explode(F.sequence(F.lit(0), last))).select(
        "twig", "depth", _id_at("path", F.col("depth")).alias("id"),
        F.when(F.col("depth") > 0, _id_at("path", F.col("depth") - 1)).alias("parent"),
        F.when(F.col("depth") < F.col("at"), _id_at("path", F.col("depth") + 1)).alias("child"),
        _number("chars", F.col("depth")).alias("size"), "n", "leaves", "saved",
        F.when(F.col("depth") == F.col("at"), F.col("ends")).alias("ends"),
    )
    passed = keep(passed, "trie-passed")
    nodes = passed.groupBy("id", "depth").agg(
        F.min("parent").alias("parent"), F.min("twig").alias("conv_id"), F.sum("n").alias("n_convs"),
        F.countDistinct("child").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("ends").alias("ends"), F.max("size").alias("size"),
    )
    nodes = keep(nodes, "trie-heads")
    # what heads have themselves goes to the heads above along the twig of their smallest member
    own = nodes.select("id", F.col("conv_id").alias("twig"), ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"), (F.col("n_children") == 0).cast("long").alias("own_leaf"))
    below = W.partitionBy("twig").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = (
        passed.select("id", "twig", "depth").join(own, ["id", "twig"], "left")
        .select("id", F.sum(F.coalesce("own_saved", F.lit(0))).over(below).alias("s"), F.sum(F.coalesce("own_leaf", F.lit(0))).over(below).alias("l"))
        .groupBy("id").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    )
    return nodes.join(sums, "id").select(
        "id", "parent", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "depth", "n_convs", "n_children",
        (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )


def _number(chars: str, depth: F.Column) -> F.Column:
    """Code points of the turn at a depth, four bytes each; 0 for the root."""
    four = F.substring(F.col(chars), (depth - 1) * 4 + 1, F.lit(4))
    return F.when(depth > 0, F.conv(F.hex(four), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


# --- the operator --------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: id and parent (hashes of the prefix), and the columns of the trie."""
    seqs = merged(keep(sequences(rebuilt(conversations)), "trie-sequences"))
    pending, some = burst(seqs, limit)
    nodes = keep(swept(pending), "trie-nodes")
    inner = nodes.where("kind = 0").drop("kind")
    tops = nodes.where("kind = 1").drop("kind")
    if not some:
        return inner.union(tops.withColumn("parent", F.lit(None).cast("binary")))
    above = heads(pending, tops)
    # the parent of a top is the head one id before it on the path of its smallest member
    parent = pending.where("at > 0").select("conv_id", F.col("at").alias("depth"), _id_at("path", F.col("at") - 1).alias("up"))
    tops = tops.join(parent, ["conv_id", "depth"]).withColumn("parent", F.col("up")).select(*inner.columns)
    above = keep(above, "trie-above")
    names = above.select(F.col("id").alias("parent"), F.col("conv_id").alias("_first"))
    outer = tops.union(above.select(*inner.columns)).join(names, "parent", "left").withColumn("parent_conv_id", F.col("_first"))
    return inner.union(outer.select(*inner.columns))


def digest(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
