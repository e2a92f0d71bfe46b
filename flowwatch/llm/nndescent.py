"""Embedding near-duplicates by NN-descent.

Vectors are compared within one label and length, by cosine in double precision. Equal
vectors are one node with a weight. Tight balls of nodes are classes: a node whose angle
to a leader is at most half the threshold's is linked with every other such node, by the
triangle inequality of angles, so a large group of near copies becomes a few classes
before any search (leaders come from buckets of random hyperplane signs, one per bucket
and round, and a leader with members is never absorbed).

The leaders' neighbour graph is refined by NN-descent: lists of K neighbours start from
hyperplane buckets; in each pass the neighbours of a node, forward and reverse, are
compared with each other and lists keep the best. Reverse neighbours of a hub are dealt to
groups of at most HUB, newly in every pass, so no list is cut and no group is large. A
node whose whole list is within reach of the threshold is saturated: its list doubles, and
passes go on until QUIET of them in a row saturate nothing and find no new edge in reach
(lists far from the threshold need not settle). Then an audit takes the leaders whose smallest id is divisible by AUDIT as
queries against all leaders, in blocks; true edges that were missed are added, and if any
were, another start with new hyperplanes and more passes follow, at most AUDITS times.
Edges in reach are settled member by member in double precision, in blocks.

Defined cases: null, empty or zero vectors, null or non-finite components and null labels
link with nothing (n_links 0, their own component); a null id is a vector whose component
is that of its links, null without any; rows of one id with equal vectors are one vector, with different
ones each row counts its own links; ties in lists go to the smaller key; an empty table
gives an empty one; other columns stay unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.llm.common import arrow_map, components, keep, ship

K, HUB, BUCKET, BLOCK, TABLES, ROUNDS, QUIET, AUDIT, AUDITS = 10, 48, 64, 128, 6, 4, 2, 50, 3


def clean(rows: DataFrame) -> DataFrame:
    """(id, node, part, vec) of every row: unit vector as doubles, node = hash of label and
    vector; all null where the vector links with nothing."""

    def one(label, v) -> tuple:
        if label is None or not v or None in v:
            return None, None, None
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or not top:
            return None, None, None
        unit = x / top
        part = f"{label}/{len(v)}"
        node = xxhash.xxh3_128_digest(part.encode() + b"\0" + (x + 0.0).tobytes())
        return node, part, (unit / np.linalg.norm(unit)).tobytes()

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out = [one(label.as_py(), v.as_py()) for label, v in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.string(), pa.binary())))],
            names=["id", "node", "part", "vec"],
        )

    return arrow_map(rows, run, "id long, node binary, part string, vec binary")


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    values = column.to_pylist()
    if len({len(v) for v in values}) > 1:
        raise ValueError("vectors of one part have one length")
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1).astype(kind, copy=False)


def signs(table: DataFrame, seed: int, bits: str) -> DataFrame:
    """`table` with `sig`: the first `bits` (a column) signs against random hyperplanes."""

    names = table.columns

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out = np.zeros(batch.num_rows, np.int64)
        length = np.array([len(v) for v in batch.column(names.index("vec")).to_pylist()])
        wanted = batch.column(names.index(bits)).to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            x = matrix(batch.column(names.index("vec")).take(pa.array(at)))
            planes = np.random.default_rng([seed, int(n)]).standard_normal((x.shape[1], 40))
            side = (x @ planes > 0).astype(np.int64)
            for j in range(int(wanted[at].max())):
                use = wanted[at] > j
                out[at[use]] |= side[use, j] << j
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "sig"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return arrow_map(table, run, f"{kinds}, sig long")


def balls(nodes: DataFrame, threshold: float) -> DataFrame:
    """(leader, node, alpha): every node with its leader and the angle to it."""
    tight = math.cos(math.acos(threshold) / 2) + 1e-9
    state = nodes.select("node", "part", "vec", "bits").withColumn("leads", F.lit(False))
    members = None
    for step in range(ROUNDS):
        # few signs first: they gather a group that holds a large share of a label
        signed = signs(state.withColumn("b", F.least(F.col("bits"), F.lit(3)) if step == 0 else F.col("bits")), 1000 + step, "b")
        leader = signed.groupBy("part", "sig").agg(
            F.max(F.struct("leads", F.xxhash64("node", F.lit(step)).alias("h"), F.col("node").alias("leader"), F.col("vec").alias("lvec"))).alias("x")
        ).select("part", "sig", "x.leader", "x.lvec")

        def near(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            get = lambda c: batch.column(c)
            x, y = get("vec").to_pylist(), get("lvec").to_pylist()
            cos = np.array([float(np.dot(np.frombuffer(p), np.frombuffer(q))) for p, q in zip(x, y, strict=True)])
            free = ~get("leads").to_numpy(zero_copy_only=False).astype(bool)
            other = np.array([p != q for p, q in zip(get("node").to_pylist(), get("leader").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in ("node", "part", "vec", "bits", "leads", "leader")), pa.array(cos), pa.array(free & other & (cos >= tight))],
                names=["node", "part", "vec", "bits", "leads", "leader", "cos", "taken"],
            )

        seen = keep(
            arrow_map(
                signed.join(leader, ["part", "sig"]).select("node", "part", "vec", "bits", "leads", "leader", "lvec"), near,
                "node binary, part string, vec binary, bits int, leads boolean, leader binary, cos double, taken boolean",
            ),
            "balls",
        )
        took = seen.where("taken").select("leader", "node", F.acos(F.least("cos", F.lit(1.0))).alias("alpha"))
        members = took if members is None else members.union(took)
        leads = took.select(F.col("leader").alias("node")).distinct().withColumn("new", F.lit(True))
        state = seen.where("not taken").join(leads, "node", "left").select(
            "node", "part", "vec", "bits", (F.col("leads") | F.coalesce("new", F.lit(False))).alias("leads")
        )
    own = state.select(F.col("node").alias("leader"), "node", F.lit(0.0).alias("alpha"))
    return keep(members.union(own), "ball-members")


def top(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The best edges of each node, as many as its list holds."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).join(sizes, "u")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return best.withColumn("rank", rank).where("rank <= k").select("u", "v", "sim")


def compared(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Local join: in each group of (node, vec, floor) all pairs are compared; an edge goes
    to a node if it beats the node's floor. At most one list's length of edges per node."""

    def run(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("node").to_pylist(), dtype=object)
        x = matrix(group.column("vec"), np.float32)
        floor = group.column("floor").to_numpy()
        size = group.column("k").to_numpy()
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        u, v, s = [], [], []
        for i in range(len(ids)):
            good = np.flatnonzero(sim[i] > floor[i])
            if len(good) > size[i]:
                good = good[np.argpartition(-sim[i, good], size[i] - 1)[: size[i]]]
            u += [ids[i]] * len(good)
            v += ids[good].tolist()
            s.append(sim[i, good])
        return pa.table({
            "u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()),
            "sim": pa.array(np.concatenate(s).astype(np.float64) if s else [], pa.float64()),
        })

    ship(groups.sparkSession)
    return groups.groupBy(*keys).applyInArrow(run, "u binary, v binary, sim double")


def started(leaders: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """Edges among leaders that share a bucket of hyperplane signs in one of TABLES tables."""
    tables = None
    for t in range(TABLES):
        one = signs(leaders, seed * 100 + t, "bits").withColumn("t", F.lit(t))
        tables = one if tables is None else tables.union(one)
    count = tables.groupBy("t", "part", "sig").agg(F.ceil(F.count("*") / BUCKET).alias("cells"))
    dealt = tables.join(count, ["t", "part", "sig"]).withColumn("cell", F.pmod(F.xxhash64("node", "t"), F.col("cells")))
    dealt = dealt.join(sizes.withColumnRenamed("u", "node"), "node").withColumn("floor", F.lit(-1.0))
    return compared(dealt.select("t", "part", "sig", "cell", "node", "vec", "floor", "k"), ["t", "part", "sig", "cell"])


def passed(graph: DataFrame, leaders: DataFrame, sizes: DataFrame, step: int) -> DataFrame:
    """One pass: neighbours of neighbours, forward and reverse, compared around each node."""
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("node")).union(
        graph.select(F.col("v").alias("w"), F.col("u").alias("node"))
    ).union(graph.select(F.col("u").alias("w"), F.col("u").alias("node"))).distinct()
    count = around.groupBy("w").agg(F.ceil(F.count("*") / HUB).alias("cells"))
    floor = graph.groupBy(F.col("u").alias("node")).agg(F.min("sim").alias("low"), F.count("*").alias("n"))
    known = (
        leaders.select("node", "vec").join(sizes.withColumnRenamed("u", "node"), "node").join(floor, "node", "left")
        .select("node", "vec", "k", F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(F.lit(-1.0)).alias("floor"))
    )
    dealt = around.join(count, "w").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(step)), F.col("cells"))).join(known, "node")
    return compared(dealt.select("w", "cell", "node", "vec", "floor", "k"), ["w", "cell"])


def blocks_of(table: DataFrame, group: str, size: int) -> DataFrame:
    """One row per block of about `size` rows of a group: (group, block, nodes, vecs, weights)."""
    count = table.groupBy(group).agg(F.ceil(F.count("*") / size).alias("cells"))
    dealt = table.join(count, group).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    return dealt.groupBy(group, "cell").agg(
        F.collect_list(F.struct("node", "vec", "weight")).alias("rows")
    ).select(group, "cell", F.col("rows.node").alias("nodes"), F.col("rows.vec").alias("vecs"), F.col("rows.weight").alias("weights"))


def audited(leaders: DataFrame, reach: float) -> DataFrame:
    """True edges within reach of the query leaders against all leaders of their part."""
    ready = leaders.withColumn("weight", F.lit(1).cast("long"))
    blocks = blocks_of(ready, "part", 512).select("part", "nodes", "vecs")
    queries = blocks_of(ready.where(F.pmod("rep", F.lit(AUDIT)) == 0), "part", 512).select(
        "part", F.col("nodes").alias("q_nodes"), F.col("vecs").alias("q_vecs")
    )

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for i in range(batch.num_rows):
            ids, qs = batch.column("nodes")[i].as_py(), batch.column("q_nodes")[i].as_py()
            sim = matrix(batch.column("q_vecs")[i].values) @ matrix(batch.column("vecs")[i].values).T
            a, b = np.nonzero(sim >= reach)
            rows = [(qs[x], ids[y], float(sim[x, y])) for x, y in zip(a, b, strict=True) if qs[x] != ids[y]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["u", "v", "sim"]
            )

    return arrow_map(queries.join(blocks, "part"), run, "u binary, v binary, sim double")


def descend(leaders: DataFrame, reach: float, keep_recall: list | None = None) -> DataFrame:
    """Edges (u, v, sim) within reach among leaders, by NN-descent with audits."""
    sizes = keep(leaders.select(F.col("node").alias("u"), F.lit(K).alias("k")), "nn-sizes")
    graph = sizes.select("u", F.col("u").alias("v"), F.lit(0.0).alias("sim")).limit(0)
    near = F.col("sim") >= reach
    for audit in range(AUDITS):
        graph = keep(top(graph.union(started(leaders, sizes, audit + 1)), sizes), "nn-graph")
        edges = graph.where(near).count()
        step = quiet = 0
        while quiet < QUIET:
            before = graph
            full = before.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).join(sizes, "u").where(
                (F.col("n") >= F.col("k")) & (F.col("low") >= reach)
            ).select("u", F.lit(True).alias("full"))
            saturated = full.count()
            if saturated:
                sizes = keep(sizes.join(full, "u", "left").select("u", F.when(F.col("full"), F.col("k") * 2).otherwise(F.col("k")).alias("k")), "nn-sizes")
            graph = keep(top(before.union(passed(before, leaders, sizes, audit * 1000 + step)), sizes), "nn-graph")
            now = graph.where(near).count()
            quiet = 0 if saturated or now != edges else quiet + 1
            edges, step = now, step + 1
        true = keep(audited(leaders, reach), "nn-audit")
        missed = true.join(graph.select("u", "v"), ["u", "v"], "left_anti").join(
            graph.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti"
        )
        n, lost = true.count(), missed.count()
        if keep_recall is not None:
            keep_recall.append(1 - lost / n if n else 1.0)
        if not lost:
            break
        graph = graph.union(missed).union(missed.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    return graph.where(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").groupBy("u", "v").agg(F.max("sim").alias("sim"))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding", keep_recall: list | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector. `keep_recall` receives the audits' recalls."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    valid = keep(clean(rows), "nn-vectors")
    grouped = valid.where("node is not null").groupBy("part", "node").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count_distinct("id").alias("ids"), F.max(F.col("id").isNull().cast("long")).alias("anonymous"))
    parts = grouped.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.log2(F.count("*") / 16))).cast("int").alias("bits"))
    nodes = keep(grouped.join(parts, "part").withColumn("weight", F.col("ids") + F.col("anonymous")), "nn-nodes")
    members = balls(nodes, threshold)
    ball = members.groupBy("leader").agg(F.max("alpha").alias("radius"))
    leaders = keep(
        nodes.join(ball, F.col("node") == F.col("leader")).select("node", "part", "vec", "bits", "radius", F.coalesce("rep", F.lit(-1)).alias("rep")), "nn-leaders"
    )
    widest = leaders.agg(F.max("radius")).first()[0] or 0.0
    angle = math.acos(threshold)
    pairs = descend(leaders.drop("radius"), math.cos(angle + 2 * widest) - 1e-5, keep_recall)
    radius = lambda x: leaders.select(F.col("node").alias(x), F.col("radius").alias(f"r{x}"))
    pairs = keep(
        pairs.join(radius("u"), "u").join(radius("v"), "v").where(F.col("sim") >= F.cos(F.lit(angle) + F.col("ru") + F.col("rv")) - 1e-5).select("u", "v"), "nn-pairs"
    )
    # members of two classes in blocks: counts per member, one link per pair of classes
    full = nodes.select("node", "vec", "weight").join(members, "node")
    blocks = keep(blocks_of(full, "leader", BLOCK), "nn-blocks")
    side = lambda x: blocks.select(F.col("leader").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("nodes", "vecs", "weights")])

    def settle(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i]  # noqa: B023, E731
            hit = matrix(get("u_vecs").values) @ matrix(get("v_vecs").values).T >= threshold
            wu, wv = np.array(get("u_weights").as_py()), np.array(get("v_weights").as_py())
            nodes_, more = get("u_nodes").as_py() + get("v_nodes").as_py(), np.concatenate([hit @ wv, wu @ hit])
            used = np.flatnonzero(more)
            yield pa.RecordBatch.from_arrays(
                [pa.array([get("u").as_py()] * len(used), pa.binary()), pa.array([get("v").as_py()] * len(used), pa.binary()),
                 pa.array([nodes_[k] for k in used], pa.binary()), pa.array(more[used], pa.int64())], names=["u", "v", "node", "more"],
            )

    settled = keep(arrow_map(pairs.join(side("u"), "u").join(side("v"), "v"), settle, "u binary, v binary, node binary, more long"), "nn-settled")
    more = settled.groupBy("node").agg(F.sum("more").alias("more"))
    of_ball = full.join(nodes.select("node", "rep"), "node").groupBy("leader").agg(F.sum("weight").alias("inside"), F.min("rep").alias("first"))
    linked = settled.select("u", "v").distinct()
    name = of_ball.select("leader", "first")
    edges = linked.join(name.select(F.col("leader").alias("u"), F.col("first").alias("a")), "u").join(name.select(F.col("leader").alias("v"), F.col("first").alias("b")), "v")
    found = components(edges, "a", "b").withColumnRenamed("node", "c")
    per_node = (
        members.select("leader", "node").join(of_ball, "leader").join(more, "node", "left").join(found, F.col("first") == F.col("c"), "left")
        .select("node", (F.col("inside") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component"))
    )
    kind = vectors.schema[id_col].dataType.simpleString()
    component = F.coalesce("component", "id")
    return valid.select("id", "node").join(per_node, "node", "left").select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == component, F.coalesce("n_links", F.lit(0)) == 0).alias("kept"),
    )
