"""Flow assembly.

A flow becomes one row of mergeable facts: counts, flags seen, first and last
packet, and the letters at both ends (see `functions.packet.with_kind`), which are
merge state and no column of a flow: runs across the border of two parts show in
them. Facts of parts of a flow merge into facts of the whole, so a hot flow can be
cut into slices and is never gathered in one place. The order of all packets of a
flow is in `positions`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P
from flowwatch.operators import guests, skew
from flowwatch.rules import Rules

KEYS = ["flow_key", "l4_key", "pair_key"]
ORDER = ["timestamp", "packet_id"]

# what is true of a flow when its path matches; letters: `functions.packet.with_kind`
SEEN = {
    "saw_no_flags": "[Nn]",
    "saw_reset": "[RrKkTt]",
    "saw_fin_in": "M",
    "saw_fin_out": "m",
    "saw_shutdown": "[Ll]",
    "saw_tcp_data": "[EeDd]",
    "saw_data_chunk": "O",
    "saw_in_payload": "[WHGED]",
    "saw_incoming": "[A-Z]",
    "pair_closed": "S[rk]",                    # incoming SYN, then outgoing RST or RST,ACK
    "pair_unreachable": "[UW][ihqg]",          # incoming UDP, then outgoing ICMP
    "syn_reset": "[Ss][RrKk]",
    "syn_half_open": "[Ss][Cc][RrKk]",
    "syn_connect": "[Ss][Cc][AaEe][RrKk]",
}
# these look at neighbours; the others at single letters
RUNS = ["pair_closed", "pair_unreachable", "syn_reset", "syn_half_open", "syn_connect"]
_KEEP = 4          # letters kept at both ends of a long path
_CHUNK_BITS = 12   # rows per slice chunk of a hot flow: 4096
_REACH = 8         # packets of the next block that a block of `sliding` also holds, and one


# --- members ------------------------------------------------------------------


def combine(new: DataFrame, earlier: DataFrame) -> DataFrame:
    """New packets together with earlier packets of the same flows."""
    return new.unionByName(earlier, allowMissingColumns=True)


def own_members(packets: DataFrame) -> DataFrame:
    """Packets with the key of their own flow."""
    return P.with_tcp_fields(packets).withColumns({
        "l4_key": F.when(P.is_protocol(V.ICMP), V.ICMP_L4_KEY).otherwise(F.col("l4_key")), "rekeyed": F.lit(False),
    })


def members(packets: DataFrame, rules: Rules = Rules(), crowded: DataFrame | None = None) -> DataFrame:
    """Packets with the key of each flow they belong to.

    An ICMP packet belongs to its own flow and to every UDP flow of the same flow
    key and host pair; with `icmp_pulls_udp` also the other way round. A pair has one
    ICMP flow, so that gives at most one more row per UDP packet. UDP flows of
    `crowded` pairs are left out; `guests.guest_flows` makes their facts.
    """
    own = own_members(packets)
    d = own.drop("rekeyed")
    link = ["flow_key", "pair_key"]
    if crowded is not None:
        own = own.join(guests.targets(own, crowded), KEYS, "left_anti")

    def pulled(from_protocol: str, into_protocol: str) -> DataFrame:
        targets = d.where(P.is_protocol(into_protocol)).select(*KEYS).distinct()
        if crowded is not None and into_protocol == V.UDP:
            targets = targets.join(crowded, link, "left_anti")
        pulled_in = d.where(P.is_protocol(from_protocol)).drop("l4_key")
        joined = skew.lookup(pulled_in, targets, link)
        return joined.withColumn("rekeyed", F.lit(True))

    result = own.unionByName(pulled(V.ICMP, V.UDP))
    if rules.icmp_pulls_udp:
        result = result.unionByName(pulled(V.UDP, V.ICMP))
    return result


def positions(packets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Packets with their 1-based position in the flow, as a distributed table.

    Hot flows are cut into range slices, so this holds for any flow size.
    """
    return skew.prefix_sums(packets, keys, ORDER, {"pos": F.lit(1)})


# --- facts of a group ----------------------------------------------------------


def _shorten(path: Column) -> Column:
    """Both ends of a long path; '~' matches no rule."""
    return F.when(F.length(path) <= 2 * _KEEP, path).otherwise(
        F.concat(F.left(path, F.lit(_KEEP)), F.lit("~"), F.right(path, F.lit(_KEEP)))
    )


def _joined(parts: str, letters: str) -> Column:
    return F.array_join(F.col(parts)[letters], "")


def _packet() -> Column:
    """What facts keep of a packet with its letter."""
    incoming = P.is_incoming()
    return F.struct(
        *ORDER, "kind", "protocol", "rekeyed", "l4_key", "seq", "ack", "win", "header_length",
        "checksum_correct", "length",
        # the remote side and the host's port, whichever way the packet went
        F.when(incoming, F.col("source_address")).otherwise(F.col("destination_address")).alias("address"),
        F.when(incoming, F.col("destination_port")).otherwise(F.col("source_port")).alias("port"),
    )


def _read_path(groups: DataFrame) -> DataFrame:
    """What the rules see in the letters of a group, in place of `_path`."""
    return groups.withColumns({
        **{name: F.col("_path").rlike(pattern) for name, pattern in SEEN.items()}, "path": _shorten(F.col("_path")),
    }).drop("_path")


def group_facts(member_rows: DataFrame, by: list) -> DataFrame:
    """One row of facts per group of packets.

    Counts and ends are plain aggregates, combined before the shuffle; only time, id and
    letter of each packet are listed, and every rule reads the letters of the group at once.
    """
    packet = _packet()
    letter = F.col("kind")
    upper = letter == F.upper(letter)
    groups = P.with_kind(member_rows).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.min(F.when(~F.col("rekeyed"), packet)).alias("own_first"),
        F.min(packet).alias("first"),
        F.max(packet).alias("last"),
        F.min(F.when(upper, packet)).alias("first_in"),
        F.min(F.when(~upper, packet)).alias("first_out"),
        F.sort_array(F.collect_list(F.struct(*ORDER, "kind"))).alias("_letters"),
    )
    return _read_path(groups.withColumn("_path", _joined("_letters", "kind")).drop("_letters"))


def merge_facts(parts: DataFrame, by: list) -> DataFrame:
    """Facts of whole groups from facts of consecutive parts.

    What a part has seen stays seen; runs across the border of two parts show in
    the joined paths.
    """
    groups = parts.groupBy(*by).agg(
        F.sum("n_packets").alias("n_packets"),
        F.min("own_first").alias("own_first"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("first_in").alias("first_in"),
        F.min("first_out").alias("first_out"),
        *[F.max(name).alias(name) for name in SEEN],
        F.sort_array(F.collect_list(F.struct(
            F.col("first.timestamp").alias("timestamp"), F.col("first.packet_id").alias("packet_id"), "path"
        ))).alias("_parts"),
    )
    d = groups.withColumn("_path", _joined("_parts", "path"))
    return d.withColumns({
        **{name: F.col(name) | F.col("_path").rlike(SEEN[name]) for name in RUNS},
        "path": _shorten(F.col("_path")),
    }).drop("_path", "_parts")


def sliced_facts(member_rows: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """`group_facts` for groups of any size.

    The rows are range-partitioned by group and time, so a hot group is spread
    evenly. Facts are built per 4096 rows, merged per slice, then per group; the
    last merge sees one short row per slice.
    """
    columns = [*by, *ORDER]
    ranged = (
        member_rows.repartitionByRange(partitions or skew.shuffle_width(member_rows), *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", 33))
        .withColumn("_chunk", F.shiftright("_row", _CHUNK_BITS))
        .drop("_row")
    )
    chunks = group_facts(ranged, [*by, "_slice", "_chunk"])
    return merge_facts(merge_facts(chunks, [*by, "_slice"]), by)


def facts(
    member_rows: DataFrame, by: list[str] = KEYS, *, hot: str = "auto", bound: int = 100_000,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row of facts per group, with hot groups kept apart.

    hot="auto"    count rows first and slice the groups that may exceed `bound`;
                  with none, the plan is a single shuffle.
    hot="none"    the caller knows that all groups are small: no count.
    hot="sliced"  slice everything: no count, no size assumption.

    The count is taken per flow key and host pair, over `counted` (the packets
    before ICMP is re-keyed) where given: every group lies within one such pair.
    """
    if hot == "none":
        return group_facts(member_rows, by)
    if hot == "sliced":
        return sliced_facts(member_rows, by)
    pair = ["flow_key", "pair_key"]
    heavy = skew.heavy_groups(member_rows if counted is None else counted, pair, bound)
    if heavy is None:  # too many to broadcast
        return sliced_facts(member_rows, by)
    if not heavy:
        return group_facts(member_rows, by)
    spark = member_rows.sparkSession
    marks = spark.createDataFrame([(r["flow_key"], r["pair_key"], True) for r in heavy],
                                  "flow_key long, pair_key string, _hot boolean")
    marked = member_rows.join(F.broadcast(marks), pair, "left")  # at most skew.MAX_HEAVY rows
    width = max(skew.shuffle_width(member_rows), sum(r["n"] for r in heavy) // 1_000_000 + 1)
    cold = group_facts(marked.where(F.col("_hot").isNull()).drop("_hot"), by)
    return cold.unionByName(sliced_facts(marked.where("_hot").drop("_hot"), by, width))


# --- flows -----------------------------------------------------------------------


def finish(fact_rows: DataFrame) -> DataFrame:
    """Named flow columns on top of the facts. `short_path` holds the letters of a flow of
    at most four packets and is null for longer ones."""
    return fact_rows.withColumns({
        "protocol": F.col("own_first.protocol"),
        "remote": F.coalesce("first_in.address", "first_out.address"),
        "host_port": F.coalesce("first_in.port", "first_out.port"),
        "first_ts": F.col("first.timestamp"),
        "last_ts": F.col("last.timestamp"),
        "short_path": F.when(F.col("n_packets") <= _KEEP, F.col("path")),
    }).drop("path")


def assemble(
    packets: DataFrame, rules: Rules = Rules(), *, gap_us: int | None = None, hot: str = "auto",
    bound: int = 100_000, product: int = 1_000_000,
) -> DataFrame:
    """Packets -> flows.

    Pairs whose ICMP packets times UDP packets exceed `product` are found by a count and get
    their UDP flows from `guests.guest_flows`; hot="none" does without, as no group is large.

    With `gap_us`, a flow ends where the next packet is more than the gap away,
    as the streaming form does; `session` then numbers the flow's parts. Every UDP flow
    then has a session for each burst of ICMP packets of its pair, which is a product in itself.
    """
    if gap_us is not None:
        return finish(session_facts(members(packets, rules), gap_us, hot=hot, bound=bound, counted=packets))
    own = own_members(packets)
    crowded = None if hot == "none" else guests.crowded_pairs(own, product)
    made = facts(members(packets, rules, crowded), KEYS, hot=hot, bound=bound, counted=packets)
    if crowded is not None:
        made = made.unionByName(guests.guest_flows(own, crowded, hot=hot, bound=bound))
    return finish(made)


def session_facts(
    member_rows: DataFrame, gap_us: int, *, hot: str = "auto", bound: int = 100_000, counted: DataFrame | None = None
) -> DataFrame:
    """Facts of every session of a flow, numbered by `session`: the next packet is more than the gap away.

    Where no pair has more than `bound` packets, a flow is listed once and cut where it pauses;
    else sessions are found in slices.
    """
    if hot == "auto" and skew.heavy_groups(member_rows if counted is None else counted, ["flow_key", "pair_key"], bound) == []:
        hot = "none"
    if hot == "none":
        return listed_sessions(member_rows, gap_us)
    # packets of one bucket are closer than the gap, so a bucket never splits;
    # sessions are then found over one row per flow and bucket
    bucketed = member_rows.withColumn("_bucket", F.floor(F.col("timestamp") / gap_us))
    parts = facts(bucketed, [*KEYS, "_bucket"], hot=hot, bound=bound, counted=counted)
    slices = merge_facts(sliced_sessions(parts, gap_us), [*KEYS, "session", "_slice"])
    return merge_facts(slices, [*KEYS, "session"])


def listed_sessions(member_rows: DataFrame, gap_us: int) -> DataFrame:
    """Facts of every session of flows that fit a row: one shuffle, and the packets are sorted once."""
    flows = P.with_kind(member_rows).groupBy(*KEYS).agg(F.sort_array(F.collect_list(_packet())).alias("_all"))
    every, n = F.col("_all"), F.size("_all")

    def pause(i):
        return F.element_at(every, i)["timestamp"] - F.element_at(every, i - 1)["timestamp"]

    # where sessions begin, and the place after the last; null where one is the whole flow
    span = F.element_at(every, -1)["timestamp"] - F.element_at(every, 1)["timestamp"]
    later = F.filter(F.sequence(F.lit(2), n), lambda i: pause(i) > gap_us)
    cut = flows.withColumn("_cuts", F.when(
        (n > 1) & F.coalesce(span > gap_us, F.lit(True)), F.concat(F.array(F.lit(1)), later, F.array(n + 1))))

    def part(k):
        return F.slice(every, F.element_at("_cuts", k), F.element_at("_cuts", k + 1) - F.element_at("_cuts", k))

    parts = F.when(F.col("_cuts").isNull(), F.array(every)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), part))
    mine = F.col("_mine")

    def earliest(test):
        return F.try_element_at(F.filter(mine, test), F.lit(1))

    sessions = cut.select(*KEYS, F.posexplode(parts).alias("session", "_mine")).select(
        *KEYS, F.col("session").cast("long").alias("session"),
        F.size(mine).cast("long").alias("n_packets"),
        earliest(lambda p: ~p["rekeyed"]).alias("own_first"),
        F.element_at(mine, 1).alias("first"),
        F.element_at(mine, -1).alias("last"),
        earliest(lambda p: p["kind"] == F.upper(p["kind"])).alias("first_in"),
        earliest(lambda p: p["kind"] != F.upper(p["kind"])).alias("first_out"),
        _joined("_mine", "kind").alias("_path"),
    )
    return _read_path(sessions)


def in_sessions(parts: DataFrame, gap_us: int) -> DataFrame:
    """Facts of parts of flows with the number of their session. Parts may lie within each other;
    `tangled` marks those of a session in which one begins before another has ended."""
    by_time = W.partitionBy(*KEYS).orderBy("first.timestamp", "first.packet_id")
    before = F.max(F.struct("last.timestamp", "last.packet_id")).over(by_time.rowsBetween(W.unboundedPreceding, -1))
    starts = F.col("first.timestamp") - before["timestamp"] > gap_us
    early = F.struct("first.timestamp", "first.packet_id") <= before
    numbered = parts.withColumns({
        "_starts": F.coalesce(starts, F.lit(False)).cast("int"), "_early": F.coalesce(early, F.lit(False)),
    }).withColumn("session", F.sum("_starts").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.withColumn("tangled", F.max("_early").over(W.partitionBy(*KEYS, "session"))).drop("_starts", "_early")


def sliced_sessions(parts: DataFrame, gap_us: int, partitions: int | None = None) -> DataFrame:
    """Parts of flows with the number of their session and of their slice, for flows of any number of parts.

    The parts are cut into ranges of flow and time. What a slice says to later ones is
    associative: the latest packet it has seen, and how many sessions begin in it. Both are
    carried over one row per flow and slice, so no window holds more than a slice.
    """
    placed = parts.withColumns({"_ts": F.col("first.timestamp"), "_id": F.col("first.packet_id")})
    cut = skew.range_slices(placed, [*KEYS, "_ts", "_id"], partitions)
    by = [*KEYS, "_slice"]
    inside = W.partitionBy(*by).orderBy("_ts", "_id")
    earlier = W.partitionBy(*KEYS).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*by).agg(F.max("last.timestamp").alias("_end"))
    ends = ends.select(*by, F.max("_end").over(earlier).alias("_carried"))
    before = F.greatest(F.max("last.timestamp").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_carried"))
    opened = skew.join_on(cut, ends, by).withColumn("_before", before).withColumn(
        "_starts", F.coalesce(F.col("_ts") - F.col("_before") > gap_us, F.lit(False)).cast("int"))
    sums = opened.groupBy(*by).agg(F.sum("_starts").alias("_opened"))
    sums = sums.select(*by, F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_offset"))
    number = F.sum("_starts").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")
    numbered = skew.join_on(opened, sums, by).withColumn("session", number)
    return numbered.drop("_ts", "_id", "_carried", "_before", "_starts", "_offset")


def coarse_groups(packets: DataFrame) -> DataFrame:
    """Groups by (flow_key, l4_key) only: packet count and time span."""
    return packets.groupBy("flow_key", "l4_key").agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def gap_us(first: Column, last: Column) -> Column:
    """Microseconds between two packet structs."""
    return last["timestamp"] - first["timestamp"]


def letters(packets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, letter) of every packet: what `sliding` reads, placed once."""
    rows = P.with_kind(packets).withColumnRenamed("kind", "letter").select(*keys, *ORDER, "letter")
    return positions(rows, keys).select(*keys, "pos", "letter")


def sliding(placed: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Every run of n consecutive letters of a flow, one row per run.

    A flow is cut into blocks of 4096 positions, so none is gathered in one task. The first packets
    of a block also stand at the end of the one before it, for the runs that reach over the border.
    Up to n = _REACH, all lengths take the same blocks, so a plan with several has one shuffle of them.
    """
    block = F.shiftright(F.col("pos") - 1, _CHUNK_BITS)
    into = F.col("pos") - 1 - F.shiftleft(block, _CHUNK_BITS)  # place in its block
    reach = max(n, _REACH) - 1
    both = F.when((into < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = placed.select(*keys, "pos", "letter", F.explode(both).alias("_block"))
    here = W.partitionBy(*keys, "_block").orderBy("pos")
    letters_of = [F.col("letter"), *[F.lead("letter", k).over(here) for k in range(1, n)]]
    last = F.col("pos") if n == 1 else F.lead("pos", n - 1).over(here)
    return (
        blocks.select(*keys, "_block", F.col("pos").alias("start"), F.concat_ws("", *letters_of).alias("run"), last.alias("_last"))
        .where((F.col("_last") == F.col("start") + (n - 1)) & (F.shiftright(F.col("start") - 1, _CHUNK_BITS) == F.col("_block")))
        .select(*keys, "start", "run")
    )
