"""ICMP packets in the UDP flows of their host pair, without a product.

An ICMP packet belongs to every UDP flow of its flow key and host pair. Where a pair
holds many of both, joining packets to flows would give the product. Here the ICMP
packets of such a pair are numbered once, and every packet of its UDP flows learns how
many came before it. Own packets with the same number lie in one gap between ICMP
packets: they are one part, with facts of its own, and the part's neighbours are the two
ICMP packets with that number and the next. All else that a flow takes from its guests
(count, ends, letters seen) is the same for all flows of the pair and joined once.

Rows stay below packets plus flows at every step; no flow's parts are listed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P
from flowwatch.operators import flows as FL
from flowwatch.operators import skew

LINK = ["flow_key", "pair_key"]
FEW = 3  # up to so many ICMP packets of a pair are joined to its flows; a flow with more has no short path
_ENDS = {"first": F.least, "last": F.greatest, "first_in": F.least, "first_out": F.least}


def crowded_pairs(own: DataFrame, product: int) -> DataFrame | None:
    """(flow_key, pair_key) where ICMP packets times UDP packets exceed `product`; None without any.

    One count per pair over the ICMP and UDP packets. At most MAX_HEAVY pairs come to the driver, to be
    broadcast; if there are more, the pairs stay a table and are joined as one.
    """
    icmp, udp = P.is_protocol(V.ICMP), P.is_protocol(V.UDP)
    pairs = (
        own.where(icmp | udp).groupBy(*LINK).agg(F.count_if(icmp).alias("_icmp"), F.count_if(udp).alias("_udp"))
        .where((F.col("_icmp") > FEW) & (F.col("_udp") > 0) & (F.col("_icmp") * F.col("_udp") > product))
        .where(F.col("flow_key").isNotNull() & F.col("pair_key").isNotNull()).select(*LINK)
    )
    rows = pairs.limit(skew.MAX_HEAVY + 1).collect()
    if len(rows) > skew.MAX_HEAVY:
        return pairs
    if not rows:
        return None
    return F.broadcast(own.sparkSession.createDataFrame(rows, own.select(*LINK).schema))  # at most MAX_HEAVY rows


def targets(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The keys of the UDP flows of the pairs."""
    return own.where(P.is_protocol(V.UDP)).join(pairs, LINK, "left_semi").select(*FL.KEYS).distinct()


def guest_flows(own: DataFrame, pairs: DataFrame, *, hot: str = "auto", bound: int = 100_000) -> DataFrame:
    """Facts of the pairs' UDP flows with the ICMP packets of their pair among them."""
    guests = own.where(P.is_protocol(V.ICMP)).join(pairs, LINK, "left_semi")
    hosts = skew.lookup(own, targets(own, pairs), FL.KEYS, "left_semi")
    both = hosts.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    placed = skew.prefix_sums(both, LINK, FL.ORDER, {"_before": F.col("_guest")})
    parts = FL.facts(placed.where("_guest = 0").drop("_guest"), [*FL.KEYS, "_before"], hot=hot, bound=bound)
    numbered = P.with_kind(placed.where("_guest = 1")).select(*LINK, "_before", F.col("kind").alias("_letter"))

    def neighbour(rows: DataFrame, step: int, name: str) -> DataFrame:
        side = numbered.select(*LINK, (F.col("_before") - step).alias("_before"), F.col("_letter").alias(name))
        return skew.lookup(rows, side, [*LINK, "_before"], "left")

    # a guest lies between any two parts, so a run is within one part and its two neighbours:
    # no rule spans a guest between two own packets
    around = neighbour(neighbour(parts, 0, "_left"), 1, "_right")
    run = F.concat(F.coalesce("_left", F.lit("")), F.col("path"), F.coalesce("_right", F.lit("")))
    seen = around.withColumns({name: F.col(name) | run.rlike(FL.SEEN[name]) for name in FL.RUNS})
    own_facts = seen.groupBy(*FL.KEYS).agg(
        F.sum("n_packets").alias("n_packets"),
        F.min("own_first").alias("own_first"),
        *[(F.max if name == "last" else F.min)(name).alias(name) for name in _ENDS],
        *[F.max(name).alias(name) for name in FL.SEEN],
    )
    return _with_guests(own_facts, FL.facts(guests.withColumn("rekeyed", F.lit(True)), LINK, hot=hot, bound=bound))


def _with_guests(flows: DataFrame, of_pair: DataFrame) -> DataFrame:
    """Facts of flows together with the facts of their pair's guests."""
    taken = ["n_packets", *_ENDS, *FL.SEEN]
    renamed = of_pair.select(*LINK, *[F.col(c).alias(f"_g_{c}") for c in taken])
    joined = skew.lookup(flows, renamed, LINK)

    def re_keyed(end: str) -> Column:
        guest = F.col(f"_g_{end}")  # stays null where there is none
        return F.when(guest.isNotNull(), guest.withField("l4_key", F.col("l4_key")))

    return joined.select(
        *FL.KEYS, (F.col("n_packets") + F.col("_g_n_packets")).alias("n_packets"), "own_first",
        *[least(F.col(end), re_keyed(end)).alias(end) for end, least in _ENDS.items()],
        *[(F.col(name) | F.col(f"_g_{name}")).alias(name) for name in FL.SEEN],
        F.lit("~").alias("path"),
    )
