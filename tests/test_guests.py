"""ICMP packets in UDP flows without a product give the facts that the join gives."""

import random

from pyspark.sql import functions as F

from flowwatch.operators import flows as FL
from flowwatch.operators import guests
from flowwatch.operators import skew
from flowwatch.rules import Rules
from rows import packet, table

COMPARED = [*FL.KEYS, "n_packets", "protocol", "remote", "host_port", "first_ts", "last_ts", "short_path",
            "first", "last", "first_in", "first_out", "own_first", *FL.SEEN]


def mixed(seed, pairs=6, packets=400):
    """Pairs with few and many ICMP packets, ports of UDP shared with TCP, many ties in time."""
    rng = random.Random(seed)
    rows = []
    for i in range(packets):
        pair = min(rng.randrange(pairs), rng.randrange(pairs))
        protocol = rng.choice(["UDP", "UDP", "UDP", "ICMP", "TCP"] if pair else ["UDP", "ICMP"])
        if pair == pairs - 1:
            protocol = rng.choice(["ICMP", "TCP"])  # no UDP flow
        text = rng.choice([">", "<"]) + (rng.choice(["SYN", "RST", "ACK"]) if protocol == "TCP" else "")
        rows.append(packet(i, pair % 2, text, protocol, ts=rng.randrange(packets // 3), remote=f"10.0.0.{pair}",
                           host_port=rng.randrange(80, 84), length=rng.choice([0, 7])))
    return rows


def result(rows):
    return sorted(map(str, rows.select(*COMPARED).collect()))


def test_equal_to_the_join(spark):
    for seed in (1, 2):
        packets = table(spark, mixed(seed)).repartition(5)
        plain = result(FL.assemble(packets, hot="none"))
        assert result(FL.assemble(packets, product=0)) == plain
        assert result(FL.assemble(packets, product=0, hot="sliced")) == plain
        assert result(FL.assemble(packets, product=50, bound=30)) == plain
        rules = Rules(icmp_pulls_udp=True)
        assert result(FL.assemble(packets, rules, product=0)) == result(FL.assemble(packets, rules, hot="none"))


def test_more_pairs_than_a_broadcast_may_hold(spark, monkeypatch):
    packets = table(spark, mixed(3))
    plain = result(FL.assemble(packets, hot="none"))
    monkeypatch.setattr(skew, "MAX_HEAVY", 1)
    assert result(FL.assemble(packets, product=0, hot="sliced")) == plain


def test_no_pair_is_crowded(spark):
    packets = table(spark, mixed(4))
    assert guests.crowded_pairs(FL.own_members(packets), 10**9) is None
    assert guests.crowded_pairs(FL.own_members(packets.limit(0)), 0) is None


def test_many_flows_and_many_guests_of_one_pair(spark):
    """10 000 flows and 10 000 ICMP packets: joined, they would be 100 million rows."""
    n = 10_000
    base = table(spark, [packet(0, 5, ">", "UDP", length=3)])
    flow = spark.range(n).select((F.col("id") * 2).alias("i"))
    udp = base.drop("packet_id", "timestamp", "l4_key").crossJoin(flow).select(
        "*", F.col("i").alias("packet_id"), F.col("i").alias("timestamp"), F.format_string("%010d", "i").alias("l4_key"))
    icmp = udp.withColumns({
        "packet_id": F.col("i") + 1, "timestamp": F.col("i") + 1, "protocol": F.lit("ICMP"), "l4_key": F.lit("ICMP"),
        "direction": F.when(F.col("i") % 4 == 0, "OUTCOME").otherwise("INCOME"), "length": F.lit(0),
    })
    packets = udp.unionByName(icmp).select(*base.columns)
    found = FL.assemble(packets).where("protocol = 'UDP'")
    got = found.agg(
        F.count("*"), F.min("n_packets"), F.max("n_packets"), F.min("first_ts"), F.max("first_ts"), F.min("last_ts"),
        F.count_if("pair_unreachable"), F.count_if(F.col("pair_unreachable") == (F.col("own_first.timestamp") % 4 == 0)),
    ).first()
    assert tuple(got) == (n, n + 1, n + 1, 0, 1, 2 * n - 1, n // 2, n)
