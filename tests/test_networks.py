"""Networks against the standard library's addresses."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowwatch.operators import networks as NW
from flowwatch.operators import search as SE
from rows import packet, table

BAD = [None, "", "10.0.0", "10.0.0.256", "1.2.3.4.5", "::1::", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "host", "1:2:3:4:5:6:7::8",
       ":", ":::", "01.2.3.4", "1.2.3.4:5", "::1.2.3", "::1.2.3.256", "g::1", " "]


def sample():
    rng = random.Random(8)
    four = [ipaddress.IPv4Address(rng.choice([0x0A000000, 0xC0A80000]) + rng.getrandbits(12)) for _ in range(150)]
    six = [ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(4) << 60) + rng.getrandbits(10)) for _ in range(150)]
    texts = [str(a) for a in four + six] + [a.exploded.upper() for a in six[:20]]
    texts += ["0.0.0.0", "255.255.255.255", "::", "::1", "1::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:10.0.0.9", "64:ff9b::192.0.2.33"]
    nets = [f"{a}/{rng.choice([0, 7, 8, 20, 23, 25, 28, 31, 32])}" for a in four[:40]]
    nets += [f"{a}/{rng.choice([0, 1, 32, 63, 64, 66, 117, 119, 121, 126, 128])}" for a in six[:40]] + [str(four[0]), str(six[0])]
    return texts, nets


def number(text):
    a = ipaddress.ip_address(text)
    return int(a) + (0xFFFF << 32 if a.version == 4 else 0)


def test_keys(spark):
    texts, _ = sample()
    rows = spark.createDataFrame([(t,) for t in texts + BAD], "a string").withColumn("k", NW.address_key(F.col("a"))).collect()
    for r in rows:
        assert r.k == (None if r.a in BAD else f"{number(r.a):032x}"), r.a


def test_longest_match(spark):
    texts, nets = sample()
    parsed = []
    for n in set(nets):
        f = ipaddress.ip_network(n, strict=False)
        low, lift = int(f.network_address), 0xFFFF << 32 if f.version == 4 else 0
        parsed.append((f.prefixlen + (96 if f.version == 4 else 0), n, low + lift, int(f.broadcast_address) + lift))
    want = {}
    for t in texts:
        best = min(((-bits, n) for bits, n, low, high in parsed if low <= number(t) <= high), default=None)
        if best:
            want[t] = best[1]
    a = spark.createDataFrame([(t,) for t in texts * 2 + BAD], "ip string").repartition(4)
    n = spark.createDataFrame([(t, 1) for t in [*nets, None, "", "10.0.0.0/33", "::/129", "::/-1", "10.0.0.0/x", "x/8"]], "network string, n_bits int")
    found = NW.longest_match(a, "ip", n).collect()
    assert {r.address: r.network for r in found} == want and len(found) == len(want)
    assert NW.longest_match(a, "ip", n.limit(0)).collect() == []
    assert NW.longest_match(a.limit(0), "ip", n).collect() == []


def test_within(spark):
    texts, _ = sample()
    few = ["10.0.8.0/21", "2001:db8::/62", "192.168.0.77", "::1/128"]
    inside = [ipaddress.ip_network(n, strict=False) for n in few]
    rows = spark.createDataFrame([(t,) for t in texts + BAD], "a string").select("a", NW.within(F.col("a"), few).alias("w"))
    for r in rows.collect():
        assert r.w == (r.a not in BAD and any(ipaddress.ip_address(r.a) in n for n in inside)), r.a
    with pytest.raises(ValueError):
        NW.within(F.col("a"), ["10.0.0.0/99"])


def test_packets_outside(spark):
    remotes = ["10.0.0.1", "10.0.0.200", "10.1.0.1", "2001:db8::5"]
    packets = table(spark, [packet(i, i, "<" if i % 2 else ">", remote=r) for i, r in enumerate(remotes)])
    listed = ["10.0.0.0/25", "2001:db8::/64"]
    assert sorted(r.packet_id for r in SE.outside(packets, listed).collect()) == [1, 2]
    networks = spark.createDataFrame([(n,) for n in listed], "cidr string")
    assert sorted(r.packet_id for r in SE.outside(packets, networks).collect()) == [1, 2]
