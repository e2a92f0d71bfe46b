"""Sessions of a hot flow in slices, against the window per flow and against plain Python."""

import random

from pyspark.sql import functions as F

from flowwatch.operators import features as FE
from flowwatch.operators import flows as FL
from flowwatch.operators import skew
from flowwatch.schema import HISTORY
from rows import packet, table

GAP = 1_000_000
COMPARED = ["flow_key", "l4_key", "pair_key", "session", "n_packets", "first_ts", "last_ts", "short_path", *FL.SEEN]


def traffic(seed=9, hot=2500, others=30):
    """A flow with most of the packets, with gaps shorter than, equal to and longer than the session's."""
    rng = random.Random(seed)
    kinds = [">SYN", "<SYN,ACK", ">ACK", "<RST", "<RST,ACK", ">PSH,ACK", ">FIN,ACK", "<ACK"]
    rows, now = [], 0
    for i in range(hot):
        now += rng.choice([0, 1, 400_000, 999_999, GAP, GAP, GAP + 1 if rng.random() < 0.2 else 7])
        rows.append(packet(i, 0, rng.choice(kinds), ts=now))
    for i in range(hot, hot + others * 5):
        rows.append(packet(i, 1 + i % others, rng.choice(kinds), ts=rng.randrange(6 * GAP)))
    rng.shuffle(rows)
    return rows


def result(flows):
    return sorted(map(tuple, flows.select(*COMPARED).collect()), key=str)


def test_slices_equal_windows(spark):
    packets = table(spark, traffic()).repartition(5)
    plain = result(FL.assemble(packets, gap_us=GAP, hot="none"))
    assert result(FL.assemble(packets, gap_us=GAP, hot="sliced")) == plain
    assert result(FL.assemble(packets, gap_us=GAP, hot="auto", bound=100)) == plain
    times = {}
    for r in traffic():
        times.setdefault(r[9], []).append(r[1])
    want = []
    for key, run in times.items():
        run.sort()
        number, count = 0, 1
        for a, b in zip(run, run[1:]):
            if b - a > GAP:
                want.append((key, number, count))
                number, count = number + 1, 0
            count += 1
        want.append((key, number, count))
    assert sorted((r[0], r[3], r[4]) for r in plain) == sorted(want)
    assert max(n for key, n, _ in want if key == 0) > 20


def test_null_keys_and_empty(spark):
    packets = table(spark, traffic(hot=300)).withColumn("pair_key", F.lit(None).cast("string"))
    plain = result(FL.assemble(packets, gap_us=GAP, hot="none"))
    assert plain and result(FL.assemble(packets, gap_us=GAP, hot="sliced")) == plain
    assert result(FL.assemble(packets.limit(0), gap_us=GAP, hot="sliced")) == []


def test_hot_flow_is_spread(spark):
    """One flow without any gap is one session, cut into slices of like size."""
    packets = table(spark, [packet(i, 0, ">ACK", ts=i * GAP) for i in range(6000)])
    parts = FL.group_facts(FL.members(packets).withColumn("_bucket", F.floor(F.col("timestamp") / GAP)), [*FL.KEYS, "_bucket"])
    rows = FL.sliced_sessions(parts, GAP, partitions=8).groupBy("_slice", "session").count().collect()
    sizes = sorted(r["count"] for r in rows)
    assert len(sizes) == 8 and sum(sizes) == 6000 and sizes[-1] <= 2 * sizes[4]
    whole = FL.assemble(packets, gap_us=GAP, hot="sliced").collect()
    assert [(r.n_packets, r.session) for r in whole] == [(6000, 0)]


def test_null_key_sums(spark):
    rows = spark.createDataFrame([(None if i % 3 else "a", i, 1) for i in range(60)], "k string, i int, v int")
    found = skew.prefix_sums(rows, ["k"], ["i"], {"total": F.col("v")}, partitions=5).collect()
    by_key = {}
    for r in sorted(found, key=lambda r: r.i):
        by_key.setdefault(r.k, []).append(r.total)
    assert by_key == {"a": list(range(1, 21)), None: list(range(1, 41))}


def test_features_of_a_null_source(spark):
    rows = [(None, i, "k", "p", 20 + i % 4, 3, "PortClosed" if i % 2 else "DidNotSendData", i) for i in range(12)]
    named = [("x", *r[1:]) for r in rows]
    nameless, plain = (
        sorted(tuple(r)[1:] for r in FE.as_of(spark.createDataFrame(t, HISTORY), partitions=3).collect()) for t in (rows, named))
    assert nameless == plain and plain
