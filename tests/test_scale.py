"""Hot flows, hot sources, far pages: the spread-out ways give the plain results."""

import random

from pyspark.sql import functions as F

from flowwatch.operators import features as FE
from flowwatch.operators import flows as FL
from flowwatch.operators import search as SE
from flowwatch.operators import skew
from flowwatch.schema import HISTORY
from conftest import SMALL
from rows import packet, table

COMPARED = [*FL.KEYS, "n_packets", "protocol", "remote", "host_port", "first_ts", "last_ts", "short_path", *FL.SEEN]


def traffic(seed=3, hot=9000, flows=40):
    """One flow with most of the packets, many ties in time, plus small flows."""
    rng = random.Random(seed)
    kinds = [">SYN", "<SYN,ACK", ">ACK", "<RST", "<RST,ACK", ">PSH,ACK", ">FIN,ACK", "<ACK"]
    rows = []
    for i in range(hot + flows * 6):
        flow_key = 0 if i < hot else 1 + i % flows
        text = rng.choice(kinds[2:3] + kinds[5:] if flow_key == 0 and i != hot // 2 else kinds)
        rows.append(packet(i, flow_key, text, ts=rng.randrange(hot // 3), length=rng.choice([0, 0, 5])))
    rng.shuffle(rows)
    return rows


def result(rows):
    return sorted(map(tuple, rows.select(*COMPARED).collect()))


def test_hot_flows_are_exact(spark):
    packets = table(spark, traffic()).repartition(6)
    plain = result(FL.assemble(packets, hot="none"))
    assert result(FL.assemble(packets, hot="sliced")) == plain
    assert result(FL.assemble(packets, hot="auto", bound=100)) == plain
    by_hand = {}
    for r in sorted(traffic(), key=lambda r: (r[1], r[0])):
        by_hand.setdefault(r[9], []).append((r[12], ",".join(r[8])))
    for row in FL.assemble(packets, hot="sliced").collect():
        run = by_hand[row["flow_key"]]
        pairs = list(zip(run, run[1:]))
        closed = any(a == ("INCOME", "SYN") and b[0] == "OUTCOME" and b[1] in ("RST", "RST,ACK") for a, b in pairs)
        assert (row["n_packets"], row["pair_closed"]) == (len(run), closed)


def test_adjacency_across_slices(spark):
    rows = [packet(i, 0, ">ACK") for i in range(9000)]
    for at in (4095, 4096, 8191):  # a run over the border of two 4096-row chunks
        changed = list(rows)
        changed[at], changed[at + 1] = packet(at, 0, ">SYN"), packet(at + 1, 0, "<RST")
        found = FL.assemble(table(spark, changed), hot="sliced").first()
        assert found["pair_closed"] and found["n_packets"] == 9000
    assert not FL.assemble(table(spark, rows), hot="sliced").first()["pair_closed"]


def test_too_many_hot_flows_still_exact(spark, monkeypatch):
    packets = table(spark, traffic(hot=500))
    plain = result(FL.assemble(packets, hot="none"))
    monkeypatch.setattr(skew, "heavy_groups", lambda *a, **k: None)
    assert result(FL.assemble(packets, hot="auto")) == plain


def test_sessions_split_on_gap(spark):
    times = [0, 900_000, 1_900_000, 2_900_001, 2_900_002]
    rows = [packet(i, 1, ">ACK", ts=t) for i, t in enumerate(times)]
    found = FL.assemble(table(spark, rows), gap_us=1_000_000, hot="none")
    assert sorted(r["n_packets"] for r in found.collect()) == [2, 3]


def test_far_page(spark, monkeypatch):
    packets = table(spark, traffic(hot=300, flows=5))
    near = [r["packet_id"] for r in SE.page(packets, 7).collect()]
    monkeypatch.setattr(SE, "_DIRECT_ROWS", 0)
    assert [r["packet_id"] for r in SE.page(packets, 7).collect()] == near and len(near) == 20


def _history(seed=5, n=160):
    rng = random.Random(seed)
    names = ["PortClosed", "DidNotSendData", "SendData", "RemoveFinePackets", "InitializingConnection",
             "InitializingRemoveFinePackets", "SuspiciousAckWinScanAttack", "SuspiciousNetworkScan"]
    return [("hot" if rng.random() < 0.8 else f"s{rng.randrange(4)}", i, "k", "p", rng.randrange(20, 34),
             rng.randrange(1, 9), rng.choice(names), rng.randrange(80)) for i in range(n)]


def _by_hand(rows, threshold=5):
    opened = ("SendData", "RemoveFinePackets", "DidNotSendData")
    shut = ("PortClosed", "SuspiciousAckWinScanAttack")
    verdicts = [r[6] for r in rows]
    ports = {}
    for r in sorted(rows, key=lambda r: (r[7], r[1])):
        ports.setdefault(r[4], []).append(r[6])
    order = list(ports)
    used = sorted({r[4] for r in rows if r[6] in opened + shut})
    n_closed = len({r[4] for r in rows if r[6] in shut})
    sent = any(v in ("SendData", "RemoveFinePackets", "InitializingRemoveFinePackets") for v in verdicts)
    unsent = "DidNotSendData" in verdicts
    return (
        int(any(v in ("InitializingConnection", "InitializingRemoveFinePackets") for v in verdicts)),
        2 if sent and unsent else 1 if sent else 3,
        3 if any("DidNotSendData" in ports[a] and "PortClosed" in ports[b] for a, b in zip(order, order[1:])) else 1,
        1 if n_closed < threshold else 2 if n_closed == threshold else 3,
        n_closed, len(used), sum(b - a == 1 for a, b in zip(used, used[1:])),
        len({r[4] for r in rows if r[6] in opened}), sum(r[5] for r in rows if r[6] in opened),
    )


NAMES = ["host_initiated", "data_transfer", "closed_after_open", "threshold_class", "closed_ports", "used_ports",
         "port_pairs", "open_ports", "open_packets"]


def test_features_by_hand(spark):
    rows = _history()
    history = spark.createDataFrame(rows, HISTORY)
    for r in FE.snapshot(history).collect():
        assert tuple(r[n] for n in NAMES) == _by_hand([x for x in rows if x[0] == r["source"]])
    seen = FE.as_of(history, partitions=5).collect()
    assert len(seen) == sum(r[6] in FE.SCORED for r in rows)
    for r in seen:
        until = [x for x in rows if x[0] == r["source"] and (x[7], x[1]) <= (r["verdict_ts"], r["flow_key"])]
        assert tuple(r[n] for n in NAMES) == _by_hand(until)


def test_no_stage_is_left_to_the_interpreter(spark):
    """HotSpot compiles no method above 8000 bytes; the rules of a packet make one of 40 000."""
    from flowwatch.plans import catalog

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    for name in ("nrm8", "vrd1"):
        rows = catalog.QUERIES[name](spark, SMALL)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        assert rows.count() > 0


def test_hot_addresses_are_dealt_evenly(spark):
    rows = [(i, None if i % 10 == 0 else "host" if i % 10 < 6 else "listed" if i % 10 < 8 else f"a{i % 50}") for i in range(2000)]
    facts = spark.createDataFrame(rows, "id long, address string").repartition(3)
    dim = spark.createDataFrame([("listed",), ("a8",), ("a9",), (None,)], "address string").distinct()
    want = sorted(i for i, a in rows if a not in ("listed", "a8", "a9"))
    for bound in (50, 300, 10**6):
        assert sorted(r["id"] for r in skew.lookup_spread(facts, dim, "address", ["id"], bound).collect()) == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = skew.lookup_spread(facts, dim, "address", ["id"], 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in parts) < 1000  # the host alone has 1000 rows


def test_runs_over_the_borders_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(FL, "_CHUNK_BITS", 3)
    monkeypatch.setattr(FL, "_REACH", 5)
    flows = {0: "abcdefgh" * 5 + "xyz", 1: "a", 2: "abcdefgh", 3: "abcdefghi", None: "abcdefghijklmnopqr"}
    rows = [(k, pos, letter) for k, text in flows.items() for pos, letter in enumerate(text, 1)]
    placed = spark.createDataFrame(rows, "flow_key long, pos long, letter string").repartition(3)
    every = None
    for n in (1, 2, 3, 4, 9):
        got = FL.sliding(placed, n, ["flow_key"])
        want = [(k, i + 1, text[i:i + n]) for k, text in flows.items() for i in range(len(text) - n + 1)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        every = got if every is None else every.union(got) if n < 5 else every
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = every._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 2  # lengths 2 to 4, one shuffle of blocks
