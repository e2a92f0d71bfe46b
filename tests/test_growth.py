"""What must not grow faster than the input: parts of made packets, files that land, stored bytes, merged sessions."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import SMALL
from flowwatch import Rules
from flowwatch.operators import flows as FL
from flowwatch.operators import skew
from flowwatch.operators import verdicts as VD
from flowwatch.plans import catalog as C
from flowwatch.sources import traffic as T
from flowwatch.streaming import detect as ST
from flowwatch.streaming import store as store_module
from rows import flow, packet, table

GAP = Rules().quiet_us


def orders(spark, folder, n):
    made = spark.range(n).selectExpr(
        "id AS o_orderkey", "id % 50 AS o_custkey", "timestamp'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 2500 AS int)) AS o_orderdate")
    made.coalesce(1).write.parquet(os.path.join(folder, "orders.parquet"))
    return str(folder)


def test_packets_of_one_row_group_are_made_in_several_tasks(spark, tmp_path):
    d = orders(spark, tmp_path, 2 * T.ROWS + 1)
    assert T.packets(spark, d).rdd.getNumPartitions() >= 3
    assert T.conversations(spark, d).select("flow_key").distinct().count() == 2 * T.ROWS + 1


def test_landing_files_are_bounded(spark, tmp_path, monkeypatch):
    d = orders(spark, tmp_path, 2000)
    monkeypatch.setattr(T, "ROWS", 50)
    monkeypatch.setattr(C, "FILES", 3)
    path = C.landed(spark, d)
    files = [n for n in os.listdir(path) if n.endswith(".parquet")]
    assert len(files) <= 3 * (len(C.SLICES) + 1)
    want = T.packets(spark, d)
    got = spark.read.schema(want.schema).parquet(path)
    show = lambda rows: sorted(r[0] for r in rows.selectExpr("to_json(struct(*))").collect())
    assert show(got) == show(want)


def test_json_texts_are_stored_compressed(spark, monkeypatch):
    made = []
    monkeypatch.setattr(C, "scratch_path", lambda s, name, make=C.scratch_path: made.append(make(s, name)) or made[-1])
    want = {r[0]: r[1] for r in T.packets(spark, SMALL).groupBy("protocol").count().collect()}
    got = {r.protocol: r.n for r in C.QUERIES["src1"](spark, SMALL).collect()}
    assert got == {"BAD" if k == "ARP" else k: n for k, n in want.items()}
    sizes = [os.path.getsize(os.path.join(made[0], n)) for n in os.listdir(made[0]) if n.startswith("part-")]
    text = spark.read.text(made[0]).selectExpr("sum(length(value) + 1)").first()[0]
    assert 0 < sum(sizes) < text / 8


def test_stored_verdicts_hold_what_is_read(spark):
    packets = table(spark, flow(1, ">SYN", "<RST,ACK") + flow(2, "<SYN", ">SYN,ACK") + flow(3, ">", protocol="UDP"))
    whole = VD.classify(FL.assemble(packets))
    kept = VD.narrow(whole)
    assert not {"own_first", "last", "first_out"} & set(kept.columns)
    show = lambda rows: sorted(map(str, rows.collect()))
    assert show(C.sure_alerts(kept)) == show(C.sure_alerts(whole)) != []
    assert show(VD.history(kept)) == show(VD.history(whole))


def test_only_flows_that_go_on_are_merged(spark, tmp_path, monkeypatch):
    """A batch with one flow that goes on: the sessions of the others are not merged again."""
    merged, merge = [], ST.FlowStore._merged

    def noted(self, spark, own, *rest):
        merged.append(sorted(r[0] for r in own.select("flow_key").distinct().collect()))
        return merge(self, spark, own, *rest)

    monkeypatch.setattr(ST.FlowStore, "_merged", noted)
    rows = [packet(k, k % 5, ">ACK", ts=k * 1000) for k in range(20)]
    later = [packet(100 + k, 4 + k % 5, ">ACK", ts=20_000 + k * 1000) for k in range(20)]
    store = ST.FlowStore(str(tmp_path / "store"))
    for batch, part in enumerate([rows, later]):
        store(table(spark, part), batch)
    assert merged == [[4]]
    columns = [*FL.KEYS, "n_packets", "first_ts", "last_ts", "short_path", *FL.SEEN]
    show = lambda rows: sorted(map(str, rows.select(*columns).collect()))
    assert show(store.flows(spark)) == show(FL.assemble(table(spark, rows + later), gap_us=GAP))


def test_sessions_list_a_flow_once(spark):
    """No window over packets; the same sessions as in slices, with ties, pauses and packets without a time."""
    times = [0, 0, 5, GAP, 2 * GAP + 1, 2 * GAP + 2, 9 * GAP, None, None, 9 * GAP]
    rows = [packet(100 * f + i, f, (">SYN", "<ACK", ">FIN,ACK")[(i + f) % 3], ts=t) for f in range(4) for i, t in enumerate(times[f:])]
    rows = [r if t is not None else (r[0], None, *r[2:]) for r, t in zip(rows, [t for f in range(4) for t in times[f:]])]
    rows += [packet(5000 + i, 9, ">ACK", ts=i // 2 * 2 * GAP) for i in range(6000)]  # 3000 sessions of one flow
    members = FL.own_members(table(spark, rows))
    listed = FL.session_facts(members, GAP)
    assert "Window" not in listed._jdf.queryExecution().executedPlan().toString()
    assert listed.where("flow_key = 9 and n_packets = 2").count() == 3000
    columns = [*FL.KEYS, "session", "n_packets", "own_first", "first", "last", "first_in", "first_out", "path", *FL.SEEN]
    show = lambda rows: sorted(map(str, rows.select(*columns).collect()))
    timed = members.where("timestamp IS NOT NULL")
    assert show(FL.session_facts(timed, GAP)) == show(FL.session_facts(timed, GAP, hot="sliced"))
    assert {r.flow_key: r.n for r in listed.where("flow_key < 9").selectExpr("flow_key", "n_packets").groupBy("flow_key").agg(
        {"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {0: 3, 1: 3, 2: 3, 3: 3}


def test_groups_are_counted_one_by_one_only_where_a_counter_is_full(spark, monkeypatch):
    rows = table(spark, [packet(i, i, ">ACK") for i in range(300)] + [packet(1000 + i, 7, ">ACK") for i in range(60)])
    looked, group = [], type(rows).groupBy

    def noted(self, *columns):
        looked.append(len(columns))
        return group(self, *columns)

    monkeypatch.setattr(type(rows), "groupBy", noted)
    assert skew.heavy_groups(rows, ["flow_key", "pair_key"], 100) == [] and looked == [1]
    assert [(r.flow_key, r.n) for r in skew.heavy_groups(rows, ["flow_key", "pair_key"], 50)] == [(7, 61)] and looked == [1, 1, 2]


def test_features_of_many_and_few_sources_are_the_same(spark, tmp_path, monkeypatch):
    """A batch that touches many sources does not join all their verdict rows with the list of them."""
    packets, model = T.packets(spark, SMALL).where("flow_key < 600"), C.StatedModel()
    shown = ["time", "scan_type", "attack_type", "attacker", "port", "chance", *FL.KEYS]
    found = []
    for few in (ST.FEW, 0):
        monkeypatch.setattr(ST, "FEW", few)
        sink = ST.Recorder(str(tmp_path / f"store{few}"), model, buckets=2)
        for k in range(2):
            sink(packets.where(f"flow_key % 2 = {k}"), k)
        found.append(sorted(map(str, sink.alerts(spark).select(*shown).collect())))
    assert found[0] and found[0] == found[1]


def test_old_packets_of_other_times_are_not_read_again(spark, tmp_path):
    """Pairs with UDP and ICMP packets are made again from the files of their own time."""
    store = ST.FlowStore(str(tmp_path / "store"))
    udp = [packet(1, 1, ">", protocol="UDP", ts=50 * GAP), packet(2, 1, "<", protocol="ICMP", ts=50 * GAP + 5)]
    for k, rows in enumerate(([packet(9, 9, ">SYN", ts=0)], udp)):
        store(table(spark, rows), k)
    pairs = store.of_batch(spark, "kinds", 1).select("flow_key", "pair_key").distinct()
    old = store.live(spark, "sessions", 0).where("false").select("at", "first", "batch", *FL.KEYS)
    again = store._packets_of(spark, pairs, old, 50 * GAP, 50 * GAP + 5, 1)
    assert again.count() == 2
    assert "timestamp" in again._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


def test_a_generation_is_made_once(spark, tmp_path, monkeypatch):
    """Ranges of time come from the stored column; rows without a time stay."""
    monkeypatch.setattr(store_module, "FILE_ROWS", 40)
    store = ST.FlowStore(str(tmp_path / "store"))
    rows = [packet(i, i, ">ACK", ts=i * GAP) for i in range(200)] + [(900, None, *packet(900, 900, ">SYN")[2:])]
    store(table(spark, rows), 0)
    sampled = []
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: sampled.append(a))
    store.compact(spark, evict=False)
    assert not sampled and store.live(spark).count() == 201
    files = spark.read.parquet(f"{store.folder}/packets-1").selectExpr("timestamp", "input_file_name() AS f")
    ranges = sorted((r[0], r[1]) for r in files.where("timestamp IS NOT NULL").groupBy("f").agg(
        F.min("timestamp"), F.max("timestamp")).select("min(timestamp)", "max(timestamp)").collect())
    assert len(ranges) >= 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert files.count() == 201
