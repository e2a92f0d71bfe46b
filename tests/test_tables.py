"""Flow counts, streams, files and models on the generated tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from flowwatch import Rules
from flowwatch.operators import flows as FL
from flowwatch.operators import model as MO
from flowwatch.operators import reports as RP
from flowwatch.operators import search as SE
from flowwatch.operators import verdicts as VD
from flowwatch.plans import catalog as C
from flowwatch.sources import packets as IO
from flowwatch.sources import traffic as T
from flowwatch.streaming import detect as ST

DEFAULT = {
    "AckWinScanAttack": 14, "ContinueIteration": 78, "DidNotSendData": 133, "MaimonScanAttack": 11,
    "FinScanAttack": 17, "InitializingConnection": 15, "InitializingConnectionAndDataTransfer": 228,
    "InitializingRemoveFinePackets": 235, "PortClosed": 257, "RemoveFinePackets": 240, "SendData": 245,
    "SuspiciousAckWinScanAttack": 11, "SuspiciousNetworkScan": 38, "TcpNullScanAttack": 12, "XmasScanAttack": 16,
}


def counts(rows):
    return {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}


def test_verdict_counts(spark):
    packets = T.packets(spark, SMALL)
    assert counts(VD.classify(FL.assemble(packets))) == DEFAULT
    literal = Rules.reference()
    want = {k: v for k, v in DEFAULT.items() if k not in ("MaimonScanAttack", "FinScanAttack")}
    want["DidNotSendData"] = 161
    assert counts(VD.classify(FL.assemble(packets, literal), literal)) == want


def test_order_and_repeats_do_not_matter(spark):
    packets = T.packets(spark, SMALL)
    shuffled = packets.orderBy(F.rand(1)).repartition(5)
    cols = [*FL.KEYS, "n_packets", "short_path", "verdict"]
    rows = lambda p: sorted(map(tuple, VD.classify(FL.assemble(p)).select(*cols).collect()))
    assert rows(packets) == rows(shuffled)


def _landed(packets, path, files):
    packets.repartition(files, "packet_id").write.parquet(path)


@pytest.mark.parametrize("files, per_trigger", [(6, 1), (3, 100)])
def test_stream_equals_batch(spark, tmp_path, files, per_trigger):
    """Files hold packets of all times, so flows are spread over the batches."""
    packets = T.packets(spark, SMALL)
    landing, offsets = str(tmp_path / "landing"), str(tmp_path / "offsets")
    _landed(packets, landing, files)
    store = ST.FlowStore(str(tmp_path / "store"), buckets=4)
    ST.record(ST.packet_stream(spark, landing, per_trigger), store, offsets).awaitTermination()
    cols = [*FL.KEYS, "n_packets", "first_ts", "last_ts", "short_path"]
    rows = lambda d: sorted(map(str, d.select(*cols).collect()))
    assert rows(store.flows(spark)) == rows(FL.assemble(packets, gap_us=1_000_000))


def test_stream_goes_on_after_a_stop_and_repeats_nothing(spark, tmp_path):
    packets = T.packets(spark, SMALL)
    landing, offsets = str(tmp_path / "landing"), str(tmp_path / "offsets")
    half = F.col("packet_id") % 2 == 0
    packets.where(half).coalesce(1).write.parquet(landing)
    store = ST.FlowStore(str(tmp_path / "store"), buckets=4)
    ST.record(ST.packet_stream(spark, landing, 1), store, offsets).awaitTermination()
    packets.where(~half).coalesce(1).write.mode("append").parquet(landing)
    again = ST.FlowStore(str(tmp_path / "store"), buckets=4)
    ST.record(ST.packet_stream(spark, landing, 1), again, offsets).awaitTermination()
    again(packets.where(~half), 1)  # a replayed batch
    assert counts(VD.classify(again.flows(spark))) == counts(VD.classify(FL.assemble(packets, gap_us=1_000_000)))


def test_long_flow(spark):
    """A flow that never pauses: its order is in `positions`, `short_path` is for short ones."""
    one = T.packets(spark, SMALL).where("protocol = 'TCP'").limit(1)
    flow = one.crossJoin(spark.range(40)).withColumns({
        "packet_id": F.col("id"), "timestamp": F.col("timestamp") + F.col("id") * 1000}).drop("id")
    row = FL.assemble(flow).first()
    assert row["n_packets"] == 40 and row["short_path"] is None and "path" not in row
    assert sorted(r["pos"] for r in FL.positions(flow).collect()) == list(range(1, 41))


def test_session_form_on_a_table(spark):
    packets = T.packets(spark, SMALL)
    assert counts(ST.session_verdicts(packets, Rules(), "10 seconds")) == DEFAULT


def test_lookup_reads_one_bucket(spark):
    store = C.history_store(spark, SMALL)
    plan = SE.history_of(store, C.ONE_SOURCE, "PortClosed")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "verdict" in filters
    assert SE.history_of(store, C.ONE_SOURCE).count() == store.where(F.col("source") == C.ONE_SOURCE).count()


def test_port_file(spark, tmp_path):
    path = tmp_path / "ports.csv"
    path.write_text("22,true,true,true,shell, secure\n80,false,true,true,web\n")
    rows = {r["port"]: r for r in IO.read_port_info(spark, str(path)).collect()}
    assert rows[22]["description"] == "shell, secure" and rows[80]["tcp"] is False


def test_model_ranks_labels(spark):
    rows = C.written(C.labelled_features(spark, SMALL), "labelled").cache()
    model = MO.train(MO.split(rows)[0], trees=20)
    means = {r["label"]: r["m"] for r in MO.score(rows, model).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[0.0] < 50 <= means[1.0] and means[0.0] < means[0.5] < means[1.0]
    points = {r["label"]: r["prediction"] for r in MO.smoke_points(model, rows).collect()}
    assert points[0.0] < points[0.5] < points[1.0]
    gap = rows.limit(1).withColumn("open_port_factor", F.lit(None).cast("double"))
    assert MO.score(gap, model).first()["score"] == 0


def test_complete_and_base_alerts_roll_up_alike(spark):
    v = C.stored_verdicts(spark, SMALL)
    from flowwatch.operators import alerts as AL
    base, history = C.sure_alerts(v), VD.history(v)
    a = RP.roll_up(base, source_ports=AL.scanned_ports(history))
    b = RP.roll_up(AL.build(base, history))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("name", ["src1", "snk5", "nrm1", "nrm7", "flt4", "flw11", "seq8", "vrd1", "fea5", "alr3", "rpt1"])
def test_catalog_against_sql(spark, name):
    import oracle_check

    import __spark_entry__ as entry

    assert oracle_check.compare(spark, oracle_check.connect(SMALL), name, SMALL, entry.oracle_sql()[name]) == ""


def test_metrics_of_one_pass(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    class Half:
        def transform(self, rows):
            return rows.withColumn("prediction", F.col("x") / 2)

    rows = spark.createDataFrame([(0.0, 0.1), (1.0, 1.5), (0.5, 0.9), (0.0, 0.4)], "label double, x double")
    for part in (rows, rows.limit(1), rows.limit(0)):
        got = MO.evaluate(Half(), part)
        for metric, value in got.items():
            want = RegressionEvaluator(labelCol="label", metricName=metric).evaluate(Half().transform(part)) if part.count() else math.nan
            assert value == pytest.approx(want, nan_ok=True), metric


def test_shared_features_are_made_once(spark, monkeypatch):
    from flowwatch.plans import catalog

    made, verdicts = [], []
    features, stored = catalog.labelled_features, catalog.stored_verdicts
    monkeypatch.setattr(catalog, "labelled_features", lambda s, d: made.append(d) or features(s, d))
    monkeypatch.setattr(catalog, "stored_verdicts", lambda s, d: verdicts.append(d) or stored(s, d))
    folder = SMALL + "/."  # no other test has trained on it under this name
    assert catalog.QUERIES["mod2"](spark, folder).count() == 6 and len(made) == 1
    assert catalog.QUERIES["rpt2"](spark, folder).count() > 0 and len(verdicts) == 1
