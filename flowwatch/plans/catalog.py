"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P
from flowwatch.functions import patterns as S
from flowwatch.functions import scores as SC
from flowwatch.operators import alerts as AL
from flowwatch.operators import features as FE
from flowwatch.operators import flows as FL
from flowwatch.operators import layout as LY
from flowwatch.operators import model as MO
from flowwatch.operators import networks as NW
from flowwatch.operators import normalize as NO
from flowwatch.operators import reports as RP
from flowwatch.operators import search as SE
from flowwatch.operators import verdicts as VD
from flowwatch.plans import detect as DE
from flowwatch.rules import Rules
from flowwatch.schema import FEATURES
from flowwatch.session import scratch_path
from flowwatch.sources import packets as IO
from flowwatch.sources import traffic as T
from flowwatch.streaming import detect as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HOSTS = [T.HOST]

# search and report arguments the oracles share
SEARCH = {"protocols": "TCP,UDP", "source": r"^10\.0\.[0-3]\.", "destination_port": "80"}
ONE_SOURCE = "10.0.0.5"
AFTER = 946684800000000  # 2000-01-01
QUIET_NETWORKS = ["10.0.1.0/28", "10.0.4.7/25", "10.0.5.9", "fe80::/10"]
READ_BEFORE = 883612800000000  # 1998-01-01
PORT_NAMES = [(22, True, True, True, "ssh"), (53, True, True, False, "dns"), (80, True, True, True, "http"),
              (443, True, True, True, "https"), (25, True, True, False, "smtp"), (23, True, True, False, "telnet")]
SLICES = ["1994-01-01", "1996-01-01", "1998-01-01", "2000-01-01"]
FILES = 10  # of a slice of time, as it lands


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def flows(spark, d, rules: Rules = Rules(), **options) -> DataFrame:
    return FL.assemble(T.packets(spark, d), rules, **options)


def verdicts(spark, d, rules: Rules = Rules(), honeypot: DataFrame | None = None) -> DataFrame:
    return VD.classify(flows(spark, d, rules), rules, honeypot)


def stored_verdicts(spark, d) -> DataFrame:
    """Verdict rows as a table, for queries that read them more than once."""
    return written(VD.narrow(verdicts(spark, d)), "verdicts")


def history(spark, d, rules: Rules = Rules()) -> DataFrame:
    return VD.history(verdicts(spark, d, rules))


def tcp_packets(spark, d) -> DataFrame:
    return P.with_tcp_fields(T.packets(spark, d))


def joined_text(column: str) -> Column:
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), ",").alias(column)


def sure_alerts(verdict_rows: DataFrame) -> DataFrame:
    """Direct alerts, and every PortClosed or DidNotSendData flow as if scored 100."""
    verdict = F.col("verdict")
    kind = F.when(verdict.isin(V.PORT_CLOSED, V.NO_DATA), V.PORT_SCAN_ALERT).otherwise(verdict)
    return AL.raise_alerts(verdict_rows.withColumns({"outcome": kind, "chance": F.lit(100)}))


def written(rows: DataFrame, name: str, **options) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    IO.append(rows, path, **options)
    return rows.sparkSession.read.parquet(path)


def stored_alerts(spark, d) -> DataFrame:
    """Alerts as the table that lookups and removals work on."""
    return written(sure_alerts(stored_verdicts(spark, d)), "alerts")


# --- sources and sinks ---------------------------------------------------------


@query("src1")
def _(spark, d):
    path = scratch_path(spark, "json")
    texts = T.packets(spark, d).select("protocol", F.to_json(F.struct("*")).alias("json"))
    damaged = F.when(F.col("protocol") == V.ARP, F.substring("json", 1, 40)).otherwise(F.col("json"))
    texts.select(damaged.alias("value")).write.option("compression", "gzip").text(path)  # plain texts take some 16 times the disk
    read = IO.read_packets(spark, path)
    kind = F.when(F.col(IO.BAD_RECORD).isNotNull(), "BAD").otherwise(F.col("protocol"))
    return read.groupBy(kind.alias("protocol")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"),
        F.sum(F.coalesce(F.size("flags"), F.lit(0)).cast("long")).alias("n_flags"),
    ).select("protocol", "n", F.coalesce("total_length", F.lit(0)).alias("total_length"),
             F.greatest("n_flags", F.lit(0)).alias("n_flags"))


@query("src2")
def _(spark, d):
    return SE.next_batch(T.packets(spark, d)).select("packet_id", "timestamp", "protocol")


@query("src3")
def _(spark, d):
    path = scratch_path(spark, "training")
    labelled = labelled_features(spark, d)
    labelled.select(*[F.col(c).cast("double") for c in FEATURES], "label").write.option("header", True).csv(path)
    return IO.read_training(spark, path).select(*[F.round(c, 9).alias(c) for c in FEATURES], "label")


@query("src4")
def _(spark, d):
    names = spark.createDataFrame(PORT_NAMES, "port int, tcp boolean, udp boolean, sctp boolean, description string")
    counted = T.packets(spark, d).groupBy(F.col("destination_port").alias("port")).agg(F.count(F.lit(1)).alias("n"))
    kinds = [F.coalesce(c, F.lit(False)).alias(c) for c in ("port_tcp", "port_udp", "port_sctp")]
    return IO.enrich_port(counted, names).select(
        "port", "n", *kinds, F.coalesce("port_description", F.lit("")).alias("port_description"))


@query("snk1")
def _(spark, d):
    stored = written(IO.with_day(T.packets(spark, d)), "captured", partition_by=["day"], spread="packet_id")
    return stored.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"))


@query("snk2")
def _(spark, d):
    """Moves what has landed; a second run finds nothing left to move."""
    landing, target, offsets = (scratch_path(spark, n) for n in ("landing", "analysed", "offsets"))
    T.packets(spark, d).write.parquet(landing)
    for _ in range(2):
        ST.run_to_table(ST.packet_stream(spark, landing), target, offsets).awaitTermination()
    return spark.read.parquet(target).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("packet_id").alias("n_ids")
    )


@query("snk3")
def _(spark, d):
    return written(history(spark, d), "history").select(
        "source", "flow_key", "l4_key", "port", "n_packets", "verdict", "verdict_ts"
    )


@query("snk4")
def _(spark, d):
    stored = stored_alerts(spark, d)
    return stored.groupBy("scan_type", "attack_type").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("latest"))


@query("snk5")
def _(spark, d):
    rows = T.packets(spark, d).select(
        "packet_id", "timestamp", "protocol", "source_address", "source_port", "info", "flags", "length"
    )
    return IO.as_json(rows)


@query("snk5_history")
def _(spark, d):
    return IO.as_json(history(spark, d).select("source", "flow_key", "port", "n_packets", "verdict"))


@query("snk5_alert")
def _(spark, d):
    return IO.as_json(sure_alerts(stored_verdicts(spark, d)).select("attacker", "scan_type", "attack_type", "tools", "port"))


# --- normalisation ----------------------------------------------------------------


def normal(spark, d) -> DataFrame:
    return NO.normalize(T.layered(spark, d), HOSTS)


def _normal_query(name: str, *columns, protocol: list[str] | None = None):
    def run(spark, d):
        rows = normal(spark, d)
        if protocol:
            rows = rows.where(F.col("protocol").isin(protocol))
        return rows.select("packet_id", *[c() if callable(c) else c for c in columns])
    QUERIES[name] = run


_normal_query("nrm1", "protocol")
_normal_query("nrm2", "source_address", "destination_address")
_normal_query("nrm3", "direction")
_normal_query(
    "nrm4", *[(lambda k=k: F.try_element_at("info", F.lit(k)).alias(k.lower())) for k in V.TCP_INFO_KEYS],
    lambda: joined_text("flags"), "length", protocol=[V.TCP],
)
_normal_query("nrm5", "source_address", "destination_address", "source_port", "destination_port", "length",
              protocol=[V.UDP])
_normal_query("nrm6", lambda: joined_text("flags"), "source_port", "l4_key", "length", protocol=[V.ICMP])
_normal_query("nrm7", lambda: joined_text("flags"), "source_port", "length", protocol=[V.SCTP])
_normal_query("nrm8", "source_address", "source_port", "l4_key", "length", protocol=[V.ARP])
_normal_query("nrm9", "source_address", "l4_key", "length", protocol=[V.IPV4, V.IPV6])
_normal_query("nrm11", "l4_key")
_normal_query("nrm12", "pair_key")
_normal_query("nrm13", "flow_key", "l4_key", "pair_key")


@query("nrm10")
def _(spark, d):
    return T.layered(spark, d).where(F.col("ip4_destination").isin(V.MULTICAST)).select("packet_id")


@query("nrm10_networks")
def _(spark, d):
    return T.layered(spark, d).where(NW.within(F.col("ip4_destination"), V.MULTICAST_NETWORKS)).select("packet_id")


@query("nrm14")
def _(spark, d):
    return T.packets(spark, d).select("packet_id", P.flag_text(F.col("flags")).alias("text"))


@query("nrm15")
def _(spark, d):
    shown = F.concat(F.lit("[INET4:"), F.col("source_address"), F.lit("]"))
    return T.packets(spark, d).select(P.readable_address(shown).alias("address")).distinct()


@query("nrm16")
def _(spark, d):
    return T.packets(spark, d).select("packet_id", P.info_text().alias("text"))


# --- filters ------------------------------------------------------------------------


@query("flt1")
def _(spark, d):
    return SE.of_host(normal(spark, d), HOSTS).select("packet_id")


@query("flt2")
def _(spark, d):
    return SE.not_ignored(T.packets(spark, d), T.honeypot_sources(spark, d)).select("packet_id")


@query("flt2_list")
def _(spark, d):
    return SE.not_ignored(T.packets(spark, d), [ONE_SOURCE, "10.0.0.6"]).select("packet_id")


@query("flt2_networks")
def _(spark, d):
    return SE.outside(T.packets(spark, d), QUIET_NETWORKS).select("packet_id")


@query("flt2_network_table")
def _(spark, d):
    """Without the neighbourhood (/30) of every address that the honeypot has recorded."""
    listed = T.honeypot_sources(spark, d).select(F.concat("source", F.lit("/30")).alias("network"))
    return SE.outside(T.packets(spark, d), listed).select("packet_id")


@query("flt3")
def _(spark, d):
    return SE.find(T.packets(spark, d), **SEARCH).select("packet_id", "protocol", "source_address")


@query("flt3_layout")
def _(spark, d):
    """The same search on a table whose files hold near rows."""
    path = scratch_path(spark, "laid-out")
    LY.write_clustered(T.packets(spark, d), path)
    return SE.find(spark.read.parquet(path), **SEARCH).select("packet_id", "protocol", "source_address")


@query("flt4")
def _(spark, d):
    return SE.page(SE.find(T.packets(spark, d), **SEARCH), 3).select("packet_id", "timestamp")


@query("flt5")
def _(spark, d):
    return SE.page_count(SE.find(T.packets(spark, d), **SEARCH))


@query("flt6")
def _(spark, d):
    wanted = verdicts(spark, d).where(F.col("verdict") == V.PORT_CLOSED)
    return SE.of_flows(T.packets(spark, d), wanted, ["flow_key", "l4_key"]).select("packet_id")


@query("flt7")
def _(spark, d):
    pk = T.packets(spark, d)
    udp = pk.where(F.col("protocol") == V.UDP)
    return SE.of_flows(pk.where(F.col("protocol") == V.ICMP), udp, ["flow_key"]).select("packet_id")


@query("flt8")
def _(spark, d):
    pk = T.packets(spark, d)
    asked = pk.where(P.is_incoming()).select(*FL.KEYS).distinct()
    return SE.with_more_packets(asked, pk.where(P.is_outgoing()), FL.KEYS).select("flow_key", "l4_key")


@query("flt9")
def _(spark, d):
    pk = T.packets(spark, d)
    asked = pk.where(F.col("protocol") == V.UDP).select("flow_key").distinct()
    return SE.with_more_packets(asked, pk, ["flow_key"], V.ICMP)


def history_store(spark, d) -> DataFrame:
    """The verdict log as the table that lookups read: folders by verdict and source bucket."""
    return written(IO.by_key(history(spark, d), "source"), "history-store", partition_by=["verdict", "bucket"])


def alert_store(spark, d) -> DataFrame:
    rows = sure_alerts(stored_verdicts(spark, d))
    return written(IO.by_key(rows, "attacker"), "alert-store", partition_by=["bucket"])


@query("flt10")
def _(spark, d):
    return SE.history_of(history_store(spark, d), source=ONE_SOURCE).select("source", "flow_key", "verdict")


@query("flt11")
def _(spark, d):
    return SE.history_of(history_store(spark, d), ONE_SOURCE, V.PORT_CLOSED).select("source", "flow_key", "verdict")


@query("flt12")
def _(spark, d):
    return SE.history_of(history_store(spark, d), verdict=V.SEND_DATA).select("source", "flow_key", "verdict")


@query("flt13")
def _(spark, d):
    return SE.alerts_of(alert_store(spark, d), ONE_SOURCE, V.PORT_SCAN, "TCP SYN").select("attacker", "flow_key", "port")


@query("flt14")
def _(spark, d):
    return SE.alerts_after(stored_alerts(spark, d), AFTER).select("attacker", "flow_key", "time")


# --- packet predicates --------------------------------------------------------------

_PREDICATES = {
    "prd1": {"hit": P.only_ack}, "prd2": {"hit": P.only_rst},
    "prd4": {"incoming": P.is_incoming, "outgoing": P.is_outgoing},
    "prd5": {"hit": P.only_fin_ack}, "prd6": {"syn": P.contains_syn, "ack": P.contains_ack},
    "prd7": {"syn": P.only_syn, "fin": P.only_fin}, "prd8": {"hit": P.contains_init},
    "prd9": {"hit": P.syn_ack}, "prd10": {"hit": P.rst_ack}, "prd11": {"hit": P.abort_first},
    "prd12": {"hit": P.port_unreachable}, "prd13": {"hit": P.only_psh_ack},
    "prd14": {"correct": P.checksum_ok, "wrong": P.checksum_bad}, "prd15": {"hit": P.only_fin_psh_urg},
    "prd16": {"data": P.data_chunk, "shutdown": P.shutdown_chunk},
    "prd3": {n.lower(): (lambda n=n: P.is_protocol(n)) for n in (V.TCP, V.UDP, V.SCTP, V.IPV4, V.IPV6, V.ICMP)},
    "prd17": {
        "internet": lambda: P.in_internet_layer(F.col("protocol")),
        "connection": lambda: P.in_connection_set(F.col("protocol")),
        "transport": lambda: P.in_transport_set(F.col("protocol")),
    },
}
for _name, _tests in _PREDICATES.items():
    QUERIES[_name] = lambda spark, d, tests=_tests: tcp_packets(spark, d).select(
        "packet_id", *[test().alias(label) for label, test in tests.items()]
    )


# --- flows --------------------------------------------------------------------------


@query("flw1")
def _(spark, d):
    return flows(spark, d).select(
        *FL.KEYS, "n_packets", "first_ts", "last_ts", F.col("first.packet_id").alias("first_id"),
        F.col("last.packet_id").alias("last_id"), "short_path",
    )


@query("flw1_positions")
def _(spark, d):
    return FL.positions(T.packets(spark, d)).select("packet_id", "pos")


@query("flw2")
def _(spark, d):
    return FL.coarse_groups(T.packets(spark, d))


@query("flw3")
def _(spark, d):
    return flows(spark, d).select("flow_key", "l4_key", "protocol")


@query("flw4")
def _(spark, d):
    return FL.members(T.packets(spark, d)).where("rekeyed").select("packet_id", "l4_key")


@query("flw4_crowded")
def _(spark, d):
    """UDP flows when all packets of a host pair have one flow key: every pair with more than a few ICMP packets
    takes the way without a product."""
    found = FL.assemble(T.packets(spark, d).withColumn("flow_key", F.lit(0).cast("long")), product=0)
    return found.where(F.col("protocol") == V.UDP).select(
        "l4_key", "pair_key", "n_packets", F.col("first.packet_id").alias("first_id"),
        F.col("last.packet_id").alias("last_id"), "pair_unreachable", "saw_in_payload",
    )


@query("flw5")
def _(spark, d):
    rows = FL.members(T.packets(spark, d), Rules(icmp_pulls_udp=True))
    return rows.where(F.col("rekeyed") & (F.col("protocol") == V.UDP)).select("packet_id", "l4_key")


@query("flw6")
def _(spark, d):
    pk = T.packets(spark, d)
    both = FL.combine(pk.where(P.is_incoming()), pk.where(P.is_outgoing()))
    return FL.assemble(both).select("flow_key", "l4_key", "n_packets", "short_path")


@query("flw7")
def _(spark, d):
    return flows(spark, d).select("flow_key", "l4_key", "remote")


@query("flw8")
def _(spark, d):
    return flows(spark, d).select("flow_key", "l4_key", "host_port")


@query("flw9")
def _(spark, d):
    return flows(spark, d).select("flow_key", "l4_key", FL.gap_us(F.col("first"), F.col("last")).alias("gap"))


@query("flw10")
def _(spark, d):
    return flows(spark, d).where(F.col("first_in").isNotNull()).select(
        "flow_key", "l4_key", F.col("first_in.packet_id").alias("packet_id"),
        F.col("first_in.address").alias("address"), F.col("first_in.port").alias("port"),
    )


@query("flw11")
def _(spark, d):
    placed = written(FL.letters(T.packets(spark, d)), "letters")  # placed once for all lengths
    parts = [
        FL.sliding(placed, n).groupBy("run").agg(F.count(F.lit(1)).alias("n_runs")).withColumn("n", F.lit(n))
        for n in (2, 3, 4)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SEQUENCES = {
    "seq1": S.host_initiated, "seq2": S.closed, "seq3": S.properly_closed, "seq4": S.closed_two_packets,
    "seq5": S.connect_four_packets, "seq6": S.port_closed,
    "seq7": S.udp_port_closed, "seq8": S.data_sent,
    "seq9": S.ack_win, "seq10": S.suspicious_ack_win, "seq11": S.null_scan, "seq12": S.maimon,
    "seq13": S.suspicious_maimon, "seq14": S.xmas, "seq15": S.fin_scan, "seq16": S.suspicious_fin,
    "seq17": S.not_properly_finished, "seq18": S.last_is_incoming, "seq19": S.incoming_internet,
}
for _name, _rule in _SEQUENCES.items():
    QUERIES[_name] = lambda spark, d, rule=_rule: flows(spark, d).where(rule()).select("flow_key", "l4_key")


# --- verdicts ---------------------------------------------------------------------------


@query("vrd1")
def _(spark, d):
    return verdicts(spark, d).select("flow_key", "l4_key", "verdict")


@query("vrd1_reference")
def _(spark, d):
    return verdicts(spark, d, Rules.reference()).select("flow_key", "l4_key", "verdict")


@query("vrd1_honeypot")
def _(spark, d):
    return verdicts(spark, d, honeypot=T.honeypot_sources(spark, d)).select("flow_key", "l4_key", "verdict")


@query("vrd2")
def _(spark, d):
    effects = ["writes_history", "is_scored", "evicts_flow", "alerts_at_once"]
    return VD.follow_up(verdicts(spark, d)).groupBy("verdict", *effects).agg(F.count(F.lit(1)).alias("n"))


@query("vrd3")
def _(spark, d):
    pk = T.packets(spark, d)
    parts = []
    for mode, rules in (("default", Rules()), ("literal", Rules(quiet_counts_later_only=False))):
        after = VD.quiet_period(verdicts(spark, d, rules), pk, rules)
        parts.append(after.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode)))
    return parts[0].unionByName(parts[1])


@query("vrd4")
def _(spark, d):
    return VD.retained(verdicts(spark, d)).select("flow_key", "l4_key")


@query("vrd5")
def _(spark, d):
    return VD.classify(flows(spark, d), as_honeypot=True).groupBy("protocol", "verdict").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("his1")
def _(spark, d):
    return history(spark, d).select(
        "source", "flow_key", "l4_key", "pair_key", "port", "n_packets", "verdict", "verdict_ts"
    )


# --- features -----------------------------------------------------------------------------

for _name, _columns in {
    "fea1": ["host_initiated"], "fea2": ["data_transfer"], "fea3": ["closed_after_open"],
    "fea4": ["closed_ports", "threshold_class"], "fea5": ["used_ports", "neighbour_factor"],
    "fea6": ["open_ports", "open_packets", "open_port_factor"], "fea7": ["closed_port_score"],
}.items():
    QUERIES[_name] = lambda spark, d, columns=_columns: FE.snapshot(history(spark, d)).select(
        "source", *[F.round(c, 9).alias(c) if c.endswith(("factor", "score")) else c for c in columns]
    )


def rounded_features() -> list[Column]:
    return [F.round(F.col(c).cast("double"), 9).alias(c) for c in FEATURES]


@query("fea8")
def _(spark, d):
    v = F.col("verdict")
    return history(spark, d).groupBy("source").agg(
        F.count(F.when(v.isin(V.OPEN_PORT_LABELS), 1)).alias("n_open"),
        F.count(F.when(v.isin(V.CLOSED_PORT_LABELS), 1)).alias("n_closed"),
        F.count(F.when(v.isin(V.PORT_SCAN_LABELS), 1)).alias("n_port_scan"),
    )


@query("fea9")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    numbers = vector_to_array("features")
    return MO.vectors(FE.snapshot(written(history(spark, d), "history"))).select(
        "source", *[F.round(numbers[i], 9).alias(c) for i, c in enumerate(FEATURES)]
    )


@query("fea10")
def _(spark, d):
    return FE.as_of(VD.history(stored_verdicts(spark, d))).select("source", "flow_key", "verdict", *rounded_features())


# --- model ----------------------------------------------------------------------------------


def labelled_features(spark, d) -> DataFrame:
    return FE.snapshot(history(spark, d)).join(T.source_labels(spark, d), "source")


@lru_cache(maxsize=8)
def _models(app_id: str, d: str) -> list:
    """The forest of a table once it is trained."""
    return []


def trained(spark, d, labelled: DataFrame | None = None):
    """`labelled` are the stored features of the table, where the caller has them."""
    made = _models(spark.sparkContext.applicationId, d)
    if not made:
        # the forest passes over its rows several times
        rows = written(labelled_features(spark, d), "training") if labelled is None else labelled
        made.append(MO.train(MO.split(rows)[0]))
    return made[0]


def plain_prediction(history_rows: DataFrame) -> DataFrame:
    """Sources with a prediction that plain SQL can state; null where nothing was closed."""
    closed = F.col("closed_ports")
    return FE.snapshot(history_rows).withColumn(
        "prediction", F.when(closed > 0, closed.cast("double") / 8)
    )


class StatedModel:
    """A scorer that SQL can state, in place of a forest: a quarter for each threshold class."""

    def transform(self, features: DataFrame) -> DataFrame:
        return features.withColumns({"features": F.lit(None), "prediction": F.col("threshold_class") / 4.0})


@query("mod1")
def _(spark, d):
    """Rows per label and whether their mean prediction lies on the label's side of one half."""
    labelled = written(labelled_features(spark, d), "labelled")
    scored = trained(spark, d, labelled).transform(labelled)
    mean = F.avg("prediction")
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.col("label") == 0, mean < 0.5).when(F.col("label") == 1, mean >= 0.5)
        .otherwise((mean > 0) & (mean < 1)).alias("right_side"),
    )


#: What a trained model must keep to on either part; a constant 0.5 has rmse and mae of about 0.45.
MODEL_BOUNDS = {"rmse": 0.35, "mae": 0.25, "r2": 0.3}


@query("mod2")
def _(spark, d):
    labelled = written(labelled_features(spark, d), "labelled")
    train_rows, held_out = MO.split(labelled)
    rows = [
        (name, metric, value >= MODEL_BOUNDS[metric] if metric == "r2" else value <= MODEL_BOUNDS[metric])
        for name, part in (("train", train_rows), ("held_out", held_out))
        for metric, value in MO.evaluate(trained(spark, d, labelled), part).items()
    ]
    return spark.createDataFrame(rows, "part string, metric string, within boolean")


@query("mod3")
def _(spark, d):
    """Place of each label's mean row when they are ordered by prediction."""
    labelled = written(labelled_features(spark, d), "labelled")
    found = MO.smoke_points(trained(spark, d, labelled), labelled)
    return found.select("label", F.row_number().over(W.orderBy("prediction")).alias("place"))  # three rows


@query("mod4")
def _(spark, d):
    rows = plain_prediction(written(history(spark, d), "history")).where("prediction IS NOT NULL")
    return rows.select("source", SC.percentage(F.col("prediction")).alias("score"))


@query("mod5")
def _(spark, d):
    score = SC.score_or_zero(SC.percentage(F.col("prediction")))
    return plain_prediction(written(history(spark, d), "history")).select("source", score.alias("score"))


def plainly_decided(spark, d) -> DataFrame:
    score = SC.score_or_zero(SC.percentage(F.col("prediction")))
    v = stored_verdicts(spark, d)
    scores = plain_prediction(VD.history(v)).select("source", score.alias("score"))
    return MO.decide(FE.onto_verdicts(v, scores))


@query("mod6")
def _(spark, d):
    return plainly_decided(spark, d).select(F.col("remote").alias("source"), "flow_key", "outcome", "chance")


@query("mod7")
def _(spark, d):
    v = F.col("verdict")
    return verdicts(spark, d).groupBy("verdict", SC.promoted(v).alias("alert_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("mod8")
def _(spark, d):
    return verdicts(spark, d).groupBy(
        "verdict", SC.suspicious_attack_type(F.col("verdict")).alias("attack_type")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- alerts ---------------------------------------------------------------------------------


def _shown_alerts(rows: DataFrame) -> DataFrame:
    return rows.select("time", "scan_type", "attack_type", "attacker", joined_text("tools"), "port", "chance", "flow_key")


@query("alr1")
def _(spark, d):
    return _shown_alerts(AL.direct(stored_verdicts(spark, d)))


@query("alr2")
def _(spark, d):
    return _shown_alerts(sure_alerts(stored_verdicts(spark, d)).where(~F.col("attack_type").isin(list(V.DIRECT_ATTACK_TYPE.values()))))


@query("alr2_scored")
def _(spark, d):
    """Alerts of scored verdicts, with a score that SQL can state."""
    return _shown_alerts(AL.scored(plainly_decided(spark, d)))


def _honeypot_alerts(spark, d) -> DataFrame:
    """Straight from flows, without a stored verdict table."""
    return AL.network_scan(VD.network_alerts(flows(spark, d), T.honeypot_sources(spark, d)))


@query("alr3")
def _(spark, d):
    return _shown_alerts(_honeypot_alerts(spark, d))


@query("alr4")
def _(spark, d):
    return flows(spark, d).where(P.is_protocol(V.TCP)).select("flow_key", AL.technique().alias("attack_type"))


@query("alr5")
def _(spark, d):
    typed = flows(spark, d).where(P.is_protocol(V.TCP)).withColumn("attack_type", AL.technique())
    return typed.withColumn("tools", AL.tcp_tools(F.col("attack_type"))).select("flow_key", joined_text("tools"))


@query("alr6")
def _(spark, d):
    rows = flows(spark, d).where(F.col("protocol").isin(V.UDP, V.ICMP)).withColumn("tools", AL.payload_tools())
    return rows.select("flow_key", "l4_key", joined_text("tools"))


@query("alr7")
def _(spark, d):
    rows = AL.direct(stored_verdicts(spark, d)).withColumn("tools", AL.attack_tools(F.col("attack_type")))
    return rows.groupBy("attack_type", joined_text("tools")).agg(F.count(F.lit(1)).alias("n"))


@query("alr8")
def _(spark, d):
    return AL.scanned_ports(history(spark, d)).select(
        "source", joined_text("scan_ports"), joined_text("scan_and_data_ports")
    )


@query("alr9")
def _(spark, d):
    v = stored_verdicts(spark, d)
    return AL.build(sure_alerts(v), VD.history(v)).select(
        "time", "scan_type", "attack_type", "attacker", "description", joined_text("tools"),
        joined_text("scanned_ports"), "chance", "read",
    )


@query("hpt1")
def _(spark, d):
    return AL.seen_by_honeypot(written(history(spark, d), "history"), T.honeypot_sources(spark, d)).select("source", "flow_key", "verdict")


@query("hpt1_networks")
def _(spark, d):
    """History with the closest of the networks (/32, /29 and /24) of recorded addresses."""
    source = F.col("source")
    listed = T.honeypot_sources(spark, d).select(F.explode(F.array(
        source, F.concat(source, F.lit("/29")), F.concat(F.substring_index(source, ".", 3), F.lit(".0/24")),
    )).alias("network"))
    found = AL.seen_in_networks(written(history(spark, d), "history"), listed)
    return found.select("source", "flow_key", "verdict", "network")


@query("hpt2")
def _(spark, d):
    marked = written(history(spark, d), "history")
    found = AL.honeypot_flows(marked, T.honeypot_sources(spark, d), T.packets(spark, d))
    return _shown_alerts(AL.network_scan(found))


# --- reports ---------------------------------------------------------------------------------


def rolled(spark, d, rules: Rules = Rules(), v: DataFrame | None = None) -> DataFrame:
    v = stored_verdicts(spark, d) if v is None else v
    return RP.roll_up(sure_alerts(v), rules, AL.scanned_ports(VD.history(v)))


@query("rpt1")
def _(spark, d):
    return rolled(spark, d).select(
        "time", "scan_type", "attack_type", "attacker", joined_text("tools"), joined_text("scanned_ports"),
        "chance", "read", "n_alerts",
    )


@query("rpt2")
def _(spark, d):
    v = stored_verdicts(spark, d)  # does not depend on the scope
    parts = [
        rolled(spark, d, Rules(merge_scope=scope), v).select(
            "attacker", "scan_type", "attack_type", "n_alerts", F.lit(scope).alias("scope"))
        for scope in ("attacker", "global")
    ]
    return parts[0].unionByName(parts[1])


@query("rpt3")
def _(spark, d):
    alerts = stored_alerts(spark, d)
    asked = T.honeypot_sources(spark, d).distinct().select(
        F.lit("TCP SYN, TCP CONNECT").alias("attack_types"), F.col("source").alias("attacker"),
        F.lit(V.PORT_SCAN).alias("scan_type"),
    )
    return RP.remove_alerts(alerts, asked).select("attacker", "attack_type", "flow_key")


@query("rpt4")
def _(spark, d):
    return RP.remove_by_attack(stored_alerts(spark, d), ONE_SOURCE, "TCP SYN").select("attacker", "attack_type", "flow_key")


@query("rpt5")
def _(spark, d):
    alerts = stored_alerts(spark, d).withColumn("read", F.lit(False))
    return RP.mark_read(alerts, F.col("time") < READ_BEFORE).select("attacker", "flow_key", "read")


@query("rpt6")
def _(spark, d):
    pk = T.packets(spark, d)
    kept = VD.retained(verdicts(spark, d)).select(*FL.KEYS)
    return RP.packet_counts(pk, SE.of_flows(pk, kept, FL.KEYS))


@query("rpt7")
def _(spark, d):
    shown = RP.port_preview(rolled(spark, d))
    return shown.select("attacker", "scan_type", "attack_type", joined_text("first_ports"), "n_ports")


@query("rpt8")
def _(spark, d):
    """Stores a history, clears the store and reads it back."""
    path = scratch_path(spark, "cleared")
    IO.append(history(spark, d), path)
    if spark.read.parquet(path).isEmpty():
        raise ValueError("there was nothing to clear")
    IO.clear(spark, path)
    return spark.read.parquet(path).select("source", "flow_key", "verdict")


@query("rpt9")
def _(spark, d):
    fine = verdicts(spark, d).where(F.col("verdict").isin(V.FINE, V.INIT_FINE))
    return RP.without_flows(T.packets(spark, d), fine, FL.KEYS).select("packet_id")


@query("rpt9_ids")
def _(spark, d):
    pk = T.packets(spark, d)
    return RP.without_ids(pk, pk.where(F.col("protocol") == V.ICMP)).select("packet_id")


@query("closed_port_probers")
def _(spark, d):
    return DE.closed_port_probers(T.packets(spark, d))


# --- streams ----------------------------------------------------------------------------------


def landed(spark, d) -> str:
    """The packet table as files that arrive in order of time.

    A conversation lands in the slice of time that it begins in. Orders are told apart before packets
    are made of them, so these are made and written once. A slice lands in at most FILES files, so
    the number of batches does not grow with the table.
    """
    path = scratch_path(spark, "landing")
    ts = F.timestamp_micros(T.start())
    number = F.when(ts >= F.lit(SLICES[-1]).cast("timestamp"), len(SLICES))
    for i, high in reversed(list(enumerate(SLICES))):
        number = F.when(ts < F.lit(high).cast("timestamp"), i).otherwise(number)
    for i in range(len(SLICES) + 1):
        T.packets(spark, d, number == i).coalesce(FILES).write.mode("append").parquet(path)
    return path


def stream(spark, d) -> DataFrame:
    return ST.packet_stream(spark, landed(spark, d))


def _stored(spark, d, sink):
    """Runs a sink over the landing folder, a file or a few at a time."""
    ST.record(stream(spark, d), sink, scratch_path(spark, "offsets")).awaitTermination()
    return sink


def streamed_flows(spark, d) -> DataFrame:
    return _stored(spark, d, ST.FlowStore(scratch_path(spark, "flow-store"))).flows(spark)


@query("str1")
def _(spark, d):
    return VD.classify(streamed_flows(spark, d)).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_packets").alias("n_packets")
    )


@query("str2")
def _(spark, d):
    return streamed_flows(spark, d).select(*FL.KEYS, "n_packets", "short_path", "first_ts", "last_ts")


@query("str3")
def _(spark, d):
    return streamed_flows(spark, d).groupBy(*FL.KEYS).agg(F.count(F.lit(1)).alias("n_sessions"))


def _recorded(spark, d):
    return _stored(spark, d, ST.Recorder(scratch_path(spark, "recorded"), trained(spark, d)))


@query("str4")
def _(spark, d):
    return _recorded(spark, d).history(spark).select("source", "flow_key", "l4_key", "port", "n_packets", "verdict")


@query("str4_alerts_stated")
def _(spark, d):
    """Alerts of the stream under a scorer that SQL can state."""
    sink = ST.Recorder(scratch_path(spark, "recorded"), StatedModel())
    return _shown_alerts(_stored(spark, d, sink).alerts(spark))


@query("detect_alerts_stated")
def _(spark, d):
    return _shown_alerts(DE.detect(T.packets(spark, d), StatedModel()).alerts)


@query("str2_evicted")
def _(spark, d):
    """Flows and packets that are left in the store after fine flows were evicted."""
    store = _stored(spark, d, ST.FlowStore(scratch_path(spark, "evicted")))
    store.compact(spark)
    left = store.read(spark, "packets").groupBy("flow_key").agg(F.count(F.lit(1)).alias("n_stored"))
    return store.flows(spark).join(left, "flow_key", "left").select(*FL.KEYS, "n_packets", "n_stored")


@query("str4_alerts")
def _(spark, d):
    return _recorded(spark, d).alerts(spark).groupBy("scan_type", "attack_type").agg(F.count(F.lit(1)).alias("n"))


@query("str5")
def _(spark, d):
    sink = ST.HoneypotCorrelator(scratch_path(spark, "correlated"), T.honeypot_sources(spark, d))
    return _shown_alerts(_stored(spark, d, sink).alerts(spark))


@query("detect_alerts")
def _(spark, d):
    """The whole way from packets to rolled-up alerts with a trained model."""
    found = DE.detect(T.packets(spark, d), trained(spark, d))
    return RP.roll_up(found.alerts, Rules(), AL.scanned_ports(found.history)).groupBy(
        "scan_type", "attack_type").agg(F.count(F.lit(1)).alias("n"))
