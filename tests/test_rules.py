"""Golden cases on literal packets."""

import pytest
from pyspark.sql import functions as F

from flowwatch import Rules
from flowwatch.functions import packet as P
from flowwatch.functions import patterns as S
from flowwatch.functions import scores as SC
from flowwatch.operators import alerts as AL
from flowwatch.operators import flows as FL
from flowwatch.operators import verdicts as VD
from rows import flow, packet, table

CONNECT = [">SYN", "<SYN,ACK", ">ACK", ">RST,ACK"]


def holds(spark, rule, *packets, protocol="TCP"):
    rows = FL.assemble(table(spark, flow(1, *packets, protocol=protocol)), hot="none")
    return rows.select(rule.alias("r")).first()["r"]


def verdict(spark, *packets, protocol="TCP", rules=Rules()):
    rows = FL.assemble(table(spark, flow(1, *packets, protocol=protocol)), rules, hot="none")
    return VD.classify(rows, rules).first()["verdict"]


def test_host_initiated(spark):
    assert not holds(spark, S.host_initiated(), ">SYN", "<SYN,ACK")
    assert holds(spark, S.host_initiated(), "<SYN", ">SYN,ACK")
    assert not holds(spark, S.host_initiated(), ">ACK", "<RST,ACK")
    assert not holds(spark, S.host_initiated(), ">INIT", protocol="SCTP")
    assert holds(spark, S.host_initiated(), "<INIT", protocol="SCTP")


def test_closed(spark):
    assert holds(spark, S.closed(), *CONNECT)
    assert holds(spark, S.properly_closed(), *CONNECT[:3], ">FIN,ACK", "<FIN,ACK", "<ACK", ">RST")
    assert not holds(spark, S.properly_closed(), *CONNECT[:3], ">FIN,ACK")
    shutdown = [">INIT", "<INIT_ACK", ">SHUTDOWN"]
    assert holds(spark, S.closed(), *shutdown, protocol="SCTP")
    assert not holds(spark, S.closed(Rules.reference()), *shutdown, protocol="SCTP")


def test_data_and_closed_port(spark):
    assert not holds(spark, S.data_sent(), *CONNECT)
    assert holds(spark, S.data_sent(), *CONNECT[:3], (">PSH,ACK", {"length": 9}))
    assert not holds(spark, S.data_sent(), *CONNECT[:2], (">ACK", {"length": 9}), ">RST,ACK")
    assert holds(spark, S.port_closed(), ">SYN", "<RST,ACK")
    assert not holds(spark, S.port_closed(), ">PSH,ACK,URG", "<RST")
    assert holds(spark, S.port_closed(), ">ACK", ">SYN", "<RST")
    assert holds(spark, S.connect_four_packets(), *CONNECT)


def test_several_chunks_in_one_packet(spark):
    both = holds(spark, S.data_sent(), ">INIT,DATA", "<ABORT", protocol="SCTP")
    assert both and holds(spark, S.port_closed(), ">INIT,DATA", "<ABORT", protocol="SCTP")


def test_suspicious_variants(spark):
    assert verdict(spark, (">FIN,ACK", {"SEQ": 0}), ("<RST", {"CHECKSUM_CORRECT": "true"})) == "SuspiciousMaimonScanAttack"
    reply = ("<RST,ACK", {"ACK": 2, "WIN": 0, "CHECKSUM_CORRECT": "false"})
    assert verdict(spark, (">FIN", {"WIN": 512}), reply) == "SuspiciousFinScanAttack"
    assert verdict(spark, ">FIN", reply) == "FinScanAttack"
    # the literal rule compares with "11" and looks at the reply only
    literal = ("<RST,ACK", {"ACK": 11, "WIN": 0, "CHECKSUM_CORRECT": "false"})
    assert holds(spark, S.fin_scan(Rules.reference()), ">FIN", literal)
    assert not holds(spark, S.fin_scan(), ">FIN", literal)


def test_ack_win_flow_length(spark):
    long = [(">ACK", {"SEQ": 0}), "<ACK", "<RST"]
    assert verdict(spark, *long) != "AckWinScanAttack"
    assert verdict(spark, *long, rules=Rules.reference()) == "AckWinScanAttack"


def test_missing_info_reads_as_false(spark):
    rows = [(*r[:7], {}, *r[8:]) for r in flow(1, ">FIN,PSH,URG", "<RST,ACK")]
    found = VD.classify(FL.assemble(table(spark, rows), hot="none")).first()
    assert found["verdict"] == "DidNotSendData"


@pytest.mark.parametrize("closed, score", [(5, 0), (6, 0), (7, 0.0584962501), (8, 0.1), (10, 0.1584962501), (20, 0.3)])
def test_closed_port_score(spark, closed, score):
    row = spark.range(1).select(SC.closed_port_score(5, F.lit(closed)).alias("s"),
                                SC.closed_port_score(11, F.lit(20)).alias("t")).first()
    assert row["s"] == pytest.approx(score) and row["t"] == pytest.approx(0.2321928094)


def test_texts(spark):
    row = spark.range(1).select(
        P.flag_text(F.array(F.lit("SYN"), F.lit("ACK"))).alias("a"),
        P.readable_address(F.lit("[INET4:192.168.1.4]")).alias("b"),
        P.l4_key(F.lit(41000), F.lit(80), F.lit("INCOME")).alias("c"),
        P.l4_key(F.lit(80), F.lit(41000), F.lit("OUTCOME")).alias("d"),
    ).first()
    assert (row["a"], row["b"]) == ("SYNACK", "192.168.1.4") and row["c"] == row["d"] == "4100000080"


@pytest.mark.parametrize("header, window, tools", [
    (24, 1024, ["NMAP"]), (20, 1024, ["MASSCAN"]), (20, 65535, ["ZMAP"]), (20, 7, ["UNKNOWN"])])
def test_tcp_tools(spark, header, window, tools):
    rows = FL.assemble(table(spark, flow(1, (">SYN", {"HEADER_LENGTH": header, "WIN": window}), "<RST")), hot="none")
    assert rows.select(AL.tcp_tools(AL.technique()).alias("t")).first()["t"] == tools


@pytest.mark.parametrize("length, tools", [(8, ["Angry IP Scanner"]), (29, ["ZMAP"]), (0, ["NMAP"]), (500, ["NMAP"])])
def test_udp_tools(spark, length, tools):
    rows = FL.assemble(table(spark, flow(1, (">", {"length": length}), protocol="UDP")), hot="none")
    assert rows.select(AL.payload_tools().alias("t")).first()["t"] == tools


def test_literal_tools_of_unlisted_window(spark):
    rows = FL.assemble(table(spark, flow(1, (">SYN", {"WIN": 7}), "<RST")), hot="none")
    assert rows.select(AL.tcp_tools(AL.technique(), Rules.reference()).alias("t")).first()["t"] == []


def test_quiet_period(spark):
    probe = flow(1, (">ACK", {"SEQ": 7}), "<RST")
    v = VD.classify(FL.assemble(table(spark, probe), hot="none"))
    last = probe[-1][1]
    soon, late = packet(5000, 1, ">ACK", ts=last + 900_000), packet(5000, 1, ">ACK", ts=last + 1_100_000)
    outcome = lambda more, rules=Rules(): VD.quiet_period(v, table(spark, more), rules).first()["verdict"]
    assert outcome(probe + [soon]) == "ContinueIteration"
    assert outcome(probe + [late]) == outcome(probe) == "SuspiciousAckWinScanAttack"
    assert outcome(probe, Rules(quiet_counts_later_only=False)) == "ContinueIteration"


def test_icmp_belongs_to_the_udp_flow(spark):
    rows = [packet(1, 1, ">", "UDP"), packet(2, 1, "<DESTINATION_UNREACHABLE,PORT_UNREACHABLE,3", "ICMP", length=28)]
    found = {r["l4_key"]: r["verdict"] for r in VD.classify(FL.assemble(table(spark, rows), hot="none")).collect()}
    assert found == {"4100000080": "PortClosed", "ICMP": "ContinueIteration"}
    both = Rules(icmp_pulls_udp=True)
    found = {r["l4_key"]: r["verdict"] for r in VD.classify(FL.assemble(table(spark, rows), both, hot="none"), both).collect()}
    assert found["ICMP"] == "SuspiciousNetworkScan"
