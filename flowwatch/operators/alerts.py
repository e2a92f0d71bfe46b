"""Alert typing, tool attribution and honeypot alerts.

Alerts are kept without the source's port list until it is needed: the list is
the same for all alerts of a source, so it is joined last (`build`) or not at
all (`reports.roll_up` takes it per source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P
from flowwatch.functions import scores as SC
from flowwatch.operators import flows as FL
from flowwatch.operators import networks, skew
from flowwatch.rules import Rules

_NONE = "array<string>"


def _list(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _lookup(table: dict, key: Column) -> Column:
    items = [c for k, tools in table.items() for c in (F.lit(k), _list(tools))]
    return F.try_element_at(F.create_map(*items), key)


def technique(rules: Rules = Rules()) -> Column:
    """TCP scan technique from adjacent packets."""
    half_open = F.col("syn_half_open") if rules.half_open_syn else F.lit(False)
    return (
        F.when(F.col("syn_reset") | half_open, "TCP SYN")
        .when(F.col("syn_connect"), "TCP CONNECT")
        .otherwise(V.UNKNOWN)
    )


def tcp_tools(attack_type: Column, rules: Rules = Rules()) -> Column:
    """Tools by the first packet's header length, then by its window size."""
    first = F.col("first")

    def number(name):
        return F.coalesce(first[name].try_cast("int"), F.lit(0))

    def resolve(kind):
        own = kind if rules.tools_by_own_table else "TCP SYN"
        by_header = F.coalesce(_lookup(V.TOOLS_BY_HEADER[own], number("header_length")), F.array().cast(_NONE))
        by_window = F.coalesce(_lookup(V.TOOLS_BY_WINDOW[own], number("win")), _list([V.NMAP]))
        both = F.array_sort(F.array_intersect(by_window, by_header))
        if rules.empty_tools_unknown:
            both = F.when(F.size(both) == 0, _list([V.UNKNOWN])).otherwise(both)
        return F.when(F.size(by_header) == 1, by_header).otherwise(both)

    known = first["protocol"] == V.TCP
    return (
        F.when(known & (attack_type == "TCP SYN"), resolve("TCP SYN"))
        .when(known & (attack_type == "TCP CONNECT"), resolve("TCP CONNECT"))
        .otherwise(_list([V.UNKNOWN]))
    )


def payload_tools(rules: Rules = Rules()) -> Column:
    """Tools of UDP and ICMP probes by the first packet's length."""
    first = F.col("first")
    result = F.lit(None).cast(_NONE)
    for protocol in (V.UDP, V.ICMP):
        by_length = F.coalesce(_lookup(V.TOOLS_BY_LENGTH[protocol], first["length"]), _list([V.NMAP]))
        result = F.when(first["protocol"] == protocol, by_length).otherwise(result)
    if rules.ip_arp_tools:
        bare = first["protocol"].isin(V.IPV4, V.IPV6, V.ARP)
        result = F.when(bare, _list([V.NMAP])).otherwise(result)
    return F.coalesce(result, _list([V.UNKNOWN]))


def attack_tools(attack_type: Column) -> Column:
    return F.coalesce(_lookup(V.TOOLS_BY_ATTACK, attack_type), _list([V.UNKNOWN]))


COLUMNS = ["time", "scan_type", "attack_type", "attacker", "tools", "port", "chance", *FL.KEYS]


def raise_alerts(flow_rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Flows with an `outcome` (alert kind) and a `chance` -> alerts, in one projection.

    Attack kinds and port scans need an incoming packet; network scans fall back
    to the other end of the first outgoing one. Kinds without an alert are dropped.
    """
    direct = {
        k: t for k, t in V.DIRECT_ATTACK_TYPE.items()
        if rules.maimon_fin_alerts or k not in (V.MAIMON, V.FIN_SCAN)
    }
    network = {p: t for p, t in V.NETWORK_ATTACK_TYPE.items() if p != V.SCTP or rules.sctp_alerts}
    kind, first, first_in = F.col("outcome"), F.col("first.protocol"), F.col("first_in.protocol")
    is_direct, is_port, is_network = (
        kind.isin(list(direct)), kind == V.PORT_SCAN_ALERT, kind == V.NETWORK_ALERT
    )
    attack_type = (
        F.when(is_direct & first_in.isNotNull(), F.try_element_at(SC.literal_map(direct), kind))
        .when(is_port & (first_in == V.TCP), technique(rules))
        .when(is_port & (first_in == V.UDP), "UDP")
        .when(is_network & (first == V.TCP), technique(rules))
        .when(is_network, F.try_element_at(SC.literal_map(network), first))
    )
    typed = flow_rows.withColumn("attack_type", attack_type).where(F.col("attack_type").isNotNull())
    tools = (
        F.when(is_direct, attack_tools(F.col("attack_type")))
        .when(F.col("attack_type").isin("TCP SYN", "TCP CONNECT", V.UNKNOWN), tcp_tools(F.col("attack_type"), rules))
        .otherwise(payload_tools(rules))
    )
    return typed.select(
        F.col("last_ts").alias("time"),
        F.when(is_network, V.NETWORK_SCAN).otherwise(V.PORT_SCAN).alias("scan_type"),
        "attack_type",
        F.col("remote").alias("attacker"),
        tools.alias("tools"),
        F.when(is_network & first.isin(V.INTERNET_PROTOCOLS), V.NO_PORT).otherwise(F.col("host_port")).alias("port"),
        F.when(is_port, F.col("chance").cast("double")).otherwise(100.0).alias("chance"),
        *FL.KEYS,
    )


def direct(verdict_rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alerts of verdicts that are alerts by themselves."""
    at_once = verdict_rows.where(F.col("verdict").isin([*V.DIRECT_ATTACKS, V.NETWORK_ALERT]))
    return raise_alerts(at_once.withColumns({"outcome": F.col("verdict"), "chance": F.lit(100)}), rules)


def scored(decided: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alerts of verdict rows that the model has decided on (`outcome`, `chance`)."""
    return raise_alerts(decided.where(F.col("outcome") != V.CONTINUE), rules)


def port_scan(flow_rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Port-scan alerts of flows with a `chance`; only TCP and UDP have one."""
    return raise_alerts(flow_rows.withColumn("outcome", F.lit(V.PORT_SCAN_ALERT)), rules)


def network_scan(flow_rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Network-scan alerts by the protocol of the flow's first packet."""
    return raise_alerts(
        flow_rows.withColumns({"outcome": F.lit(V.NETWORK_ALERT), "chance": F.lit(100)}), rules
    )


# --- ports of a source --------------------------------------------------------------


def source_port_rows(history: DataFrame) -> DataFrame:
    """Distinct ports per source that an alert lists; `data_only` ports are for UDP alerts."""
    labelled = history.where(
        (F.col("port") != V.NO_PORT) & F.col("verdict").isin([*V.PORT_SCAN_LABELS, V.SEND_DATA])
    )
    return labelled.groupBy("source", "port").agg(
        (F.max(F.col("verdict").isin(V.PORT_SCAN_LABELS)) == F.lit(False)).alias("data_only")
    )


def scanned_ports(history: DataFrame) -> DataFrame:
    """Sorted port lists per source: at most 65 536 entries."""
    return source_port_rows(history).groupBy("source").agg(
        F.array_sort(F.collect_list(F.when(~F.col("data_only"), F.col("port")))).alias("scan_ports"),
        F.array_sort(F.collect_list("port")).alias("scan_and_data_ports"),
    )


def build(alert_rows: DataFrame, history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Complete alerts, with the port list of their source."""
    ports = scanned_ports(history).withColumnRenamed("source", "attacker")
    joined = skew.lookup(alert_rows, ports, ["attacker"], how="left")
    listed = F.when(F.col("attack_type") == "UDP", F.col("scan_and_data_ports")).otherwise(F.col("scan_ports"))
    listed = F.coalesce(listed, F.array().cast("array<int>"))
    own = F.array(F.col("port"))
    if rules.clean_ports:
        every = F.array_sort(F.array_remove(F.array_union(own, listed), V.NO_PORT))
    else:
        every = F.concat(own, listed)
    return joined.select(
        "time", "scan_type", "attack_type", "attacker", F.lit("").alias("description"), "tools",
        every.alias("scanned_ports"), "chance", F.lit(False).alias("read"),
    )


# --- honeypot correlation --------------------------------------------------------------


def seen_by_honeypot(history: DataFrame, honeypot: DataFrame) -> DataFrame:
    """History rows whose source the honeypot has recorded."""
    listed = honeypot.select("source").distinct()
    return skew.lookup(history, listed, ["source"], how="left_semi")


def seen_in_networks(history: DataFrame, listed: DataFrame, column: str = "network") -> DataFrame:
    """History rows whose source lies in a listed network, with the closest one as `network`."""
    found = networks.longest_match(history, "source", listed, column).withColumnRenamed("address", "source")
    return skew.lookup(history.drop("network"), found, ["source"])


def honeypot_flows(history: DataFrame, honeypot: DataFrame, packets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Flows of suspicious network scans whose source is in the honeypot's log."""
    marked = seen_by_honeypot(history.where(F.col("verdict") == V.SUSPICIOUS_NETWORK), honeypot)
    wanted = marked.select(*FL.KEYS).distinct()
    stored = skew.lookup(packets, wanted, FL.KEYS, how="left_semi")
    rows = P.with_tcp_fields(stored).withColumn("rekeyed", F.lit(False))
    return FL.finish(FL.facts(rows))
