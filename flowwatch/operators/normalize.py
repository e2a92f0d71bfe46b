"""Decoded packet rows with layer names -> the flat packet schema.

Input columns: packet_id, timestamp, layers, header_count, ip4/ip6 addresses,
arp_sender/arp_target, l4 ports, tcp_flags, seq, ack, win, win_scale,
checksum_correct, header_length, icmp_type, icmp_code_name, icmp_code,
sctp_chunks, payload_length, packet_length, sctp_data_header_length, flow_key.
Everything is one narrow projection and one filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P

ECHO_REQUEST = "ECHO_REQUEST"
RECORDED_CHUNKS = [*V.SCTP_CHUNKS, "SHUTDOWN"]


def _layer(name: str) -> Column:
    return F.array_contains("layers", name)


def _strings() -> Column:
    return F.array().cast("array<string>")


def layer_protocol() -> Column:
    """Protocol by layer precedence; null when none is present."""
    result = None
    for name in (V.ICMP, V.TCP, V.UDP, V.SCTP, V.ARP):
        result = F.when(_layer(name), name) if result is None else result.when(_layer(name), name)
    return result


def bare_protocol() -> Column:
    return F.when(_layer(V.IPV4), V.IPV4).when(_layer(V.IPV6), V.IPV6)


def sctp_chunk(record_shutdown: bool = True) -> Column:
    """First known chunk type present; SHUTDOWN only counts when asked for."""
    names = RECORDED_CHUNKS if record_shutdown else V.SCTP_CHUNKS
    return F.coalesce(*[F.when(F.array_contains("sctp_chunks", c), c) for c in names])


def addresses(arp: Column) -> tuple[Column, Column]:
    source = F.when(arp, F.col("arp_sender")).otherwise(F.coalesce("ip4_source", "ip6_source"))
    target = F.when(arp, F.col("arp_target")).otherwise(F.coalesce("ip4_destination", "ip6_destination"))
    return F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))


def direction(source: Column, hosts: list[str]) -> Column:
    return F.when(source.isin(hosts), V.OUTCOME).otherwise(V.INCOME)


def normalize(decoded: DataFrame, hosts: list[str], record_shutdown: bool = True) -> DataFrame:
    """Flat packets; rows that no protocol rule keeps are dropped."""
    by_layer = layer_protocol()
    source, target = addresses(F.coalesce(by_layer == V.ARP, F.lit(False)))
    d = decoded.withColumns({
        "_layer": by_layer, "source_address": source, "destination_address": target,
    })
    from_outside = ~F.col("source_address").isin(hosts)
    not_multicast = ~F.col("destination_address").isin(V.MULTICAST)
    known_icmp = F.col("icmp_type").isin(ECHO_REQUEST, V.UNREACHABLE)
    chunk = sctp_chunk(record_shutdown)
    kept = (
        F.when(F.col("_layer") == V.ICMP, F.coalesce(known_icmp, F.lit(False)))
        .when(F.col("_layer").isin(V.TCP, V.ARP), True)
        .when(F.col("_layer") == V.UDP, from_outside & not_multicast)
        .when(F.col("_layer") == V.SCTP, chunk.isNotNull())
        .otherwise(False)
    )
    # what its own rule does not keep may still pass as a bare IP packet
    bare = bare_protocol().isNotNull() & not_multicast & from_outside & (F.col("header_count") == 2)
    d = d.withColumn("protocol", F.when(kept, F.col("_layer")).when(bare, bare_protocol()))
    d = d.where(F.col("protocol").isNotNull()).withColumn("direction", direction(F.col("source_address"), hosts))

    protocol = F.col("protocol")
    ported = protocol.isin(V.TRANSPORT_PROTOCOLS)
    source_port = F.when(ported, F.col("l4_source_port")).otherwise(V.NO_PORT)
    target_port = F.when(ported, F.col("l4_destination_port")).otherwise(V.NO_PORT)
    info = F.create_map(*[
        c for key in V.TCP_INFO_KEYS for c in (F.lit(key), F.col(key.lower()).cast("string"))
    ])
    unreachable = F.array(
        F.lit(V.UNREACHABLE), F.coalesce("icmp_code_name", F.lit("")), F.col("icmp_code").cast("string")
    )
    flags = (
        F.when(protocol == V.TCP, F.col("tcp_flags"))
        .when((protocol == V.ICMP) & (F.col("icmp_type") == V.UNREACHABLE), unreachable)
        .when(protocol == V.SCTP, F.array(chunk))
        .otherwise(_strings())
    )
    length = (
        F.when(protocol.isin(V.TCP, V.UDP, V.ICMP), F.col("payload_length"))
        .when((protocol == V.SCTP) & chunk.isin("DATA", "COOKIE"), F.col("sctp_data_header_length"))
        .otherwise(F.col("packet_length"))
    )
    return d.select(
        "packet_id", "timestamp", "protocol", "source_address", source_port.cast("int").alias("source_port"),
        "destination_address", target_port.cast("int").alias("destination_port"),
        F.when(protocol == V.TCP, info).otherwise(F.create_map().cast("map<string,string>")).alias("info"),
        flags.alias("flags"),
        "flow_key",
        F.when(protocol == V.ICMP, V.ICMP_L4_KEY)
        .when(ported, P.l4_key(source_port, target_port, F.col("direction")))
        .otherwise(V.NO_L4_KEY).alias("l4_key"),
        P.pair_key(F.col("source_address"), F.col("destination_address"), F.col("direction")).alias("pair_key"),
        "direction",
        length.cast("int").alias("length"),
    )
