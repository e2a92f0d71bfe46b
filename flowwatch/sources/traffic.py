"""Packet tables derived from the `orders` table.

One order is one conversation; its packets follow a script picked by customer
and order key. Only arithmetic, one join with a small constant table and string
functions are used, so any SQL engine can derive the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import packet as P
from flowwatch.session import compiled

HOST = "192.168.1.4"
ROWS = 60_000  # orders of a part

# (script, protocol, direction, flags, changed fields); fields not named are
# length 0, seq 1, ack 0, win 1024, header 20, checksum true, dt 200.
SCRIPTS = [
    (0, "TCP", ">", "SYN", {}), (0, "TCP", "<", "SYN,ACK", {}), (0, "TCP", ">", "ACK", {}),
    (0, "TCP", ">", "PSH,ACK", {"length": 120}), (0, "TCP", "<", "ACK", {}),
    (0, "TCP", ">", "FIN,ACK", {}), (0, "TCP", "<", "FIN,ACK", {}),
    (1, "TCP", ">", "SYN", {"header": 24}), (1, "TCP", "<", "RST,ACK", {"win": 0, "ack": 2}),
    (2, "TCP", ">", "SYN", {}), (2, "TCP", "<", "SYN,ACK", {}), (2, "TCP", ">", "ACK", {}),
    (2, "TCP", ">", "RST,ACK", {}),
    (3, "TCP", ">", "SYN", {"win": 65535}), (3, "TCP", "<", "SYN,ACK", {}), (3, "TCP", ">", "RST", {}),
    (4, "TCP", ">", "", {}), (4, "TCP", "<", "RST,ACK", {"win": 0}),
    (5, "TCP", ">", "FIN,PSH,URG", {"seq": 1}), (5, "TCP", "<", "RST,ACK", {"win": 0, "ack": 2}),
    (6, "TCP", ">", "ACK", {"seq": 0}), (6, "TCP", "<", "RST", {"dt": 500}),
    (7, "TCP", ">", "ACK", {"seq": 77}), (7, "TCP", "<", "RST", {"dt": 500}),
    (8, "TCP", ">", "FIN,ACK", {"seq": 0}), (8, "TCP", "<", "RST", {"checksum": "false", "dt": 500}),
    (9, "TCP", ">", "FIN", {"seq": 1}),
    (9, "TCP", "<", "RST,ACK", {"seq": 1, "ack": 2, "win": 0, "checksum": "false"}),
    (10, "TCP", "<", "SYN", {}), (10, "TCP", ">", "SYN,ACK", {}), (10, "TCP", "<", "ACK", {}),
    (10, "TCP", "<", "PSH,ACK", {"length": 300}),
    (11, "TCP", "<", "SYN", {}), (11, "TCP", ">", "SYN,ACK", {}),
    (12, "TCP", "<", "SYN", {}), (12, "TCP", ">", "SYN,ACK", {}), (12, "TCP", "<", "ACK", {}),
    (12, "TCP", "<", "PSH,ACK", {"length": 200}), (12, "TCP", ">", "ACK", {}),
    (12, "TCP", "<", "RST,ACK", {}),
    (13, "UDP", ">", "", {}),
    (13, "ICMP", "<", "DESTINATION_UNREACHABLE,PORT_UNREACHABLE,3", {"length": 28}),
    (14, "UDP", ">", "", {"length": 29}),
    (15, "UDP", ">", "", {}),
    (16, "ICMP", ">", "", {"length": 56}),
    (17, "ARP", ">", "", {"length": 60}),
    (18, "SCTP", ">", "INIT", {"length": 62}), (18, "SCTP", "<", "ABORT", {"length": 50}),
    (19, "SCTP", ">", "INIT", {"length": 62}), (19, "SCTP", "<", "INIT_ACK", {"length": 62}),
    (19, "SCTP", ">", "DATA", {"length": 90}),
    (20, "TCP", ">", "SYN", {"header": 32, "win": 32}),
    (21, "IPv4", ">", "", {"length": 40}),
]


def script_values() -> str:
    """The script table as an SQL VALUES list."""
    rows, position = [], {}
    for script, protocol, way, flags, changed in SCRIPTS:
        pos = position[script] = position.get(script, -1) + 1
        f = {"length": 0, "seq": 1, "ack": 0, "win": 1024, "header": 20, "checksum": "true", "dt": 200}
        f.update(changed)
        direction = V.INCOME if way == ">" else V.OUTCOME
        rows.append(
            f"({script}, {pos}, '{protocol}', '{direction}', '{flags}', {f['length']}, '{f['seq']}', "
            f"'{f['ack']}', '{f['win']}', '{f['header']}', '{f['checksum']}', {f['dt']})"
        )
    columns = "script, pos, protocol, direction, flag_list, length, seq, ack, win, header, checksum, dt"
    return f"(VALUES {', '.join(rows)}) AS s({columns})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dealt(orders: DataFrame) -> DataFrame:
    """Orders in parts of even size: a row becomes several packets, and a file with few row groups
    would make all of them in as few tasks."""
    return orders.repartition(orders.count() // ROWS + 1, *orders.columns)


def script_number(custkey: Column, orderkey: Column) -> Column:
    digit = orderkey % 10
    scanner = (
        F.when(digit <= 5, 1).when(digit == 6, 2).when(digit == 7, 3).when(digit == 8, 13).otherwise(15)
    )
    normal = F.element_at(F.array(*[F.lit(n) for n in (0, 10, 12, 14)]), (orderkey % 4 + 1).cast("int"))
    return (
        F.when(custkey % 5 == 0, scanner)
        .when(custkey % 5 == 1, (orderkey % 22).cast("int"))
        .otherwise(normal)
    )


def remote_address(custkey: Column) -> Column:
    return F.concat(
        F.lit("10.0."), F.floor(custkey / 250).cast("string"), F.lit("."), (custkey % 250).cast("string")
    )


def start() -> Column:
    """When an order's first packet is sent."""
    return F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1000000


def conversations(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """One row per order (those of a condition on orders, if given): endpoints, script and start time."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    port_of = F.element_at(F.array(F.lit(22), F.lit(80), F.lit(443)), (key % 3 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dealt(orders if where is None else orders.where(where)).select(
        key.alias("flow_key"),
        script_number(cust, key).alias("script"),
        remote_address(cust).alias("remote"),
        F.when(cust % 5 <= 1, (20 + key % 24).cast("int")).otherwise(port_of).alias("host_port"),
        (40000 + key % 20000).cast("int").alias("remote_port"),
        start().alias("start"),
    )


def packets(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """All packets of all conversations (of the orders of a condition, if given), in the PACKET schema."""
    script_rows = spark.sql(f"SELECT * FROM {script_values()}")  # constant table, under 60 rows
    d = conversations(spark, sf_dir, where).join(F.broadcast(script_rows), "script")
    incoming = F.col("direction") == V.INCOME
    has_ports = F.col("protocol").isin(V.TRANSPORT_PROTOCOLS)
    remote_port = F.when(has_ports, F.col("remote_port")).otherwise(V.NO_PORT)
    host_port = F.when(has_ports, F.col("host_port")).otherwise(V.NO_PORT)
    source_port = F.when(incoming, remote_port).otherwise(host_port)
    destination_port = F.when(incoming, host_port).otherwise(remote_port)
    no_info = F.create_map().cast("map<string,string>")
    info = F.create_map(
        F.lit("SEQ"), F.col("seq"), F.lit("ACK"), F.col("ack"), F.lit("WIN"), F.col("win"),
        F.lit("HEADER_LENGTH"), F.col("header"), F.lit("CHECKSUM_CORRECT"), F.col("checksum"),
    )
    return d.select(
        (F.col("flow_key") * 16 + F.col("pos")).alias("packet_id"),
        (F.col("start") + F.col("pos") * F.col("dt")).alias("timestamp"),
        "protocol",
        F.when(incoming, F.col("remote")).otherwise(HOST).alias("source_address"),
        source_port.alias("source_port"),
        F.when(incoming, F.lit(HOST)).otherwise(F.col("remote")).alias("destination_address"),
        destination_port.alias("destination_port"),
        F.when(F.col("protocol") == V.TCP, info).otherwise(no_info).alias("info"),
        F.when(F.col("flag_list") == "", F.array().cast("array<string>"))
        .otherwise(F.split("flag_list", ",")).alias("flags"),
        "flow_key",
        F.when(F.col("protocol") == V.ICMP, V.ICMP_L4_KEY)
        .when(has_ports, P.l4_key(source_port, destination_port, F.col("direction")))
        .otherwise(V.NO_L4_KEY).alias("l4_key"),
        F.concat_ws("~", F.col("remote"), F.lit(HOST)).alias("pair_key"),
        "direction",
        "length",
    )


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training label per remote: 1.0 scanner, 0.5 mixed, 0.0 normal."""
    kind = F.col("o_custkey") % 5
    return (
        table(spark, sf_dir, "orders")
        .select(
            remote_address(F.col("o_custkey")).alias("source"),
            F.when(kind == 0, 1.0).when(kind == 1, 0.5).otherwise(0.0).alias("label"),
        )
        .distinct()
    )


def honeypot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses another sensor has recorded (repeated, as its log would be)."""
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_custkey") % 50 <= 1)
        .select(remote_address(F.col("o_custkey")).alias("source"))
    )


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded rows before normalisation: layer names and raw header fields.

    Every packet appears once as it is; each conversation's first packet also
    appears once sent to a multicast group and once sent by the host itself.
    """
    base = packets(spark, sf_dir)
    first = base.where(F.col("packet_id") % 16 == 0)
    variants = base.withColumn("variant", F.lit(0)).unionByName(
        first.withColumn("variant", F.lit(1))
        .withColumn("source_address", F.col("pair_key").substr(F.lit(1), F.instr("pair_key", "~") - 1))
        .withColumn("destination_address", F.lit("224.0.0.251"))
    ).unionByName(
        first.withColumn("variant", F.lit(2)).withColumn("source_address", F.lit(HOST))
        .withColumn("destination_address", F.col("pair_key").substr(F.lit(1), F.instr("pair_key", "~") - 1))
    )
    proto = F.col("protocol")
    is_arp, is_icmp = proto == V.ARP, proto == V.ICMP
    info = lambda key: F.try_element_at("info", F.lit(key))
    return variants.select(
        (F.col("packet_id") * 4 + F.col("variant")).alias("packet_id"),
        "timestamp",
        F.when(is_arp, F.array(F.lit("ARP")))
        .when(proto == V.IPV4, F.array(F.lit("IPv4")))
        .otherwise(F.array(proto, F.lit("IPv4"))).alias("layers"),
        F.lit(2).alias("header_count"),
        F.when(~is_arp, F.col("source_address")).alias("ip4_source"),
        F.when(~is_arp, F.col("destination_address")).alias("ip4_destination"),
        F.lit(None).cast("string").alias("ip6_source"),
        F.lit(None).cast("string").alias("ip6_destination"),
        F.when(is_arp, F.col("source_address")).alias("arp_sender"),
        F.when(is_arp, F.col("destination_address")).alias("arp_target"),
        F.col("source_port").alias("l4_source_port"),
        F.col("destination_port").alias("l4_destination_port"),
        F.when(proto == V.TCP, F.col("flags")).otherwise(F.array().cast("array<string>")).alias("tcp_flags"),
        info("SEQ").alias("seq"),
        info("ACK").alias("ack"),
        info("WIN").alias("win"),
        F.when(proto == V.TCP, F.lit("1")).alias("win_scale"),
        info("CHECKSUM_CORRECT").alias("checksum_correct"),
        info("HEADER_LENGTH").alias("header_length"),
        F.when(is_icmp & (F.size("flags") == 0), "ECHO_REQUEST")
        .when(is_icmp, F.try_element_at("flags", F.lit(1))).alias("icmp_type"),
        F.when(is_icmp, F.try_element_at("flags", F.lit(2))).alias("icmp_code_name"),
        F.when(is_icmp, F.try_element_at("flags", F.lit(3)).cast("int")).alias("icmp_code"),
        F.when(proto == V.SCTP, F.col("flags")).otherwise(F.array().cast("array<string>")).alias("sctp_chunks"),
        F.col("length").alias("payload_length"),
        (F.col("length") + 34).alias("packet_length"),
        F.lit(16).alias("sctp_data_header_length"),
        "flow_key",
    )
