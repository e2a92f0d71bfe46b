"""Predicates and text functions on one packet.

Every predicate takes `p`: None for the columns of the current row, or a struct
column that holds the same fields (the first or last packet of a flow).
Missing fields read as false.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V


def field(p: Column | None, name: str) -> Column:
    return F.col(name) if p is None else p[name]


def yes(condition: Column) -> Column:
    """Null-safe truth."""
    return F.coalesce(condition, F.lit(False))


def _flags_are(p, *names: str) -> Column:
    """The flags are exactly these, in this order."""
    return yes(field(p, "flags") == F.array(*[F.lit(n) for n in names]))


def _flags_set(p, *names: str) -> Column:
    """The flags are exactly these, in any order."""
    flags = field(p, "flags")
    test = F.size(flags) == len(names)
    for name in names:
        test = test & F.array_contains(flags, name)
    return yes(test)


def _has_flag(p, name: str) -> Column:
    return yes(F.array_contains(field(p, "flags"), name))


def _flag_at(p, position: int) -> Column:
    return F.try_element_at(field(p, "flags"), F.lit(position))


def only_ack(p=None):
    return _flags_are(p, "ACK")


def only_rst(p=None):
    return _flags_are(p, "RST")


def is_protocol(name: str, p=None):
    return yes(field(p, "protocol") == name)


def is_incoming(p=None):
    return yes(field(p, "direction") == V.INCOME)


def is_outgoing(p=None):
    return yes(field(p, "direction") == V.OUTCOME)


def only_fin_ack(p=None):
    return _flags_set(p, "FIN", "ACK")


def contains_syn(p=None):
    return _has_flag(p, "SYN")


def contains_ack(p=None):
    return _has_flag(p, "ACK")


def only_syn(p=None):
    return _flags_are(p, "SYN")


def only_fin(p=None):
    return _flags_are(p, "FIN")


def contains_init(p=None):
    return is_protocol(V.SCTP, p) & _has_flag(p, "INIT")


def syn_ack(p=None):
    return _flags_are(p, "SYN", "ACK")


def rst_ack(p=None):
    return _flags_are(p, "RST", "ACK")


def fin_ack_ordered(p=None):
    return _flags_are(p, "FIN", "ACK")


def any_reset(p=None):
    """RST alone, or RST with ACK in any order."""
    return only_rst(p) | _flags_set(p, "RST", "ACK")


def reset_reply(p=None):
    """RST alone, or RST,ACK in this order."""
    return only_rst(p) | rst_ack(p)


def abort_first(p=None):
    return is_protocol(V.SCTP, p) & yes(_flag_at(p, 1) == "ABORT")


def port_unreachable(p=None):
    return yes(_flag_at(p, 1) == V.UNREACHABLE) & yes(_flag_at(p, 3) == "3")


def only_psh_ack(p=None):
    return _flags_set(p, "PSH", "ACK")


def checksum_ok(p=None):
    return is_protocol(V.TCP, p) & yes(field(p, "checksum_correct") == "true")


def checksum_bad(p=None):
    return ~checksum_ok(p)


def only_fin_psh_urg(p=None):
    return _flags_set(p, "FIN", "PSH", "URG")


def data_chunk(p=None):
    return is_protocol(V.SCTP, p) & _has_flag(p, "DATA")


def shutdown_chunk(p=None):
    return is_protocol(V.SCTP, p) & _has_flag(p, "SHUTDOWN")


def no_flags(p=None):
    return yes(F.size(field(p, "flags")) == 0)


def in_internet_layer(protocol: Column) -> Column:
    return yes(protocol.isin(V.INTERNET_PROTOCOLS))


def in_connection_set(protocol: Column) -> Column:
    return yes(protocol.isin(V.CONNECTION_PROTOCOLS))


def in_transport_set(protocol: Column) -> Column:
    return yes(protocol.isin(V.TRANSPORT_PROTOCOLS))


def with_tcp_fields(packets: DataFrame) -> DataFrame:
    """Typed companions of the `info` keys the detection rules read."""
    info = {
        name.lower(): F.try_element_at("info", F.lit(name)) for name in V.TCP_INFO_KEYS
    }
    return packets.withColumns({name: c for name, c in info.items() if name not in packets.columns})


# letter of a TCP packet's flags, as the sequence rules tell them apart
FLAG_LETTERS = {
    "": "N", "SYN": "S", "SYN,ACK": "C", "ACK": "A", "RST": "R", "RST,ACK": "K", "ACK,RST": "T",
    "FIN": "F", "FIN,ACK": "M", "ACK,FIN": "V", "PSH,ACK": "P", "ACK,PSH": "P",
    **{",".join(order): "Z" for order in permutations(("FIN", "PSH", "URG"))},
}


def with_kind(packets: DataFrame) -> DataFrame:
    """Adds `kind`, a letter for what the sequence rules need to know of a packet.

    Upper case is incoming, lower case outgoing.
    U W  UDP without and with payload
    I H  ICMP without and with payload; Q G the same for port unreachable
    J B O L  SCTP with INIT, ABORT first, DATA, SHUTDOWN; several chunks give several letters
    A E  ACK without and with payload; P D the same for PSH,ACK
    N  no flags    S C R K T F M V Z  the flag sets of FLAG_LETTERS    X  any other
    """
    loaded = yes(F.col("length") > 0)

    def with_payload(empty, full):
        return F.when(loaded, full).otherwise(empty)

    known = F.create_map(*[F.lit(x) for pair in FLAG_LETTERS.items() for x in pair])
    flagged = F.col("_flagged")  # a column of its own, so that the lookup runs once per packet
    by_flags = F.when(loaded & flagged.isin("A", "P"), F.translate(flagged, "AP", "ED")).otherwise(flagged)
    chunks = F.concat(*[
        F.when(test(), letter).otherwise("")
        for test, letter in ((contains_init, "J"), (abort_first, "B"), (data_chunk, "O"), (shutdown_chunk, "L"))
    ])
    protocol = F.col("protocol")
    letter = (
        F.when(protocol == V.UDP, with_payload("U", "W"))
        .when(protocol == V.ICMP, F.when(port_unreachable(), with_payload("Q", "G")).otherwise(with_payload("I", "H")))
        .when((protocol == V.SCTP) & (chunks != ""), chunks)
        .otherwise(by_flags)
    )
    looked_up = packets.withColumn(
        "_flagged", F.coalesce(F.try_element_at(known, F.array_join("flags", ",")), F.lit("X"))
    )
    return looked_up.withColumn(
        "kind", F.when(F.col("direction") == V.OUTCOME, F.lower(letter)).otherwise(letter)
    ).drop("_flagged")


# --- keys and display text -------------------------------------------------


def l4_key(source_port: Column, destination_port: Column, direction: Column) -> Column:
    """Ports, remote side first, so that both directions share the key."""
    remote = F.when(direction == V.INCOME, source_port).otherwise(destination_port)
    host = F.when(direction == V.INCOME, destination_port).otherwise(source_port)
    return F.concat(F.lpad(remote.cast("string"), 5, "0"), F.lpad(host.cast("string"), 5, "0"))


def pair_key(source: Column, destination: Column, direction: Column) -> Column:
    """Addresses, remote side first."""
    remote = F.when(direction == V.INCOME, source).otherwise(destination)
    host = F.when(direction == V.INCOME, destination).otherwise(source)
    return F.concat_ws("~", remote, host)


def flag_text(flags: Column) -> Column:
    return F.array_join(flags, "")


def readable_address(address: Column) -> Column:
    """"[INET4:192.168.1.4]" -> "192.168.1.4"."""
    part = F.split_part(address, F.lit(":"), F.lit(2))
    return F.substring(part, F.lit(1), F.greatest(F.length(part) - 1, F.lit(0)))


def info_text() -> Column:
    """Display line of a TCP packet; empty for every other protocol."""
    def shown(key):
        return F.coalesce(F.try_element_at("info", F.lit(key)), F.lit("undefined"))

    flags = F.array_join(F.transform("flags", lambda f: F.concat(f, F.lit(" "))), ",")
    line = F.concat(
        F.lit("Flags="), flags, F.lit("WIN SCALE="), shown("WIN_SCALE"), F.lit(" WIN="), shown("WIN"),
        F.lit(" SEQ="), shown("SEQ"), F.lit(" HEADER LENGTH="), shown("HEADER_LENGTH"),
    )
    return F.when(is_protocol(V.TCP), line).otherwise("")
