"""Flow rules over the columns that `operators.flows` builds.

A rule is SQL text over one flow row (`*_rule`), so that the verdict cascade can
be put together as one CASE; the functions of the same name give it as a Column.
Packet letters: see `functions.packet.with_kind`. Upper case is incoming.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.rules import Rules

TCP, UDP, SCTP = (f"protocol = '{p}'" for p in (V.TCP, V.UDP, V.SCTP))
TWO = "n_packets = 2"


def either(*rules: str) -> str:
    return "(" + " OR ".join(rules) + ")"


def every(*rules: str) -> str:
    return "(" + " AND ".join(rules) + ")"


def first_is(letters: str) -> str:
    return _kind("first", letters)


def last_is(letters: str) -> str:
    return _kind("last", letters)


def _kind(packet: str, letters: str) -> str:
    return f"{packet}.kind IN ({', '.join(repr(x) for x in letters)})"


def _known(test: str) -> str:
    return f"coalesce({test}, false)"


def _number(value: str) -> str:
    return f"try_cast({value} AS bigint)"


def _within(limit_us: int) -> str:
    return f"last.timestamp - first.timestamp <= {limit_us}"


BAD_CHECKSUM = "coalesce(last.checksum_correct, '') <> 'true'"
INITIATED = either(every(TCP, first_is("s")), every(SCTP, "contains(first.kind, 'j')"))
TCP_PROPER = every("saw_fin_in", "saw_fin_out")
PROPERLY_CLOSED = f"(CASE WHEN {TCP} THEN {TCP_PROPER} WHEN {SCTP} THEN saw_shutdown ELSE true END)"
TWO_CLOSED = every(TWO, "short_path IN ('Sr', 'Sk')")
FOUR_CONNECT = every("n_packets = 4", "short_path IN ('ScAR', 'ScAK', 'ScER', 'ScEK')")
UDP_CLOSED = (
    f"(CASE WHEN first.kind = upper(first.kind) AND {last_is('qg')} THEN true WHEN {last_is('uw')} THEN false "
    "ELSE n_packets > 2 AND pair_unreachable END)"
)
SCTP_CLOSED = every(TWO, "contains(first.kind, 'J')", "last.kind RLIKE '[bihqg]'")
PORT_CLOSED = (
    f"(CASE WHEN {TCP} THEN pair_closed WHEN {SCTP} THEN {SCTP_CLOSED} WHEN {UDP} THEN {UDP_CLOSED} ELSE false END)"
)
DATA_SENT = (
    f"(CASE WHEN {TCP} THEN saw_tcp_data AND coalesce(upper(short_path), '') NOT IN ('SCAK', 'SCEK', 'SK') "
    f"WHEN {SCTP} THEN saw_data_chunk WHEN {UDP} THEN saw_in_payload ELSE false END)"
)
NULL_SCAN = every(TCP, "saw_no_flags")
XMAS = every(
    TCP, TWO, first_is("Z"), last_is("Kk"), _known("last.win = '0'"),
    _known(f"{_number('last.ack')} - 1 = {_number('first.seq')}"),
)
NOT_FINISHED = every(TCP, last_is("RrKk"))
LAST_RESET = last_is("RrKk")
LAST_INCOMING = "(last.kind = upper(last.kind))"
INTERNET_INCOMING = every(
    f"protocol IN ({', '.join(repr(p) for p in V.INTERNET_PROTOCOLS)})", "saw_incoming"
)


def closed_rule(rules: Rules = Rules()) -> str:
    sctp = "saw_shutdown" if rules.sctp_closes else "false"
    return f"(CASE WHEN {TCP} THEN saw_reset OR {TCP_PROPER} WHEN {SCTP} THEN {sctp} ELSE false END)"


def suspicious_ack_win_rule(rules: Rules = Rules()) -> str:
    size = [TWO] if rules.two_packet_ack_win else []
    return every(TCP, *size, first_is("AE"), last_is("Rr"), _within(rules.max_gap_us))


def ack_win_rule(rules: Rules = Rules()) -> str:
    return every(suspicious_ack_win_rule(rules), _known("first.seq = '0'"))


def suspicious_maimon_rule(rules: Rules = Rules()) -> str:
    return every(TCP, TWO, first_is("MV"), last_is("r"), _within(rules.max_gap_us))


def maimon_rule(rules: Rules = Rules()) -> str:
    return every(
        suspicious_maimon_rule(rules), BAD_CHECKSUM, _known("first.seq = '0' AND first.win = '1024'")
    )


def _ack_follows(rules: Rules) -> str:
    # the literal rule appends the digit 1 to the sequence number
    after = f"{_number('first.seq')} + 1" if rules.full_fin_rule else _number("concat(first.seq, '1')")
    return _known(f"{_number('last.ack')} = {after}")


_FIN_PROBE = every(TCP, TWO, first_is("F"))


def fin_rule(rules: Rules = Rules()) -> str:
    reply = every(
        last_is("Kk"), BAD_CHECKSUM, _known("last.seq = '1' AND last.win = '0'"), _ack_follows(rules)
    )
    if not rules.full_fin_rule:
        return every(TCP, reply)
    return every(_FIN_PROBE, _known("first.seq = '1' AND first.win = '1024'"), reply)


def suspicious_fin_rule(rules: Rules = Rules()) -> str:
    return every(_FIN_PROBE, last_is("Kk"), _ack_follows(rules))


# --- the rules as columns ---------------------------------------------------------


def host_initiated() -> Column:
    return F.expr(INITIATED)


def closed(rules: Rules = Rules()) -> Column:
    return F.expr(closed_rule(rules))


def properly_closed() -> Column:
    return F.expr(PROPERLY_CLOSED)


def closed_two_packets() -> Column:
    return F.expr(TWO_CLOSED)


def connect_four_packets() -> Column:
    return F.expr(FOUR_CONNECT)


def port_closed() -> Column:
    return F.expr(PORT_CLOSED)


def udp_port_closed() -> Column:
    return F.expr(every(UDP, UDP_CLOSED))


def data_sent() -> Column:
    return F.expr(DATA_SENT)


def ack_win(rules: Rules = Rules()) -> Column:
    return F.expr(ack_win_rule(rules))


def suspicious_ack_win(rules: Rules = Rules()) -> Column:
    return F.expr(suspicious_ack_win_rule(rules))


def null_scan() -> Column:
    return F.expr(NULL_SCAN)


def maimon(rules: Rules = Rules()) -> Column:
    return F.expr(maimon_rule(rules))


def suspicious_maimon(rules: Rules = Rules()) -> Column:
    return F.expr(suspicious_maimon_rule(rules))


def xmas() -> Column:
    return F.expr(XMAS)


def fin_scan(rules: Rules = Rules()) -> Column:
    return F.expr(fin_rule(rules))


def suspicious_fin(rules: Rules = Rules()) -> Column:
    return F.expr(suspicious_fin_rule(rules))


def not_properly_finished() -> Column:
    return F.expr(NOT_FINISHED)


def last_is_incoming() -> Column:
    return F.expr(LAST_INCOMING)


def incoming_internet() -> Column:
    return F.expr(INTERNET_INCOMING)
