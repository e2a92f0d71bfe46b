"""The catalog's results as plain SQL over the same tables.

Flows are computed here with row numbers, leads and counts over the packets, not
with the mergeable facts of the Spark side, so the two share no shape.
"""

from __future__ import annotations

from flowwatch import fixed_values as V
from flowwatch.plans import catalog as C
from flowwatch.sources import traffic as T


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_MULTICAST = _in(V.MULTICAST)


def _ip(a: int, b: int, c: int, d: int) -> int:
    return ((a * 256 + b) * 256 + c) * 256 + d


def _number(address: str) -> str:
    """An IPv4 address as a number."""
    part = [f"CAST(split_part({address}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"((({part[0]} * 256 + {part[1]}) * 256 + {part[2]}) * 256 + {part[3]})"

PACKETS = f"""
conv AS (
  SELECT o_orderkey AS flow_key, o_custkey AS cust,
    CASE WHEN o_custkey % 5 = 0 THEN
           CASE WHEN o_orderkey % 10 <= 5 THEN 1 WHEN o_orderkey % 10 = 6 THEN 2 WHEN o_orderkey % 10 = 7 THEN 3
                WHEN o_orderkey % 10 = 8 THEN 13 ELSE 15 END
         WHEN o_custkey % 5 = 1 THEN o_orderkey % 22
         ELSE CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 12 ELSE 14 END END AS script,
    '10.0.' || CAST(o_custkey // 250 AS VARCHAR) || '.' || CAST(o_custkey % 250 AS VARCHAR) AS remote,
    CAST(CASE WHEN o_custkey % 5 <= 1 THEN 20 + o_orderkey % 24
         ELSE CASE o_orderkey % 3 WHEN 0 THEN 22 WHEN 1 THEN 80 ELSE 443 END END AS INTEGER) AS host_port,
    CAST(40000 + o_orderkey % 20000 AS INTEGER) AS remote_port,
    epoch_us(o_orderdate) + o_orderkey * 1000000 AS start
  FROM orders),
p AS (
  SELECT c.flow_key, c.remote, c.flow_key * 16 + s.pos AS packet_id, c.start + s.pos * s.dt AS timestamp,
    s.pos, s.protocol, s.direction, s.flag_list AS flags, s.length,
    CASE WHEN s.direction = 'INCOME' THEN c.remote ELSE '{T.HOST}' END AS source_address,
    CASE WHEN s.direction = 'INCOME' THEN '{T.HOST}' ELSE c.remote END AS destination_address,
    CAST(CASE WHEN s.protocol NOT IN ('TCP', 'UDP', 'SCTP') THEN -1
         WHEN s.direction = 'INCOME' THEN c.remote_port ELSE c.host_port END AS INTEGER) AS source_port,
    CAST(CASE WHEN s.protocol NOT IN ('TCP', 'UDP', 'SCTP') THEN -1
         WHEN s.direction = 'INCOME' THEN c.host_port ELSE c.remote_port END AS INTEGER) AS destination_port,
    CASE WHEN s.protocol = 'TCP' THEN s.seq END AS seq, CASE WHEN s.protocol = 'TCP' THEN s.ack END AS ack,
    CASE WHEN s.protocol = 'TCP' THEN s.win END AS win, CASE WHEN s.protocol = 'TCP' THEN s.header END AS header,
    CASE WHEN s.protocol = 'TCP' THEN s.checksum END AS checksum,
    CASE WHEN s.protocol = 'ICMP' THEN 'ICMP' WHEN s.protocol IN ('TCP', 'UDP', 'SCTP')
         THEN lpad(CAST(c.remote_port AS VARCHAR), 5, '0') || lpad(CAST(c.host_port AS VARCHAR), 5, '0')
         ELSE 'NONE' END AS l4_key,
    c.remote || '~{T.HOST}' AS pair_key
  FROM conv c JOIN {T.script_values()} ON c.script = s.script),
pot AS (SELECT DISTINCT remote AS source FROM conv WHERE cust % 50 <= 1)
"""

LAYERED = """
lay0 AS (
  SELECT packet_id * 4 AS packet_id, 0 AS variant, protocol, flags, source_address AS src, destination_address AS dst,
         source_port AS sport, destination_port AS dport, seq, ack, win, checksum, header, length, flow_key, remote
  FROM p
  UNION ALL
  SELECT packet_id * 4 + 1, 1, protocol, flags, remote, '224.0.0.251', source_port, destination_port, seq, ack, win,
         checksum, header, length, flow_key, remote FROM p WHERE pos = 0
  UNION ALL
  SELECT packet_id * 4 + 2, 2, protocol, flags, '192.168.1.4', remote, source_port, destination_port, seq, ack, win,
         checksum, header, length, flow_key, remote FROM p WHERE pos = 0),
lay AS (
  SELECT *, CASE WHEN src = '192.168.1.4' THEN 'OUTCOME' ELSE 'INCOME' END AS direction
  FROM lay0
  WHERE CASE WHEN protocol IN ('UDP', 'IPv4') THEN src <> '192.168.1.4' AND dst <> '224.0.0.251' ELSE true END),
lk AS (
  SELECT *, CASE WHEN direction = 'INCOME' THEN src || '~' || dst ELSE dst || '~' || src END AS pair_key,
    CASE WHEN protocol = 'ICMP' THEN 'ICMP' WHEN protocol NOT IN ('TCP', 'UDP', 'SCTP') THEN 'NONE'
         WHEN direction = 'INCOME' THEN lpad(CAST(sport AS VARCHAR), 5, '0') || lpad(CAST(dport AS VARCHAR), 5, '0')
         ELSE lpad(CAST(dport AS VARCHAR), 5, '0') || lpad(CAST(sport AS VARCHAR), 5, '0') END AS l4_key
  FROM lay)
"""

_KEYS = "flow_key, l4_key, pair_key"
_LETTER = """CASE WHEN direction = 'OUTCOME' THEN lower(sym) ELSE sym END"""

FLOWS = f"""
m0 AS (
  SELECT p.*, false AS guest FROM p
  UNION ALL
  SELECT p.* REPLACE (u.l4_key AS l4_key), true FROM p
  JOIN (SELECT DISTINCT {_KEYS} FROM p WHERE protocol = 'UDP') u
    ON p.flow_key = u.flow_key AND p.pair_key = u.pair_key WHERE p.protocol = 'ICMP'),
m AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_KEYS}) AS n,
    lead(flags) OVER w AS flags2, lead(flags, 2) OVER w AS flags3, lead(flags, 3) OVER w AS flags4,
    lead(direction) OVER w AS dir2, lead(protocol) OVER w AS proto2,
    direction = 'INCOME' AS inc, direction = 'OUTCOME' AS out,
    CASE WHEN protocol = 'UDP' THEN CASE WHEN length > 0 THEN 'W' ELSE 'U' END
         WHEN flags LIKE 'DESTINATION_UNREACHABLE,%,3' THEN CASE WHEN length > 0 THEN 'G' ELSE 'Q' END
         WHEN protocol = 'ICMP' THEN CASE WHEN length > 0 THEN 'H' ELSE 'I' END WHEN flags = 'SYN' THEN 'S'
         WHEN flags = 'SYN,ACK' THEN 'C' WHEN flags = 'ACK' THEN CASE WHEN length > 0 THEN 'E' ELSE 'A' END WHEN flags = 'RST' THEN 'R'
         WHEN flags = 'RST,ACK' THEN 'K' WHEN flags = '' THEN 'N' WHEN flags = 'FIN' THEN 'F'
         WHEN flags = 'FIN,ACK' THEN 'M' WHEN flags = 'PSH,ACK' THEN CASE WHEN length > 0 THEN 'D' ELSE 'P' END WHEN flags = 'FIN,PSH,URG' THEN 'Z'
         WHEN flags = 'INIT' THEN 'J' WHEN flags = 'ABORT' THEN 'B' WHEN flags = 'DATA' THEN 'O' ELSE 'X' END AS sym
  FROM m0 WINDOW w AS (PARTITION BY {_KEYS} ORDER BY timestamp, packet_id)),
f0 AS (
  SELECT {_KEYS}, remote AS true_remote, count(*) AS n,
    min_by(protocol, rn) FILTER (WHERE NOT guest) AS protocol,
    max(CASE WHEN rn = 1 THEN packet_id END) AS f_id, max(CASE WHEN rn = n THEN packet_id END) AS l_id,
    max(CASE WHEN rn = 1 THEN timestamp END) AS first_ts, max(CASE WHEN rn = n THEN timestamp END) AS last_ts,
    max(CASE WHEN rn = 1 THEN direction END) AS f_dir, max(CASE WHEN rn = n THEN direction END) AS l_dir,
    max(CASE WHEN rn = 1 THEN flags END) AS f_flags, max(CASE WHEN rn = n THEN flags END) AS l_flags,
    max(CASE WHEN rn = 1 THEN protocol END) AS f_proto, max(CASE WHEN rn = n THEN protocol END) AS l_proto,
    max(CASE WHEN rn = 1 THEN seq END) AS f_seq, max(CASE WHEN rn = n THEN seq END) AS l_seq,
    max(CASE WHEN rn = 1 THEN win END) AS f_win, max(CASE WHEN rn = n THEN win END) AS l_win,
    max(CASE WHEN rn = n THEN ack END) AS l_ack, max(CASE WHEN rn = n THEN checksum END) AS l_sum,
    max(CASE WHEN rn = 1 THEN header END) AS f_header, max(CASE WHEN rn = 1 THEN length END) AS f_len,
    max(CASE WHEN rn = 1 THEN destination_address END) AS f_dst, max(CASE WHEN rn = 1 THEN source_port END) AS f_sport,
    min(rn) FILTER (WHERE inc) AS in_rn,
    min_by(source_address, rn) FILTER (WHERE inc) AS in_addr, min_by(destination_port, rn) FILTER (WHERE inc) AS in_port,
    min_by(packet_id, rn) FILTER (WHERE inc) AS in_id, min_by(protocol, rn) FILTER (WHERE inc) AS in_proto,
    min_by(destination_address, rn) FILTER (WHERE out) AS out_addr, min_by(source_port, rn) FILTER (WHERE out) AS out_port,
    bool_or(flags = '') AS no_flags, bool_or(flags IN ('RST', 'RST,ACK', 'ACK,RST')) AS reset,
    bool_or(flags = 'FIN,ACK' AND inc) AND bool_or(flags = 'FIN,ACK' AND out) AS fins,
    bool_or(protocol = 'SCTP' AND flags = 'SHUTDOWN') AS shut,
    bool_or(flags IN ('ACK', 'PSH,ACK', 'ACK,PSH') AND length > 0) AS tcp_data,
    bool_or(protocol = 'SCTP' AND inc AND flags = 'DATA') AS sctp_data,
    bool_or(inc AND length > 0) AS in_data, bool_or(inc) AS any_in,
    bool_or(inc AND flags = 'SYN' AND dir2 = 'OUTCOME' AND flags2 IN ('RST', 'RST,ACK')) AS pair_closed,
    bool_or(inc AND protocol = 'UDP' AND dir2 = 'OUTCOME' AND proto2 = 'ICMP') AS pair_unreach,
    bool_or(flags = 'SYN' AND coalesce(flags2, '') IN ('RST', 'RST,ACK')) AS syn_reset,
    bool_or(flags = 'SYN' AND coalesce(flags2, '') = 'SYN,ACK' AND coalesce(flags3, '') IN ('RST', 'RST,ACK')) AS half,
    bool_or(flags = 'SYN' AND coalesce(flags2, '') = 'SYN,ACK' AND coalesce(flags3, '') = 'ACK'
            AND coalesce(flags4, '') IN ('RST', 'RST,ACK')) AS conn,
    string_agg(flags, '/' ORDER BY rn) AS trail,
    string_agg(direction, '/' ORDER BY rn) AS ways,
    string_agg({_LETTER}, '' ORDER BY rn) AS path
  FROM m GROUP BY {_KEYS}, remote),
f1 AS (
  SELECT *, coalesce(in_addr, out_addr) AS remote, coalesce(in_port, out_port) AS host_port,
    f_dir = 'INCOME' AS f_in, f_dir = 'OUTCOME' AS f_out, l_dir = 'INCOME' AS l_in, l_dir = 'OUTCOME' AS l_out,
    last_ts - first_ts AS gap, protocol = 'TCP' AS tcp, protocol = 'UDP' AS udp, protocol = 'SCTP' AS sctp
  FROM f0),
f2 AS (
  SELECT *,
    (tcp AND f_flags = 'SYN' AND f_out) OR (sctp AND f_flags = 'INIT' AND f_out) AS q1,
    CASE WHEN tcp THEN reset OR fins WHEN sctp THEN shut ELSE false END AS q2,
    CASE WHEN tcp THEN fins WHEN sctp THEN shut ELSE true END AS q3,
    n = 2 AND f_in AND f_flags = 'SYN' AND l_out AND l_flags IN ('RST', 'RST,ACK') AS q4,
    n = 4 AND ways = 'INCOME/OUTCOME/INCOME/INCOME'
      AND trail IN ('SYN/SYN,ACK/ACK/RST', 'SYN/SYN,ACK/ACK/RST,ACK') AS q5,
    udp AND CASE WHEN f_in AND l_out AND l_proto = 'ICMP' AND starts_with(l_flags, 'DESTINATION_UNREACHABLE,')
                      AND ends_with(l_flags, ',3') THEN true
                 WHEN l_out AND l_proto = 'UDP' THEN false ELSE n > 2 AND coalesce(pair_unreach, false) END AS q7,
    CASE WHEN tcp THEN trail NOT IN ('SYN/SYN,ACK/ACK/RST,ACK', 'SYN/RST,ACK') AND tcp_data
         WHEN sctp THEN sctp_data WHEN udp THEN in_data ELSE false END AS q8,
    tcp AND n = 2 AND f_in AND f_flags = 'ACK' AND l_flags = 'RST' AND gap <= 1000 AS q10,
    tcp AND no_flags AS q11,
    tcp AND n = 2 AND f_in AND f_flags IN ('FIN,ACK', 'ACK,FIN') AND l_out AND l_flags = 'RST' AND gap <= 1000 AS q13,
    tcp AND n = 2 AND f_in AND f_flags = 'FIN,PSH,URG' AND l_flags = 'RST,ACK' AND l_win = '0'
      AND TRY_CAST(l_ack AS BIGINT) - 1 = TRY_CAST(f_seq AS BIGINT) AS q14,
    tcp AND n = 2 AND f_in AND f_flags = 'FIN' AND l_flags = 'RST,ACK'
      AND TRY_CAST(l_ack AS BIGINT) = TRY_CAST(f_seq AS BIGINT) + 1 AS q16,
    tcp AND l_flags IN ('RST', 'RST,ACK') AS q17, l_in AS q18,
    protocol IN ('ICMP', 'ARP', 'IPv4', 'IPv6') AND any_in AS q19
  FROM f1),
f AS (
  SELECT *,
    CASE WHEN tcp THEN coalesce(pair_closed, false)
         WHEN sctp THEN n = 2 AND f_in AND f_flags = 'INIT' AND l_out AND (l_flags = 'ABORT' OR l_proto = 'ICMP')
         WHEN udp THEN q7 ELSE false END AS q6,
    q10 AND coalesce(f_seq = '0', false) AS q9,
    q13 AND l_sum <> 'true' AND f_seq = '0' AND f_win = '1024' AS q12,
    q16 AND f_seq = '1' AND f_win = '1024' AND l_seq = '1' AND l_sum <> 'true' AND l_win = '0' AS q15,
    CASE WHEN syn_reset OR half THEN 'TCP SYN' WHEN conn THEN 'TCP CONNECT' ELSE 'UNKNOWN' END AS technique
  FROM f2)
"""


def _verdict(honeypot: bool = False, literal: bool = False) -> str:
    """The cascade; the literal order drops rules that no flow of the tables can reach."""
    early = ["WHEN q11 THEN 'TcpNullScanAttack'", "WHEN q9 THEN 'AckWinScanAttack'",
             "WHEN q10 THEN 'SuspiciousAckWinScanAttack'", "WHEN q14 THEN 'XmasScanAttack'"]
    specific = ["WHEN q12 THEN 'MaimonScanAttack'", "WHEN q13 THEN 'SuspiciousMaimonScanAttack'",
                "WHEN q15 THEN 'FinScanAttack'", "WHEN q16 THEN 'SuspiciousFinScanAttack'"]
    general = ["WHEN q1 AND NOT q2 AND q8 THEN 'InitializingConnectionAndDataTransfer'",
               "WHEN q1 AND NOT q2 THEN 'InitializingConnection'", "WHEN q6 THEN 'PortClosed'",
               "WHEN NOT q8 AND q2 AND q17 THEN 'DidNotSendData'",
               "WHEN q8 AND q2 AND q1 THEN 'InitializingRemoveFinePackets'", "WHEN q8 AND q2 THEN 'RemoveFinePackets'"]
    rules = early + general + specific if literal else early + specific + general
    pot = "WHEN remote IN (SELECT source FROM pot) THEN 'NetworkScanAlert'" if honeypot else ""
    return f"""CASE {pot} WHEN q19 THEN 'SuspiciousNetworkScan'
      WHEN tcp OR sctp THEN CASE {' '.join(rules)} ELSE 'ContinueIteration' END
      WHEN udp AND q6 THEN 'PortClosed' WHEN udp AND q8 THEN 'SendData' WHEN udp THEN 'DidNotSendData'
      ELSE 'ContinueIteration' END"""


VERDICTS = f"""
v AS (SELECT *, {_verdict()} AS verdict FROM f),
h AS (
  SELECT remote AS source, {_KEYS}, host_port AS port, n AS n_packets, verdict, last_ts AS verdict_ts
  FROM v WHERE verdict IN {_in(V.HISTORY_LABELS)})
"""

_OPEN, _CLOSED, _SCAN = _in(V.OPEN_PORT_LABELS), _in(V.CLOSED_PORT_LABELS), _in(V.PORT_SCAN_LABELS)
_SENT, _INIT = _in(V.SENT_DATA_LABELS), _in(V.INITIATING_LABELS)


def _features(pairs: str) -> str:
    """The seven features from named counts."""
    return f"""
    CAST(initiated AS INTEGER) AS host_initiated,
    CASE WHEN sent AND unsent THEN 2 WHEN sent THEN 1 ELSE 3 END AS data_transfer,
    CASE WHEN after_open THEN 3 ELSE 1 END AS closed_after_open,
    CASE WHEN closed_ports < 5 THEN 1 WHEN closed_ports = 5 THEN 2 ELSE 3 END AS threshold_class,
    CASE WHEN used_ports <= 1 THEN 0.0 ELSE round(CAST({pairs} AS DOUBLE) / used_ports, 9) END AS neighbour_factor,
    CASE WHEN open_packets = 0 THEN 0.0 ELSE round(2 * CAST(open_ports AS DOUBLE) / open_packets, 9) END AS open_port_factor,
    CASE WHEN closed_ports <= 5 THEN 0.0
         ELSE round((log2(CAST(closed_ports - 4 AS DOUBLE)) - 1) / 10, 9) END AS closed_port_score"""


FEATURES = f"""
used AS (
  SELECT source, port, port - lag(port) OVER (PARTITION BY source ORDER BY port) AS step
  FROM (SELECT DISTINCT source, port FROM h WHERE verdict IN {_OPEN} OR verdict IN {_CLOSED})),
seen AS (
  SELECT source, port, min((verdict_ts, {_KEYS})) AS first_seen, bool_or(verdict = 'DidNotSendData') AS unsent,
         bool_or(verdict = 'PortClosed') AS shut
  FROM h GROUP BY source, port),
seen2 AS (SELECT *, lead(shut) OVER (PARTITION BY source ORDER BY first_seen, port) AS next_shut FROM seen),
counts AS (
  SELECT source, count(DISTINCT CASE WHEN verdict IN {_CLOSED} THEN port END) AS closed_ports,
    count(DISTINCT CASE WHEN verdict IN {_OPEN} THEN port END) AS open_ports,
    CAST(sum(CASE WHEN verdict IN {_OPEN} THEN n_packets ELSE 0 END) AS BIGINT) AS open_packets,
    bool_or(verdict IN {_INIT}) AS initiated, bool_or(verdict IN {_SENT}) AS sent,
    bool_or(verdict = 'DidNotSendData') AS unsent, count(*) AS n_verdicts
  FROM h GROUP BY source),
x0 AS (
  SELECT c.*, coalesce(u.used_ports, 0) AS used_ports, coalesce(u.port_pairs, 0) AS port_pairs, s.after_open
  FROM counts c
  LEFT JOIN (SELECT source, count(*) AS used_ports, count(*) FILTER (WHERE step = 1) AS port_pairs
             FROM used GROUP BY source) u USING (source)
  JOIN (SELECT source, bool_or(unsent AND coalesce(next_shut, false)) AS after_open FROM seen2 GROUP BY source) s
    USING (source)),
x AS (SELECT *, {_features('port_pairs')} FROM x0)
"""

# features at each scored verdict: every pair (verdict, earlier verdict) of a source
AS_OF = f"""
s AS (SELECT row_number() OVER () AS sid, * FROM h WHERE verdict IN {_SCAN}),
e AS (
  SELECT s.sid, s.source, s.flow_key AS at_flow, s.verdict AS at_verdict, h.port, h.verdict, h.n_packets,
         (h.verdict_ts, h.flow_key, h.l4_key, h.pair_key) AS moment
  FROM s JOIN h ON h.source = s.source
   AND (h.verdict_ts, h.flow_key, h.l4_key, h.pair_key) <= (s.verdict_ts, s.flow_key, s.l4_key, s.pair_key)),
eu AS (SELECT sid, port - lag(port) OVER (PARTITION BY sid ORDER BY port) AS step
       FROM (SELECT DISTINCT sid, port FROM e WHERE verdict IN {_OPEN} OR verdict IN {_CLOSED})),
es AS (SELECT sid, unsent, lead(shut) OVER (PARTITION BY sid ORDER BY first_seen, port) AS next_shut
       FROM (SELECT sid, port, min(moment) AS first_seen, bool_or(verdict = 'DidNotSendData') AS unsent,
                    bool_or(verdict = 'PortClosed') AS shut FROM e GROUP BY sid, port)),
ec AS (
  SELECT sid, source, at_flow AS flow_key, at_verdict AS verdict,
    count(DISTINCT CASE WHEN verdict IN {_CLOSED} THEN port END) AS closed_ports,
    count(DISTINCT CASE WHEN verdict IN {_OPEN} THEN port END) AS open_ports,
    sum(CASE WHEN verdict IN {_OPEN} THEN n_packets ELSE 0 END) AS open_packets,
    bool_or(verdict IN {_INIT}) AS initiated, bool_or(verdict IN {_SENT}) AS sent,
    bool_or(verdict = 'DidNotSendData') AS unsent
  FROM e GROUP BY sid, source, at_flow, at_verdict),
ex AS (
  SELECT ec.*, coalesce(u.used_ports, 0) AS used_ports, coalesce(u.port_pairs, 0) AS port_pairs, t.after_open
  FROM ec
  LEFT JOIN (SELECT sid, count(*) AS used_ports, count(*) FILTER (WHERE step = 1) AS port_pairs
             FROM eu GROUP BY sid) u USING (sid)
  JOIN (SELECT sid, bool_or(unsent AND coalesce(next_shut, false)) AS after_open FROM es GROUP BY sid) t USING (sid))
"""


def _tools_case(table: dict, key: str, default: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{','.join(sorted(t))}'" for k, t in table.items())
    return f"CASE {key} {cases} ELSE '{default}' END"


def _tcp_tools(kind: str) -> str:
    """Header length first; where that leaves several, the window decides."""
    header = "coalesce(TRY_CAST(f_header AS INTEGER), 0)"
    window = "coalesce(TRY_CAST(f_win AS INTEGER), 0)"
    if kind == "TCP SYN":
        return (f"CASE {header} WHEN 32 THEN 'Angry IP Scanner' WHEN 40 THEN 'EVILSCAN' WHEN 24 THEN 'NMAP' "
                f"WHEN 20 THEN CASE {window} WHEN 65535 THEN 'ZMAP' WHEN 1024 THEN 'MASSCAN' ELSE 'UNKNOWN' END "
                f"ELSE 'UNKNOWN' END")
    return (f"CASE {header} WHEN 32 THEN 'Angry IP Scanner' WHEN 40 THEN 'NMAP' "
            f"WHEN 20 THEN CASE {window} WHEN 65535 THEN 'ZMAP' WHEN 1024 THEN 'MASSCAN' ELSE 'UNKNOWN' END "
            f"ELSE 'UNKNOWN' END")


_TCP_TOOLS = (f"CASE technique WHEN 'TCP SYN' THEN {_tcp_tools('TCP SYN')} "
              f"WHEN 'TCP CONNECT' THEN {_tcp_tools('TCP CONNECT')} ELSE 'UNKNOWN' END")
_LEN_TOOLS = (f"CASE WHEN f_proto = 'UDP' THEN {_tools_case(V.TOOLS_BY_LENGTH['UDP'], 'f_len', 'NMAP')} "
              f"WHEN f_proto = 'ICMP' THEN {_tools_case(V.TOOLS_BY_LENGTH['ICMP'], 'f_len', 'NMAP')} "
              f"WHEN f_proto IN ('ARP', 'IPv4', 'IPv6') THEN 'NMAP' ELSE 'UNKNOWN' END")
_ATTACK_TOOLS = "CASE WHEN attack_type = 'TCP FIN' THEN 'UNKNOWN' ELSE 'NMAP' END"
_DIRECT = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in V.DIRECT_ATTACK_TYPE.items()) + " END"

ALERTS = f"""
direct AS (
  SELECT *, {_ATTACK_TOOLS} AS tools FROM (
    SELECT last_ts AS time, 'PORT SCAN' AS scan_type, {_DIRECT} AS attack_type, in_addr AS attacker, in_port AS port,
           CAST(100 AS DOUBLE) AS chance, {_KEYS}
    FROM v WHERE verdict IN {_in(V.DIRECT_ATTACKS)} AND in_rn IS NOT NULL)),
scan0 AS (
  SELECT *, CASE in_proto WHEN 'UDP' THEN 'UDP' ELSE technique END AS attack_type,
         CASE in_proto WHEN 'UDP' THEN {_LEN_TOOLS} ELSE {_TCP_TOOLS} END AS tools
  FROM v WHERE verdict IN ('PortClosed', 'DidNotSendData') AND in_proto IN ('TCP', 'UDP')),
scan AS (
  SELECT last_ts AS time, 'PORT SCAN' AS scan_type, attack_type, in_addr AS attacker, in_port AS port,
         CAST(100 AS DOUBLE) AS chance, {_KEYS}, tools FROM scan0),
a AS (SELECT * FROM direct UNION ALL SELECT * FROM scan),
net0 AS (SELECT *, {_verdict(honeypot=True)} AS verdict FROM f),
net AS (
  SELECT last_ts AS time, 'NETWORK SCAN' AS scan_type,
    CASE f_proto WHEN 'TCP' THEN technique WHEN 'UDP' THEN 'UDP' WHEN 'SCTP' THEN 'SCTP INIT' WHEN 'ICMP' THEN 'ICMP'
                 WHEN 'ARP' THEN 'ARP' ELSE 'IP' END AS attack_type,
    coalesce(in_addr, f_dst) AS attacker,
    CASE WHEN f_proto IN ('ICMP', 'ARP', 'IPv4', 'IPv6') THEN -1 ELSE coalesce(in_port, f_sport) END AS port,
    CAST(100 AS DOUBLE) AS chance, {_KEYS},
    CASE WHEN f_proto = 'TCP' THEN {_TCP_TOOLS} ELSE {_LEN_TOOLS} END AS tools, verdict, remote, q19
  FROM net0),
ports AS (
  SELECT source, port, bool_or(verdict IN {_SCAN}) AS scanned FROM h
  WHERE port <> -1 AND (verdict IN {_SCAN} OR verdict = 'SendData') GROUP BY source, port)
"""

# one row per (alert group, port); groups carry their own attack type
ROLLED = """
g AS (SELECT attacker, scan_type, attack_type, count(*) AS n, min(time) AS time, max(chance) AS chance
      FROM a GROUP BY ALL),
lab AS (SELECT *, bool_or(attack_type = 'TCP CONNECT') OVER (PARTITION BY attacker) AS own,
               bool_or(attack_type = 'TCP CONNECT') OVER () AS anywhere FROM g),
lab2 AS (SELECT *, CASE WHEN own AND attack_type IN ('TCP SYN', 'TCP CONNECT') THEN 'TCP SYN, TCP CONNECT'
                        ELSE attack_type END AS label FROM lab),
gp AS (SELECT DISTINCT l.attacker, l.scan_type, l.label, q.port FROM lab2 l JOIN (
         SELECT attacker, attack_type, port FROM a
         UNION SELECT g.attacker, g.attack_type, ports.port FROM g JOIN ports ON ports.source = g.attacker
               WHERE ports.scanned OR g.attack_type = 'UDP') q
       ON q.attacker = l.attacker AND q.attack_type = l.attack_type WHERE q.port <> -1),
gt AS (SELECT DISTINCT l.attacker, l.scan_type, l.label, unnest(string_split(a.tools, ',')) AS tool
       FROM lab2 l JOIN a ON a.attacker = l.attacker AND a.attack_type = l.attack_type),
r AS (
  SELECT strftime(make_timestamp(min(time)), '%Y-%m-%d %H:%M') AS time, attacker, scan_type, label AS attack_type,
         max(chance) AS chance, CAST(sum(n) AS BIGINT) AS n_alerts FROM lab2 GROUP BY attacker, scan_type, label),
rr AS (
  SELECT r.*, p.scanned_ports, p.n_ports, p.first_ports, t.tools
  FROM r
  JOIN (SELECT attacker, scan_type, label, string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) AS scanned_ports,
               CAST(count(*) AS INTEGER) AS n_ports,
               array_to_string(list_slice(list(port ORDER BY port), 1, 30), ',') AS first_ports
        FROM gp GROUP BY ALL) p
    ON p.attacker = r.attacker AND p.scan_type = r.scan_type AND p.label = r.attack_type
  JOIN (SELECT attacker, scan_type, label, string_agg(tool, ',' ORDER BY tool) AS tools FROM gt GROUP BY ALL) t
    ON t.attacker = r.attacker AND t.scan_type = r.scan_type AND t.label = r.attack_type)
"""

_ORDER = ["packets", "layered", "flows", "verdicts", "features", "as_of", "alerts", "rolled"]
_PARTS = dict(zip(_ORDER, [PACKETS, LAYERED, FLOWS, VERDICTS, FEATURES, AS_OF, ALERTS, ROLLED]))


def _with(select: str, *parts: str) -> str:
    chosen = ["packets", *parts]
    return "WITH " + ",".join(_PARTS[p] for p in _ORDER if p in chosen) + select


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    pk = lambda s: _with(s)
    ly = lambda s: _with(s, "layered")
    fl = lambda s: _with(s, "flows")
    vd = lambda s: _with(s, "flows", "verdicts")
    fe = lambda s: _with(s, "flows", "verdicts", "features")
    al = lambda s: _with(s, "flows", "verdicts", "alerts")
    ro = lambda s: _with(s, "flows", "verdicts", "alerts", "rolled")
    st = lambda s: _with(s, "flows", "verdicts")

    n_flags = "CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END"
    q["src1"] = pk(f"""SELECT CASE protocol WHEN 'ARP' THEN 'BAD' ELSE protocol END AS protocol, count(*) AS n,
        CASE WHEN protocol <> 'ARP' THEN CAST(sum(length) AS BIGINT) ELSE 0 END AS total_length,
        CASE WHEN protocol <> 'ARP' THEN CAST(sum({n_flags}) AS BIGINT) ELSE 0 END AS n_flags FROM p GROUP BY protocol""")
    q["src2"] = pk("SELECT packet_id, timestamp, protocol FROM p ORDER BY timestamp, packet_id LIMIT 500")
    label = "CASE WHEN cust % 5 = 0 THEN 1.0 WHEN cust % 5 = 1 THEN 0.5 ELSE 0.0 END"
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.FEATURES)
    q["src3"] = fe(f"""SELECT {doubles}, CAST(label AS DOUBLE) AS label
        FROM x JOIN (SELECT DISTINCT remote AS source, {label} AS label FROM conv) USING (source)""")
    names = ", ".join(f"({p}, {str(t).lower()}, {str(u).lower()}, {str(s).lower()}, '{n}')" for p, t, u, s, n in C.PORT_NAMES)
    q["src4"] = pk(f"""SELECT c.port, c.n, coalesce(i.tcp, false) AS port_tcp, coalesce(i.udp, false) AS port_udp,
        coalesce(i.sctp, false) AS port_sctp, coalesce(i.description, '') AS port_description
        FROM (SELECT destination_port AS port, count(*) AS n FROM p GROUP BY ALL) c
        LEFT JOIN (VALUES {names}) AS i(port, tcp, udp, sctp, description) ON i.port = c.port""")
    q["snk1"] = pk("""SELECT CAST(year(make_timestamp(timestamp)) AS INTEGER) AS year, count(*) AS n,
        CAST(sum(length) AS BIGINT) AS total_length FROM p GROUP BY ALL""")
    q["snk2"] = pk("SELECT protocol, count(*) AS n, count(DISTINCT packet_id) AS n_ids FROM p GROUP BY protocol")
    q["snk3"] = vd("SELECT source, flow_key, l4_key, port, n_packets, verdict, verdict_ts FROM h")
    q["snk4"] = al("SELECT scan_type, attack_type, count(*) AS n, max(time) AS latest FROM a GROUP BY ALL")
    quote = lambda c: f"'\"' || {c} || '\"'"
    flags_json = "'[' || CASE WHEN flags = '' THEN '' ELSE '\"' || replace(flags, ',', '\",\"') || '\"' END || ']'"
    info_json = ("CASE WHEN protocol = 'TCP' THEN '{\"SEQ\":\"' || seq || '\",\"ACK\":\"' || ack || '\",\"WIN\":\"' || win"
                 " || '\",\"HEADER_LENGTH\":\"' || header || '\",\"CHECKSUM_CORRECT\":\"' || checksum || '\"}' ELSE '{}' END")
    q["snk5"] = pk(f"""SELECT '{{"packet_id":' || packet_id || ',"timestamp":' || timestamp || ',"protocol":' ||
        {quote('protocol')} || ',"source_address":' || {quote('source_address')} || ',"source_port":' || source_port ||
        ',"info":' || {info_json} || ',"flags":' || {flags_json} || ',"length":' || length || '}}' AS json FROM p""")
    q["snk5_history"] = vd(f"""SELECT '{{"source":' || {quote('source')} || ',"flow_key":' || flow_key || ',"port":' || port
        || ',"n_packets":' || n_packets || ',"verdict":' || {quote('verdict')} || '}}' AS json FROM h""")
    q["snk5_alert"] = al(f"""SELECT '{{"attacker":' || {quote('attacker')} || ',"scan_type":' || {quote('scan_type')} ||
        ',"attack_type":' || {quote('attack_type')} || ',"tools":["' || replace(tools, ',', '","') || '"],"port":' ||
        port || '}}' AS json FROM a""")

    # normalisation
    q["nrm1"] = ly("SELECT packet_id, protocol FROM lk")
    q["nrm2"] = ly("SELECT packet_id, src AS source_address, dst AS destination_address FROM lk")
    q["nrm3"] = ly("SELECT packet_id, direction FROM lk")
    q["nrm4"] = ly("""SELECT packet_id, seq, ack, win, '1' AS win_scale, checksum AS checksum_correct,
        header AS header_length, flags, length FROM lk WHERE protocol = 'TCP'""")
    q["nrm5"] = ly("""SELECT packet_id, src AS source_address, dst AS destination_address, sport AS source_port,
        dport AS destination_port, length FROM lk WHERE protocol = 'UDP'""")
    q["nrm6"] = ly("SELECT packet_id, flags, -1 AS source_port, l4_key, length FROM lk WHERE protocol = 'ICMP'")
    q["nrm7"] = ly("""SELECT packet_id, flags, sport AS source_port,
        CASE WHEN flags = 'DATA' THEN 16 ELSE length + 34 END AS length FROM lk WHERE protocol = 'SCTP'""")
    q["nrm8"] = ly("""SELECT packet_id, src AS source_address, -1 AS source_port, l4_key, length + 34 AS length
        FROM lk WHERE protocol = 'ARP'""")
    q["nrm9"] = ly("SELECT packet_id, src AS source_address, l4_key, length + 34 AS length FROM lk WHERE protocol = 'IPv4'")
    q["nrm10"] = ly(f"SELECT packet_id FROM lay0 WHERE dst IN {_MULTICAST} AND protocol <> 'ARP'")
    q["nrm10_networks"] = ly("SELECT packet_id FROM lay0 WHERE CAST(split_part(dst, '.', 1) AS INTEGER) BETWEEN 224 AND 239 AND protocol <> 'ARP'")
    q["nrm11"] = ly("SELECT packet_id, l4_key FROM lk")
    q["nrm12"] = ly("SELECT packet_id, pair_key FROM lk")
    q["nrm13"] = ly(f"SELECT packet_id, {_KEYS} FROM lk")
    q["nrm14"] = pk("SELECT packet_id, replace(flags, ',', '') AS text FROM p")
    q["nrm15"] = pk("SELECT DISTINCT source_address AS address FROM p")
    q["nrm16"] = pk("""SELECT packet_id, CASE WHEN protocol = 'TCP' THEN 'Flags=' ||
        CASE WHEN flags = '' THEN '' ELSE replace(flags, ',', ' ,') || ' ' END || 'WIN SCALE=undefined WIN=' || win ||
        ' SEQ=' || seq || ' HEADER LENGTH=' || header ELSE '' END AS text FROM p""")

    # filters
    q["flt1"] = ly(f"SELECT packet_id FROM lk WHERE src = '{T.HOST}' OR dst = '{T.HOST}'")
    q["flt2"] = pk("SELECT packet_id FROM p WHERE remote NOT IN (SELECT source FROM pot)")
    q["flt2_list"] = pk(f"SELECT packet_id FROM p WHERE remote NOT IN ('{C.ONE_SOURCE}', '10.0.0.6')")
    q["flt2_networks"] = pk(f"""SELECT packet_id FROM p WHERE {_number('remote')} NOT BETWEEN {_ip(10, 0, 1, 0)} AND {_ip(10, 0, 1, 15)}
        AND {_number('remote')} NOT BETWEEN {_ip(10, 0, 4, 0)} AND {_ip(10, 0, 4, 127)} AND remote <> '10.0.5.9'""")
    q["flt2_network_table"] = pk(f"""SELECT packet_id FROM p
        WHERE {_number('remote')} // 4 NOT IN (SELECT {_number('source')} // 4 FROM pot)""")
    found = (f"FROM p WHERE protocol IN ('TCP', 'UDP') AND regexp_matches(source_address, '{C.SEARCH['source']}') "
             f"AND destination_port = {C.SEARCH['destination_port']}")
    q["flt3"] = pk(f"SELECT packet_id, protocol, source_address {found}")
    q["flt3_layout"] = q["flt3"]
    q["flt4"] = pk(f"SELECT packet_id, timestamp {found} ORDER BY timestamp, packet_id LIMIT 20 OFFSET 40")
    q["flt5"] = pk(f"SELECT count(*) AS n_packets, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages {found}")
    q["flt6"] = vd("SELECT packet_id FROM p SEMI JOIN (SELECT * FROM v WHERE verdict = 'PortClosed') w "
                   "ON p.flow_key = w.flow_key AND p.l4_key = w.l4_key")
    q["flt7"] = pk("""SELECT packet_id FROM p WHERE protocol = 'ICMP'
        AND flow_key IN (SELECT flow_key FROM p WHERE protocol = 'UDP')""")
    q["flt8"] = pk("""SELECT flow_key, l4_key FROM p GROUP BY flow_key, l4_key, pair_key
        HAVING bool_or(direction = 'INCOME') AND bool_or(direction = 'OUTCOME')""")
    q["flt9"] = pk("""SELECT flow_key FROM p GROUP BY flow_key
        HAVING bool_or(protocol = 'UDP') AND bool_or(protocol = 'ICMP')""")
    q["flt10"] = vd(f"SELECT source, flow_key, verdict FROM h WHERE source = '{C.ONE_SOURCE}'")
    q["flt11"] = vd(f"SELECT source, flow_key, verdict FROM h WHERE source = '{C.ONE_SOURCE}' AND verdict = 'PortClosed'")
    q["flt12"] = vd("SELECT source, flow_key, verdict FROM h WHERE verdict = 'SendData'")
    q["flt13"] = al(f"SELECT attacker, flow_key, port FROM a WHERE attacker = '{C.ONE_SOURCE}' AND attack_type = 'TCP SYN'")
    q["flt14"] = al(f"SELECT attacker, flow_key, time FROM a WHERE time > {C.AFTER}")

    # packet predicates
    has = lambda name: f"list_contains(string_split(flags, ','), '{name}')"
    tests = {
        "prd1": {"hit": "flags = 'ACK'"}, "prd2": {"hit": "flags = 'RST'"},
        "prd3": {n.lower(): f"protocol = '{n}'" for n in (V.TCP, V.UDP, V.SCTP, V.IPV4, V.IPV6, V.ICMP)},
        "prd4": {"incoming": "direction = 'INCOME'", "outgoing": "direction = 'OUTCOME'"},
        "prd5": {"hit": "flags IN ('FIN,ACK', 'ACK,FIN')"}, "prd6": {"syn": has("SYN"), "ack": has("ACK")},
        "prd7": {"syn": "flags = 'SYN'", "fin": "flags = 'FIN'"},
        "prd8": {"hit": f"protocol = 'SCTP' AND {has('INIT')}"}, "prd9": {"hit": "flags = 'SYN,ACK'"},
        "prd10": {"hit": "flags = 'RST,ACK'"}, "prd11": {"hit": "protocol = 'SCTP' AND flags LIKE 'ABORT%'"},
        "prd12": {"hit": "flags LIKE 'DESTINATION_UNREACHABLE,%,3'"},
        "prd13": {"hit": "flags IN ('PSH,ACK', 'ACK,PSH')"},
        "prd14": {"correct": "coalesce(checksum = 'true', false)", "wrong": "coalesce(checksum <> 'true', true)"},
        "prd15": {"hit": f"len(string_split(flags, ',')) = 3 AND {has('FIN')} AND {has('PSH')} AND {has('URG')}"},
        "prd16": {"data": f"protocol = 'SCTP' AND {has('DATA')}", "shutdown": f"protocol = 'SCTP' AND {has('SHUTDOWN')}"},
        "prd17": {"internet": f"protocol IN {_in(V.INTERNET_PROTOCOLS)}",
                  "connection": f"protocol IN {_in(V.CONNECTION_PROTOCOLS)}",
                  "transport": f"protocol IN {_in(V.TRANSPORT_PROTOCOLS)}"},
    }
    for name, columns in tests.items():
        q[name] = pk("SELECT packet_id, " + ", ".join(f"{test} AS \"{c}\"" for c, test in columns.items()) + " FROM p")

    # flows
    q["flw1"] = fl(f"SELECT {_KEYS}, n AS n_packets, first_ts, last_ts, f_id AS first_id, l_id AS last_id, CASE WHEN n <= 4 THEN path END AS short_path FROM f")
    q["flw1_positions"] = pk(f"""SELECT packet_id, row_number() OVER (PARTITION BY {_KEYS} ORDER BY timestamp, packet_id)
        AS pos FROM p""")
    q["flw2"] = pk("""SELECT flow_key, l4_key, count(*) AS n_packets, min(timestamp) AS first_ts, max(timestamp) AS last_ts
        FROM p GROUP BY flow_key, l4_key""")
    q["flw3"] = fl("SELECT flow_key, l4_key, protocol FROM f")
    q["flw4"] = fl("SELECT packet_id, l4_key FROM m0 WHERE guest")
    q["flw4_crowded"] = pk("""SELECT l4_key, pair_key, count(*) AS n_packets, arg_min(packet_id, (timestamp, packet_id)) AS first_id,
        arg_max(packet_id, (timestamp, packet_id)) AS last_id,
        coalesce(bool_or(income AND protocol = 'UDP' AND next_icmp), false) AS pair_unreachable,
        bool_or(income AND length > 0 AND protocol IN ('UDP', 'ICMP', 'TCP')) AS saw_in_payload
        FROM (SELECT *, direction = 'INCOME' AS income,
            lead(protocol = 'ICMP' AND direction = 'OUTCOME') OVER (PARTITION BY l4_key, pair_key ORDER BY timestamp, packet_id) AS next_icmp,
            first(protocol) OVER (PARTITION BY l4_key, pair_key ORDER BY guest, timestamp, packet_id) AS own_protocol
          FROM (SELECT packet_id, timestamp, protocol, direction, length, l4_key, pair_key, false AS guest FROM p
            UNION ALL SELECT packet_id, timestamp, protocol, direction, length, u.l4_key, p.pair_key, true AS guest FROM p
            JOIN (SELECT DISTINCT l4_key, pair_key FROM p WHERE protocol = 'UDP') u ON p.pair_key = u.pair_key WHERE protocol = 'ICMP'))
        WHERE own_protocol = 'UDP' GROUP BY l4_key, pair_key""")
    q["flw5"] = pk("""SELECT packet_id, 'ICMP' AS l4_key FROM p WHERE protocol = 'UDP' AND (flow_key, pair_key) IN
        (SELECT (flow_key, pair_key) FROM p WHERE protocol = 'ICMP')""")
    q["flw6"] = fl("SELECT flow_key, l4_key, n AS n_packets, CASE WHEN n <= 4 THEN path END AS short_path FROM f")
    q["flw7"] = fl("SELECT flow_key, l4_key, remote FROM f")
    q["flw8"] = fl("SELECT flow_key, l4_key, host_port FROM f")
    q["flw9"] = fl("SELECT flow_key, l4_key, gap FROM f")
    q["flw10"] = fl("SELECT flow_key, l4_key, in_id AS packet_id, in_addr AS address, in_port AS port FROM f WHERE any_in")
    own_path = f"""(SELECT string_agg({_LETTER}, '' ORDER BY rn) AS path, count(*) AS n FROM m
        WHERE NOT guest GROUP BY {_KEYS})"""
    q["flw11"] = fl(" UNION ALL ".join(
        f"""SELECT substr(path, CAST(i AS INTEGER), {n}) AS run, count(*) AS n_runs, {n} AS n
        FROM (SELECT path, n, unnest(range(1, n + 1)) AS i FROM {own_path}) WHERE i + {n} - 1 <= n GROUP BY 1"""
        for n in (2, 3, 4)))
    for i in range(1, 20):
        q[f"seq{i}"] = fl(f"SELECT flow_key, l4_key FROM f WHERE q{i}")

    # verdicts
    q["vrd1"] = vd("SELECT flow_key, l4_key, verdict FROM v")
    q["vrd1_reference"] = fl(f"SELECT flow_key, l4_key, {_verdict(literal=True)} AS verdict FROM f")
    q["vrd1_honeypot"] = fl(f"SELECT flow_key, l4_key, {_verdict(honeypot=True)} AS verdict FROM f")
    scored = f"verdict IN {_SCAN}"
    q["vrd2"] = vd(f"""SELECT verdict, verdict IN {_in(V.HISTORY_LABELS)} AS writes_history, {scored} AS is_scored,
        verdict IN ('RemoveFinePackets', 'InitializingRemoveFinePackets') AS evicts_flow,
        verdict IN {_in([*V.DIRECT_ATTACKS, V.NETWORK_ALERT])} AS alerts_at_once, count(*) AS n FROM v GROUP BY ALL""")
    q["vrd3"] = vd(f"""SELECT verdict, count(*) AS n, 'default' AS mode FROM v GROUP BY verdict UNION ALL
        SELECT CASE WHEN verdict IN {_in(V.SUSPICIOUS_FLAGS)} THEN 'ContinueIteration' ELSE verdict END, count(*),
        'literal' FROM v GROUP BY 1""")
    q["vrd4"] = vd("SELECT flow_key, l4_key FROM v WHERE verdict NOT IN ('RemoveFinePackets', 'InitializingRemoveFinePackets')")
    q["vrd5"] = fl("SELECT protocol, 'NetworkScanAlert' AS verdict, count(*) AS n FROM f GROUP BY protocol")
    q["his1"] = vd(f"SELECT source, {_KEYS}, port, n_packets, verdict, verdict_ts FROM h")

    # features
    for name, columns in {
        "fea1": "host_initiated", "fea2": "data_transfer", "fea3": "closed_after_open",
        "fea4": "closed_ports, threshold_class", "fea5": "used_ports, neighbour_factor",
        "fea6": "open_ports, open_packets, open_port_factor", "fea7": "closed_port_score", "fea9": doubles,
    }.items():
        q[name] = fe(f"SELECT source, {columns} FROM x")
    q["fea8"] = vd(f"""SELECT source, count(*) FILTER (WHERE verdict IN {_OPEN}) AS n_open,
        count(*) FILTER (WHERE verdict IN {_CLOSED}) AS n_closed, count(*) FILTER (WHERE {scored}) AS n_port_scan
        FROM h GROUP BY source""")
    q["fea10"] = _with(f"SELECT source, flow_key, verdict, {doubles} FROM (SELECT *, {_features('port_pairs')} FROM ex)",
                       "flows", "verdicts", "as_of")

    # model
    score = "CAST(trunc(closed_ports / 8.0 * 100) AS INTEGER)"
    sc = "coalesce(CASE WHEN closed_ports > 0 THEN " + score + " END, 0)"
    labelled = f"(SELECT CAST(label AS DOUBLE) AS label FROM x JOIN (SELECT DISTINCT remote AS source, {label} AS label FROM conv) USING (source))"
    q["mod1"] = fe(f"SELECT label, count(*) AS n, true AS right_side FROM {labelled} GROUP BY label")
    q["mod2"] = fe("""SELECT part, metric, true AS within FROM (VALUES ('train'), ('held_out')) AS p(part),
        (VALUES ('rmse'), ('mae'), ('r2')) AS m(metric)""")
    q["mod3"] = fe(f"SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS place FROM (SELECT DISTINCT label FROM {labelled})")
    q["mod4"] = fe(f"SELECT source, {score} AS score FROM x WHERE closed_ports > 0")
    q["mod5"] = fe(f"SELECT source, {sc} AS score FROM x")
    promoted = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in V.PROMOTION.items()) + " END"
    q["mod6"] = fe(f"""SELECT source, flow_key, CASE WHEN {sc} >= 50 THEN {promoted} ELSE 'ContinueIteration' END AS outcome,
        least({sc}, 100) AS chance FROM (SELECT * FROM h WHERE {scored}) JOIN x USING (source)""")
    q["mod7"] = vd(f"SELECT verdict, {promoted} AS alert_kind, count(*) AS n FROM v GROUP BY ALL")
    named = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in V.SUSPICIOUS_ATTACK_TYPE.items()) + " END"
    q["mod8"] = vd(f"SELECT verdict, {named} AS attack_type, count(*) AS n FROM v GROUP BY ALL")

    # alerts
    shown = "time, scan_type, attack_type, attacker, tools, port, chance, flow_key"
    q["alr1"] = al(f"SELECT {shown} FROM direct")
    q["alr2"] = al(f"SELECT {shown} FROM scan")
    q["alr2_scored"] = _with(f"""SELECT time, scan_type, attack_type, attacker, tools, port, chance, flow_key FROM (
          SELECT scan.* REPLACE (CAST(least({sc}, 100) AS DOUBLE) AS chance) FROM scan
          JOIN x ON x.source = scan.attacker WHERE {sc} >= 50
          UNION ALL
          SELECT last_ts AS time, 'PORT SCAN' AS scan_type, {named} AS attack_type, in_addr AS attacker, in_port AS port,
            CAST(100 AS DOUBLE) AS chance, {_KEYS},
            CASE WHEN verdict = 'SuspiciousFinScanAttack' THEN 'UNKNOWN' ELSE 'NMAP' END AS tools
          FROM v JOIN x ON x.source = v.remote
          WHERE verdict IN {_in(V.SUSPICIOUS_FLAGS)} AND {sc} >= 50)""", "flows", "verdicts", "features", "alerts")
    q["alr3"] = al(f"SELECT {shown} FROM net WHERE verdict = 'NetworkScanAlert'")
    q["alr4"] = fl("SELECT flow_key, technique AS attack_type FROM f WHERE tcp")
    q["alr5"] = fl(f"SELECT flow_key, {_TCP_TOOLS} AS tools FROM f WHERE tcp")
    q["alr6"] = fl(f"SELECT flow_key, l4_key, {_LEN_TOOLS} AS tools FROM f WHERE protocol IN ('UDP', 'ICMP')")
    q["alr7"] = al("SELECT attack_type, tools, count(*) AS n FROM direct GROUP BY ALL")
    as_list = "coalesce(string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) {}, '')"
    q["alr8"] = al(f"""SELECT source, {as_list.format("FILTER (WHERE scanned)")} AS scan_ports,
        {as_list.format("")} AS scan_and_data_ports FROM ports GROUP BY source""")
    q["alr9"] = al("""SELECT time, scan_type, attack_type, attacker, '' AS description, tools,
          string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) AS scanned_ports, chance, false AS read
        FROM (SELECT time, scan_type, attack_type, attacker, tools, chance, flow_key, port FROM a
              UNION SELECT a.time, a.scan_type, a.attack_type, a.attacker, a.tools, a.chance, a.flow_key, ports.port
              FROM a JOIN ports ON ports.source = a.attacker WHERE ports.scanned OR a.attack_type = 'UDP')
        GROUP BY time, scan_type, attack_type, attacker, tools, chance, flow_key""")
    q["hpt1"] = vd("SELECT source, flow_key, verdict FROM h WHERE source IN (SELECT source FROM pot)")
    q["hpt1_networks"] = vd(f"""SELECT h.source, flow_key, verdict, arg_min(network, (-bits, network)) AS network
        FROM (SELECT *, row_number() OVER () AS rn FROM h) h JOIN (
            SELECT DISTINCT source AS network, 32 AS bits, source FROM pot
            UNION ALL SELECT DISTINCT source || '/29', 29, source FROM pot
            UNION ALL SELECT DISTINCT regexp_replace(source, '[.][0-9]+$', '.0/24'), 24, source FROM pot) w
        ON {_number('h.source')} >> (32 - bits) = {_number('w.source')} >> (32 - bits)
        GROUP BY h.source, flow_key, verdict, rn""")
    q["hpt2"] = al(f"SELECT {shown} FROM net WHERE q19 AND remote IN (SELECT source FROM pot)")

    # reports
    q["rpt1"] = ro("""SELECT time, scan_type, attack_type, attacker, tools, scanned_ports, chance, false AS read, n_alerts
        FROM rr""")
    both = "CASE WHEN {} AND attack_type IN ('TCP SYN', 'TCP CONNECT') THEN 'TCP SYN, TCP CONNECT' ELSE attack_type END"
    q["rpt2"] = ro(" UNION ALL ".join(
        f"""SELECT attacker, scan_type, {both.format(flag)} AS attack_type, CAST(sum(n) AS BIGINT) AS n_alerts,
        '{scope}' AS scope FROM lab GROUP BY 1, 2, 3""" for flag, scope in (("own", "attacker"), ("anywhere", "global"))))
    q["rpt3"] = al("""SELECT attacker, attack_type, flow_key FROM a
        WHERE NOT (attack_type IN ('TCP SYN', 'TCP CONNECT') AND attacker IN (SELECT source FROM pot))""")
    q["rpt4"] = al(f"""SELECT attacker, attack_type, flow_key FROM a
        WHERE NOT (attack_type = 'TCP SYN' AND attacker = '{C.ONE_SOURCE}')""")
    q["rpt5"] = al(f"SELECT attacker, flow_key, time < {C.READ_BEFORE} AS read FROM a")
    fine = "verdict IN ('RemoveFinePackets', 'InitializingRemoveFinePackets')"
    kept = f"(SELECT ({_KEYS}) FROM v WHERE NOT {fine})"
    q["rpt6"] = vd(f"SELECT count(*) AS captured, count(*) FILTER (WHERE ({_KEYS}) IN {kept}) AS analysed FROM p")
    q["rpt7"] = ro("SELECT attacker, scan_type, attack_type, first_ports, n_ports FROM rr")
    q["rpt8"] = vd("SELECT source, flow_key, verdict FROM h WHERE false")
    q["rpt9"] = vd(f"SELECT packet_id FROM p WHERE ({_KEYS}) NOT IN (SELECT ({_KEYS}) FROM v WHERE {fine})")
    q["rpt9_ids"] = pk("SELECT packet_id FROM p WHERE protocol <> 'ICMP'")
    q["closed_port_probers"] = fe("""SELECT source, closed_ports, threshold_class, closed_port_score FROM x
        WHERE closed_ports > 0""")

    # streams
    q["str1"] = st("SELECT verdict, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_packets FROM v GROUP BY verdict")
    q["str2"] = st(f"SELECT {_KEYS}, n AS n_packets, CASE WHEN n <= 4 THEN path END AS short_path, first_ts, last_ts FROM v")
    q["str3"] = st(f"SELECT {_KEYS}, CAST(1 AS BIGINT) AS n_sessions FROM v")
    q["str4"] = st(f"""SELECT remote AS source, flow_key, l4_key, host_port AS port, n AS n_packets, verdict
        FROM v WHERE verdict IN {_in(V.HISTORY_LABELS)}""")
    q["str2_evicted"] = st(f"""SELECT {_KEYS}, n AS n_packets, n_stored FROM v JOIN (
          SELECT p.flow_key, count(*) AS n_stored FROM p JOIN v w ON p.flow_key = w.flow_key AND p.l4_key = w.l4_key
          WHERE w.verdict NOT IN ('RemoveFinePackets', 'InitializingRemoveFinePackets') GROUP BY 1) USING (flow_key)
        WHERE verdict NOT IN ('RemoveFinePackets', 'InitializingRemoveFinePackets')""")
    by_class = "least(threshold_class * 25, 100)"
    stated = _with(f"""SELECT {shown} FROM direct
        UNION ALL SELECT {shown} FROM (
          SELECT scan.* REPLACE (CAST({by_class} AS DOUBLE) AS chance) FROM scan
          JOIN x ON x.source = scan.attacker WHERE {by_class} >= 50)
        UNION ALL SELECT {shown} FROM (
          SELECT last_ts AS time, 'PORT SCAN' AS scan_type, {named} AS attack_type, in_addr AS attacker, in_port AS port,
            CAST(100 AS DOUBLE) AS chance, {_KEYS},
            CASE WHEN verdict = 'SuspiciousFinScanAttack' THEN 'UNKNOWN' ELSE 'NMAP' END AS tools
          FROM v JOIN x ON x.source = v.remote
          WHERE verdict IN {_in(V.SUSPICIOUS_FLAGS)} AND {by_class} >= 50)""", "flows", "verdicts", "features", "alerts")
    q["str4_alerts_stated"] = stated
    q["detect_alerts_stated"] = stated
    q["str5"] = _with(f"""SELECT {shown} FROM net WHERE q19 AND remote IN (SELECT source FROM pot)""",
                     "flows", "verdicts", "alerts")
    return q
