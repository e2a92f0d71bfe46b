"""Literal packets: `>` incoming, `<` outgoing, flags after it."""

from flowwatch.schema import PACKET

HOST, REMOTE = "192.168.1.4", "10.9.9.9"


def packet(pid, flow, text, protocol="TCP", ts=None, remote=REMOTE, host_port=80, **changed):
    way, flags = text[0], [f for f in text[1:].split(",") if f]
    incoming = way == ">"
    ported = protocol in ("TCP", "UDP", "SCTP")
    ports = (41000, host_port) if ported else (-1, -1)
    info = {}
    if protocol == "TCP":
        info = {"SEQ": "1", "ACK": "0", "WIN": "1024", "HEADER_LENGTH": "20", "CHECKSUM_CORRECT": "true"}
        info.update({k: str(v) for k, v in changed.items() if k in info})
    l4 = "ICMP" if protocol == "ICMP" else ("%05d%05d" % ports if ported else "NONE")
    return (
        pid, pid * 200 if ts is None else ts, protocol,
        remote if incoming else HOST, ports[0] if incoming else ports[1],
        HOST if incoming else remote, ports[1] if incoming else ports[0],
        info, flags, flow, l4, f"{remote}~{HOST}", "INCOME" if incoming else "OUTCOME", changed.get("length", 0),
    )


def table(spark, rows):
    return spark.createDataFrame(rows, PACKET)


def flow(flow_key, *packets, protocol="TCP", **common):
    """Packets of one flow; each is a text or (text, changes)."""
    rows = []
    for i, p in enumerate(packets):
        text, changed = p if isinstance(p, tuple) else (p, {})
        rows.append(packet(flow_key * 1000 + i, flow_key, text, **{"protocol": protocol, **common, **changed}))
    return rows
