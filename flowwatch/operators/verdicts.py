"""The first-match verdict cascade and what follows from a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import patterns as S
from flowwatch.operators import flows as FL
from flowwatch.operators import skew
from flowwatch.rules import SPECIFIC_FIRST, Rules

# verdict -> (history row, scored, evict the flow, alert at once)
FOLLOW_UP = {
    V.INIT_CONNECTION: (True, False, False, False),
    V.SEND_DATA: (True, False, False, False),
    V.SUSPICIOUS_NETWORK: (True, False, False, False),
    V.INIT_AND_DATA: (True, False, False, False),
    V.INIT_FINE: (True, False, True, False),
    V.FINE: (True, False, True, False),
    V.NO_DATA: (True, True, False, False),
    V.PORT_CLOSED: (True, True, False, False),
    V.SUSPICIOUS_FIN: (True, True, False, False),
    V.SUSPICIOUS_ACK_WIN: (True, True, False, False),
    V.SUSPICIOUS_MAIMON: (True, True, False, False),
    V.NULL_SCAN: (False, False, False, True),
    V.ACK_WIN: (False, False, False, True),
    V.XMAS: (False, False, False, True),
    V.MAIMON: (False, False, False, True),
    V.FIN_SCAN: (False, False, False, True),
    V.NETWORK_ALERT: (False, False, False, True),
    V.CONTINUE: (False, False, False, False),
}


def cascade(rules: Rules = Rules()) -> str:
    """The rules in order as one CASE over a flow row; the first match wins."""
    closed = S.closed_rule(rules)
    opened = S.every(S.INITIATED, f"NOT {closed}")
    abandoned = S.every(
        f"NOT {S.DATA_SENT}", closed, S.NOT_FINISHED, S.either(S.LAST_INCOMING, S.LAST_RESET)
    )
    fine = S.every(S.DATA_SENT, closed)
    early = [
        (S.NULL_SCAN, V.NULL_SCAN),
        (S.ack_win_rule(rules), V.ACK_WIN),
        (S.suspicious_ack_win_rule(rules), V.SUSPICIOUS_ACK_WIN),
        (S.XMAS, V.XMAS),
    ]
    specific = [
        (S.maimon_rule(rules), V.MAIMON),
        (S.suspicious_maimon_rule(rules), V.SUSPICIOUS_MAIMON),
        (S.fin_rule(rules), V.FIN_SCAN),
        (S.suspicious_fin_rule(rules), V.SUSPICIOUS_FIN),
    ]
    general = [
        (S.every(opened, S.DATA_SENT), V.INIT_AND_DATA),
        (opened, V.INIT_CONNECTION),
        (S.PORT_CLOSED, V.PORT_CLOSED),
        (abandoned, V.NO_DATA),
        (S.every(fine, S.INITIATED), V.INIT_FINE),
        (fine, V.FINE),
    ]
    order = early + specific + general if rules.rule_order == SPECIFIC_FIRST else early + general + specific
    connected = " ".join(f"WHEN {test} THEN '{verdict}'" for test, verdict in order)
    return f"""CASE WHEN in_honeypot THEN '{V.NETWORK_ALERT}'
        WHEN {S.INTERNET_INCOMING} THEN '{V.SUSPICIOUS_NETWORK}'
        WHEN {S.TCP} OR {S.SCTP} THEN CASE {connected} ELSE '{V.CONTINUE}' END
        WHEN {S.UDP} THEN CASE WHEN {S.UDP_CLOSED} THEN '{V.PORT_CLOSED}'
                               WHEN {S.DATA_SENT} THEN '{V.SEND_DATA}' ELSE '{V.NO_DATA}' END
        ELSE '{V.CONTINUE}' END"""


def flag_honeypot(flow_rows: DataFrame, honeypot: DataFrame | None) -> DataFrame:
    """Adds `in_honeypot`: the remote address is in the honeypot's log."""
    if honeypot is None:
        return flow_rows.withColumn("in_honeypot", F.lit(False))
    listed = honeypot.select(F.col("source").alias("remote")).distinct().withColumn("_listed", F.lit(True))
    joined = skew.lookup(flow_rows, listed, ["remote"], how="left")
    return joined.withColumn("in_honeypot", F.coalesce("_listed", F.lit(False))).drop("_listed")


def classify(
    flow_rows: DataFrame, rules: Rules = Rules(), honeypot: DataFrame | None = None, as_honeypot: bool = False
) -> DataFrame:
    """Flows with a `verdict`. Run as a honeypot, every flow is a network alert."""
    if as_honeypot:
        return flow_rows.withColumn("verdict", F.lit(V.NETWORK_ALERT))
    return flag_honeypot(flow_rows, honeypot).withColumn("verdict", F.expr(cascade(rules)))


def network_alerts(flow_rows: DataFrame, honeypot: DataFrame) -> DataFrame:
    """Flows of remotes that the honeypot has seen, with their verdict. That is the first
    rule of the cascade, so the rest of it is not computed only to be filtered out."""
    return flag_honeypot(flow_rows, honeypot).where("in_honeypot").withColumn("verdict", F.lit(V.NETWORK_ALERT))


def _label_map(position: int) -> Column:
    items = []
    for verdict, effects in FOLLOW_UP.items():
        items += [F.lit(verdict), F.lit(effects[position])]
    return F.create_map(*items)


def follow_up(verdict_rows: DataFrame) -> DataFrame:
    """What the verdict causes, as four booleans."""
    names = ["writes_history", "is_scored", "evicts_flow", "alerts_at_once"]
    return verdict_rows.withColumns({
        name: F.coalesce(F.try_element_at(_label_map(i), F.col("verdict")), F.lit(False))
        for i, name in enumerate(names)
    })


def quiet_period(verdict_rows: DataFrame, packets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Suspicious verdicts become Continue when the flow went on.

    `packets` may hold packets that came in after the verdicts were made. Under
    the literal rule any stored packet of the flow counts, also its own.
    """
    suspicious = verdict_rows.where(F.col("verdict").isin(V.SUSPICIOUS_FLAGS))
    waits = suspicious.select(*FL.KEYS, F.col("last_ts").alias("_until"))
    later = skew.lookup(packets.select(*FL.KEYS, *FL.ORDER), waits, FL.KEYS)
    if rules.quiet_counts_later_only:
        wait = F.col("timestamp") - F.col("_until")
        later = later.where((wait > 0) & (wait <= rules.quiet_us))
    busy = later.groupBy(*FL.KEYS, F.col("_until").alias("last_ts")).agg(F.count(F.lit(1)).alias("_more"))
    joined = verdict_rows.join(busy, [*FL.KEYS, "last_ts"], "left")
    went_on = F.col("verdict").isin(V.SUSPICIOUS_FLAGS) & F.col("_more").isNotNull()
    return joined.withColumn("verdict", F.when(went_on, V.CONTINUE).otherwise(F.col("verdict"))).drop("_more")


def retained(verdict_rows: DataFrame) -> DataFrame:
    """Flows whose packets stay stored: all but the fine ones."""
    return verdict_rows.where(~F.col("verdict").isin(V.FINE, V.INIT_FINE))


def narrow(verdict_rows: DataFrame) -> DataFrame:
    """Verdict rows as they are stored: of their packets what history, features and alerts read.

    The five packets of a flow are most of its bytes and, written, most of a store's time."""
    first, first_in = F.col("first"), F.col("first_in")
    kept = ["timestamp", "packet_id", "protocol", "header_length", "win", "length"]
    return verdict_rows.drop("own_first", "last", "first_out").withColumns({
        "first": F.struct(*[first[c].alias(c) for c in kept]),
        "first_in": F.when(first_in.isNotNull(), F.struct(first_in["protocol"].alias("protocol"))),
    })


def history(verdict_rows: DataFrame) -> DataFrame:
    """Verdict log rows."""
    return verdict_rows.where(F.col("verdict").isin(V.HISTORY_LABELS)).select(
        F.col("remote").alias("source"),
        "flow_key",
        "l4_key",
        "pair_key",
        F.col("host_port").alias("port"),
        "n_packets",
        "verdict",
        F.col("last_ts").alias("verdict_ts"),
    )
