"""Seven features per source from the verdict history.

`port_facts` or `port_marks` first reduces the history to one row per (source, port), combined
before the shuffle, so a source is at most 65 537 rows in every later step.
`snapshot` gives features over all history, `as_of` at each scored verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.functions import scores as SC
from flowwatch.operators import skew
from flowwatch.rules import Rules
from flowwatch.schema import FEATURES

_WHEN = ["verdict_ts", "flow_key", "l4_key", "pair_key"]  # unique order of a source's verdicts
SCORED = V.PORT_SCAN_LABELS


def _sent_labels(rules: Rules) -> list[str]:
    return V.SENT_DATA_LABELS + ([V.INIT_AND_DATA] if rules.count_host_data else [])


def _is(labels: list[str]) -> Column:
    return F.col("verdict").isin(labels)


def _moment() -> Column:
    return F.struct(*_WHEN)


def port_facts(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (source, port): what was seen there and when first."""
    def first(labels):
        return F.min(F.when(_is(labels), _moment()))

    return history.groupBy("source", "port").agg(
        F.min(_moment()).alias("first_seen"),
        first(V.OPEN_PORT_LABELS).alias("first_open"),
        first(V.CLOSED_PORT_LABELS).alias("first_closed"),
        first(V.OPEN_PORT_LABELS + V.CLOSED_PORT_LABELS).alias("first_used"),
        first([V.NO_DATA]).alias("first_no_data"),
        first([V.PORT_CLOSED]).alias("first_port_closed"),
        first(V.INITIATING_LABELS).alias("first_initiating"),
        first(_sent_labels(rules)).alias("first_sent"),
        F.sum(F.when(_is(V.OPEN_PORT_LABELS), F.col("n_packets")).otherwise(0)).alias("open_packets"),
        F.count(F.lit(1)).alias("n_verdicts"),
    )


def port_marks(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (source, port): whether things were seen there. Of their moments only the first
    is kept, which orders the ports; sorting and moving one is most of what all of them cost."""
    def seen(labels):
        return F.coalesce(F.max(_is(labels)), F.lit(False))

    return history.groupBy("source", "port").agg(
        F.min(_moment()).alias("first_seen"),
        seen(V.OPEN_PORT_LABELS).alias("open"),
        seen(V.CLOSED_PORT_LABELS).alias("closed"),
        seen(V.OPEN_PORT_LABELS + V.CLOSED_PORT_LABELS).alias("used"),
        seen([V.NO_DATA]).alias("no_data"),
        seen([V.PORT_CLOSED]).alias("port_closed"),
        seen(V.INITIATING_LABELS).alias("initiating"),
        seen(_sent_labels(rules)).alias("sent"),
        F.sum(F.when(_is(V.OPEN_PORT_LABELS), F.col("n_packets")).otherwise(0)).alias("open_packets"),
        F.count(F.lit(1)).alias("n_verdicts"),
    )


def _with_order(ports: DataFrame) -> DataFrame:
    """Adds what depends on a source's other ports (at most 65 537 rows each).

    closed_after  the moment a PortClosed port follows a DidNotSendData port in
                  order of first appearance.
    pair_moment   the moment both this port and the one below have been used.
    """
    seen = W.partitionBy("source").orderBy("first_seen", "port")
    # only ports in use count as neighbours: unused ones sort apart
    by_port = W.partitionBy("source", F.col("first_used").isNull()).orderBy("port")
    lower_no_data = F.lag("first_no_data").over(seen)
    lower_used = F.lag("first_used").over(by_port)
    neighbour = F.lag("port").over(by_port) == F.col("port") - 1
    return ports.withColumns({
        "_no_data": lower_no_data, "_used": lower_used, "_next_to": F.coalesce(neighbour, F.lit(False)),
    }).withColumns({
        "closed_after": F.when(
            F.col("_no_data").isNotNull() & F.col("first_port_closed").isNotNull(),
            F.greatest("_no_data", "first_port_closed"),
        ),
        "pair_moment": F.when(
            F.col("first_used").isNotNull() & F.col("_next_to"), F.greatest("_used", "first_used")
        ),
    }).drop("_no_data", "_used", "_next_to")


def _named(rules: Rules) -> dict[str, Column]:
    t = rules.closed_port_threshold
    return {
        "host_initiated": F.col("initiated").cast("int"),
        "data_transfer": SC.data_transfer_class(F.col("sent"), F.col("not_sent")),
        "closed_after_open": F.when(F.col("after_open"), 3).otherwise(1),
        "threshold_class": SC.threshold_class(t, F.col("closed_ports")),
        "neighbour_factor": SC.neighbour_factor(F.col("port_pairs"), F.col("used_ports")),
        "open_port_factor": SC.open_port_factor(F.col("open_ports"), F.col("open_packets")),
        "closed_port_score": SC.closed_port_score(t, F.col("closed_ports")),
    }


_COUNTS = ["closed_ports", "open_ports", "used_ports", "port_pairs", "open_packets"]


def snapshot(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per source: counts and the seven features over all its history.

    A port is closed after an open one, or next to a used one, as in `_with_order`; whether
    that ever happened does not depend on when."""
    in_order = W.partitionBy("source").orderBy("first_seen", "port")
    by_port = W.partitionBy("source", "used").orderBy("port")
    after = F.lag("no_data").over(in_order) & F.col("port_closed")
    next_to = F.col("used") & (F.lag("port").over(by_port) == F.col("port") - 1)
    ports = port_marks(history, rules).withColumns({"_after": after, "_next_to": next_to})
    per_source = ports.groupBy("source").agg(
        F.count_if("closed").alias("closed_ports"),
        F.count_if("open").alias("open_ports"),
        F.count_if("used").alias("used_ports"),
        F.count_if("_next_to").alias("port_pairs"),
        F.sum("open_packets").alias("open_packets"),
        (F.count_if("initiating") > 0).alias("initiated"),
        (F.count_if("sent") > 0).alias("sent"),
        (F.count_if("no_data") > 0).alias("not_sent"),
        (F.count_if("_after") > 0).alias("after_open"),
        F.sum("n_verdicts").alias("n_verdicts"),
    )
    return per_source.withColumns(_named(rules)).select("source", "n_verdicts", *_COUNTS, *FEATURES)


def as_of(history: DataFrame, rules: Rules = Rules(), partitions: int | None = None) -> DataFrame:
    """Every scored verdict with its source's features at that moment.

    Booleans compare the moment with the first time the thing happened, one row
    per source. Counts are running sums of marks at those first times, cut into
    range slices, so a source with most of the history is still spread out.
    """
    ports = _with_order(port_facts(history, rules))
    firsts = ports.groupBy("source").agg(
        F.min("first_initiating").alias("_initiated"),
        F.min("first_sent").alias("_sent"),
        F.min("first_no_data").alias("_not_sent"),
        F.min("closed_after").alias("_after_open"),
    )
    marks = ports.select(
        "source",
        F.explode(F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.col(moment).alias("at"))
            for kind, moment in [
                ("closed_ports", "first_closed"), ("open_ports", "first_open"),
                ("used_ports", "first_used"), ("port_pairs", "pair_moment"),
            ]
        ])).alias("m"),
    ).where("m.at IS NOT NULL").groupBy("source", F.col("m.at").alias("at")).agg(*[
        F.count(F.when(F.col("m.kind") == kind, 1)).alias(f"d_{kind}") for kind in _COUNTS[:4]
    ])
    # a mark lies on exactly one verdict row: the one that made it
    marked = skew.join_on(
        history, marks.select("source", *[F.col("at")[c].alias(c) for c in _WHEN], *[f"d_{k}" for k in _COUNTS[:4]]),
        ["source", *_WHEN], "left",
    )
    steps = {k: F.coalesce(f"d_{k}", F.lit(0)) for k in _COUNTS[:4]}
    steps["open_packets"] = F.when(_is(V.OPEN_PORT_LABELS), F.col("n_packets")).otherwise(0)
    running = skew.prefix_sums(marked, ["source"], _WHEN, steps, partitions).drop(*[f"d_{k}" for k in _COUNTS[:4]])
    scored = running.where(_is(SCORED))
    joined = skew.join_on(scored, firsts, ["source"])
    happened = {
        name: F.coalesce(F.col(f"_{name}") <= _moment(), F.lit(False))
        for name in ("initiated", "sent", "not_sent", "after_open")
    }
    return joined.withColumns(happened).withColumns(_named(rules)).select(
        "source", *_WHEN, "port", "verdict", *_COUNTS, *FEATURES
    )


def onto_verdicts(verdict_rows: DataFrame, features: DataFrame) -> DataFrame:
    """Scored verdict rows with the snapshot features of their remote address."""
    waiting = verdict_rows.where(_is(SCORED))
    return skew.lookup(
        waiting, features.withColumnRenamed("source", "remote"), ["remote"]
    )
