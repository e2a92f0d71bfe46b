"""From packets to alerts in one declared plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.operators import alerts as AL
from flowwatch.operators import features as FE
from flowwatch.operators import flows as FL
from flowwatch.operators import model as MO
from flowwatch.operators import verdicts as VD
from flowwatch.rules import Rules
from flowwatch.schema import FEATURES
from flowwatch.session import scratch_path


@dataclass(frozen=True)
class Detection:
    verdicts: DataFrame
    history: DataFrame
    decided: DataFrame  # scored verdict rows with score, outcome and chance
    alerts: DataFrame   # without port lists, see `alerts.build` and `reports.roll_up`


def verdicts(
    packets: DataFrame, rules: Rules = Rules(), honeypot: DataFrame | None = None, hot: str = "auto",
    gap_us: int | None = None,
) -> DataFrame:
    return VD.classify(FL.assemble(packets, rules, hot=hot, gap_us=gap_us), rules, honeypot)


def decide(
    verdict_rows: DataFrame, model: PipelineModel, rules: Rules = Rules(), as_of: bool = False
) -> DataFrame:
    """Scored verdict rows with their source's features, score, outcome and chance."""
    history = VD.history(verdict_rows)
    if as_of:
        keys = [*FL.KEYS, "last_ts"]
        features = FE.as_of(history, rules).withColumnRenamed("verdict_ts", "last_ts").select(*keys, *FEATURES)
        waiting = verdict_rows.where(F.col("verdict").isin(V.PORT_SCAN_LABELS)).join(features, keys)
    else:
        waiting = FE.onto_verdicts(verdict_rows, FE.snapshot(history, rules).select("source", *FEATURES))
    return MO.decide(MO.score(waiting, model), rules)


def detect(
    packets: DataFrame, model: PipelineModel, rules: Rules = Rules(), honeypot: DataFrame | None = None,
    as_of: bool = False, hot: str = "auto", later_packets: DataFrame | None = None,
) -> Detection:
    """Verdicts, history, scores and alerts of a packet table.

    The verdict rows feed the features, the scored rows and the direct alerts.
    They are written once, below the shared folder, so that flows are assembled
    once and not three times, without the packets that none of these reads.

    `later_packets` are packets that came in after this table was cut; suspicious
    verdicts of flows that went on are then left open.
    """
    spark = packets.sparkSession
    path = scratch_path(spark, "verdicts")
    VD.narrow(verdicts(packets, rules, honeypot, hot)).write.parquet(path)
    verdict_rows = spark.read.parquet(path)
    if later_packets is not None:
        verdict_rows = VD.quiet_period(verdict_rows, later_packets, rules)
    decided = decide(verdict_rows, model, rules, as_of)
    found = AL.direct(verdict_rows, rules).unionByName(AL.scored(decided, rules))
    return Detection(verdict_rows, VD.history(verdict_rows), decided, found)


def closed_port_probers(packets: DataFrame, rules: Rules = Rules(), hot: str = "auto") -> DataFrame:
    """Which remote hosts probed closed ports, how many, and is that beyond the threshold?"""
    path = scratch_path(packets.sparkSession, "history")
    VD.history(verdicts(packets, rules, hot=hot)).write.parquet(path)
    history = packets.sparkSession.read.parquet(path)
    return FE.snapshot(history, rules).where("closed_ports > 0").select(
        "source", "closed_ports", "threshold_class", F.round("closed_port_score", 9).alias("closed_port_score")
    )
