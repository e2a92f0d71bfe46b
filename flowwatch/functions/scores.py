"""Scores and class functions of the feature and decision steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.rules import Rules


def literal_map(items: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def closed_port_score(threshold: int | Column, closed_ports: Column) -> Column:
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    beyond = (F.log2((closed_ports - (t - 1)).cast("double")) - 1) / 10
    return F.when(closed_ports <= t, F.lit(0.0)).otherwise(beyond)


def threshold_class(threshold: int, closed_ports: Column) -> Column:
    """1 under, 2 at, 3 beyond the threshold."""
    return F.when(closed_ports < threshold, 1).when(closed_ports == threshold, 2).otherwise(3)


def data_transfer_class(sent: Column, not_sent: Column) -> Column:
    return F.when(sent & not_sent, 2).when(sent, 1).otherwise(3)


def open_port_factor(open_ports: Column, open_packets: Column) -> Column:
    return F.when(open_packets == 0, F.lit(0.0)).otherwise(
        2 * open_ports.cast("double") / F.when(open_packets == 0, None).otherwise(open_packets).cast("double")
    )


def neighbour_factor(pairs: Column, ports: Column) -> Column:
    return F.when(ports <= 1, F.lit(0.0)).otherwise(
        pairs.cast("double") / F.when(ports == 0, None).otherwise(ports).cast("double")
    )


def percentage(prediction: Column) -> Column:
    """Truncated percentage of a prediction."""
    return (prediction * 100).cast("int")


def score_or_zero(score: Column) -> Column:
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(None).cast("double")).cast("int"), F.lit(0))


def promoted(verdict: Column) -> Column:
    """Alert kind of a scored verdict."""
    return F.try_element_at(literal_map(V.PROMOTION), verdict)


def suspicious_attack_type(verdict: Column) -> Column:
    return F.try_element_at(literal_map(V.SUSPICIOUS_ATTACK_TYPE), verdict)


def decision(verdict: Column, score: Column, rules: Rules = Rules()) -> Column:
    return F.when(score >= rules.alert_score, promoted(verdict)).otherwise(V.CONTINUE)


def chance(score: Column) -> Column:
    return F.least(score, F.lit(100))
