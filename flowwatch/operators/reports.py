"""Alert roll-up, removal and packet reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.operators import skew
from flowwatch.rules import Rules

_GROUP = ["attacker", "scan_type", "attack_type"]


def _groups(alerts: DataFrame) -> DataFrame:
    """One row per (attacker, scan type, attack type), in one pass.

    Ports and tools are sets that are combined before the shuffle: at most 65 537
    ports, and few distinct tool lists. Complete alerts are read port by port; the
    first port of an alert counts it.
    """
    d = alerts.withColumn("_tie", F.xxhash64("attacker", "attack_type", "chance"))
    if "description" not in alerts.columns:
        d = d.withColumns({"description": F.lit(""), "read": F.lit(False)})
    if "scanned_ports" in alerts.columns:
        d = d.select("*", F.posexplode_outer("scanned_ports").alias("_at", "port"))
    else:
        d = d.withColumn("_at", F.lit(0))
    return d.groupBy(*_GROUP).agg(
        F.max("chance").alias("chance"),
        F.min(F.struct("time", "_tie", "description", "read")).alias("head"),
        F.collect_set("port").alias("ports"),
        F.collect_set("tools").alias("tool_lists"),
        F.count(F.when(F.coalesce("_at", F.lit(0)) == 0, 1)).alias("n_alerts"),
    )


def _merged_label(groups: DataFrame, scope: str) -> DataFrame:
    """SYN and CONNECT share one label where a CONNECT alert exists.

    Works on rolled-up groups: at most 28 rows per attacker.
    """
    is_connect = F.col("attack_type") == "TCP CONNECT"
    if scope == "global":
        found = F.coalesce(groups.agg(F.max(is_connect)).scalar(), F.lit(False))
    else:
        found = F.max(is_connect).over(W.partitionBy("attacker"))
    merge = found & F.col("attack_type").isin("TCP SYN", "TCP CONNECT")
    return groups.withColumn("_merge", merge).withColumn(
        "attack_type", F.when(F.col("_merge"), V.SYN_OR_CONNECT).otherwise(F.col("attack_type"))
    ).drop("_merge")


def roll_up(alerts: DataFrame, rules: Rules = Rules(), source_ports: DataFrame | None = None) -> DataFrame:
    """One row per (attacker, scan type, attack type).

    Takes complete alerts (`scanned_ports`), or base alerts (`port`) together with
    `alerts.scanned_ports`: then no port list is built per alert, the source's list
    joins the rolled-up groups instead.
    """
    groups = _groups(alerts)
    if source_ports is not None:
        listed = groups.join(source_ports.withColumnRenamed("source", "attacker"), "attacker", "left")
        of_source = F.when(F.col("attack_type") == "UDP", F.col("scan_and_data_ports")).otherwise(F.col("scan_ports"))
        groups = listed.withColumn(
            "ports", F.array_union("ports", F.coalesce(of_source, F.array().cast("array<int>")))
        ).drop("scan_ports", "scan_and_data_ports")
    # two rows at most meet here: SYN and CONNECT of one attacker
    merged = _merged_label(groups, rules.merge_scope).groupBy(*_GROUP).agg(
        F.max("chance").alias("chance"), F.min("head").alias("head"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("scanned_ports"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("tool_lists"))))).alias("tools"),
        F.sum("n_alerts").alias("n_alerts"),
    )
    ports = F.array_remove("scanned_ports", V.NO_PORT) if rules.clean_ports else F.col("scanned_ports")
    return merged.select(
        F.date_format(F.timestamp_micros("head.time"), "yyyy-MM-dd HH:mm").alias("time"),
        *_GROUP, "head.description", "tools", ports.alias("scanned_ports"), "chance", "head.read", "n_alerts",
    )


def port_preview(rolled: DataFrame, shown: int = 30) -> DataFrame:
    """First ports of an alert and how many there are."""
    return rolled.withColumns({
        "first_ports": F.slice("scanned_ports", 1, shown), "n_ports": F.size("scanned_ports"),
    })


def remove_alerts(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts without those named by requests (attack_types, attacker, scan_type);
    `attack_types` is a comma list."""
    named = requests.select(
        F.explode(F.split("attack_types", ",")).alias("attack_type"), "attacker", "scan_type"
    ).withColumn("attack_type", F.trim("attack_type")).distinct()
    return skew.lookup(alerts, named, _GROUP, how="left_anti")


def remove_by_attack(alerts: DataFrame, attacker: str, attack_type: str) -> DataFrame:
    hit = (F.col("attacker") == attacker) & (F.col("attack_type") == attack_type)
    return alerts.where(~F.coalesce(hit, F.lit(False)))


def mark_read(alerts: DataFrame, condition: Column) -> DataFrame:
    return alerts.withColumn("read", F.when(condition, True).otherwise(F.col("read")))


def packet_counts(captured: DataFrame, analysed: DataFrame) -> DataFrame:
    """Sizes of both packet stores, as one row."""
    tagged = captured.select(F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(
        analysed.select(F.lit(0).alias("c"), F.lit(1).alias("a"))
    )
    return tagged.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("captured"), F.coalesce(F.sum("a"), F.lit(0)).alias("analysed")
    )


def without_flows(packets: DataFrame, flow_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Packets without those of the listed flows."""
    return skew.lookup(packets, flow_keys.select(*keys).distinct(), keys, how="left_anti")


def without_ids(packets: DataFrame, ids: DataFrame) -> DataFrame:
    return packets.join(ids.select("packet_id"), "packet_id", "left_anti")
