"""Host and ignore filters, packet search with paging, lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch import fixed_values as V
from flowwatch.operators import layout, networks, skew
from flowwatch.session import scratch_path
from flowwatch.sources.packets import bucket_of

PAGE_SIZE = 20
_ORDER = ["timestamp", "packet_id"]
_DIRECT_ROWS = 10_000  # pages that end before this row are a bounded top-k


def of_host(packets: DataFrame, hosts: list[str]) -> DataFrame:
    return packets.where(F.col("source_address").isin(hosts) | F.col("destination_address").isin(hosts))


def not_ignored(packets: DataFrame, ignored: list[str] | DataFrame) -> DataFrame:
    """Drops packets from or to an ignored address."""
    if not isinstance(ignored, DataFrame):
        listed = F.col("source_address").isin(ignored) | F.col("destination_address").isin(ignored)
        return packets.where(~listed)
    addresses = ignored.toDF("address").distinct()
    kept = packets
    for side in ("source_address", "destination_address"):
        kept = skew.lookup_spread(kept, addresses.withColumnRenamed("address", side), side, _ORDER, counted=packets)
    return kept


def outside(packets: DataFrame, ignored: list[str] | DataFrame) -> DataFrame:
    """Drops packets from or to an ignored network, such as 10.0.0.0/8 or fe80::/10."""
    if not isinstance(ignored, DataFrame):
        sides = networks.within(F.col("source_address"), ignored) | networks.within(F.col("destination_address"), ignored)
        return packets.where(~sides)
    column = ignored.columns[0]
    both = packets.select(F.explode(F.array("source_address", "destination_address")).alias("address"))
    path = scratch_path(packets.sparkSession, "listed")  # read several times, and short beside the packets
    networks.matches(both, "address", ignored, column).select("address").distinct().write.parquet(path)
    return not_ignored(packets, packets.sparkSession.read.parquet(path))


def _wanted(value) -> int | None:
    """A port or length; unset when missing, -1 or not a number."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return None
    return None if number == V.NO_PORT else number


def find(
    packets: DataFrame, protocols: str | list[str] = "", source: str = "", destination: str = "",
    source_port=None, destination_port=None, length=None,
) -> DataFrame:
    """Packets that match every given condition; addresses are regular expressions.

    What an anchored expression begins with is a test of its own, which skips files of a
    table that `layout.write_clustered` wrote.
    """
    names = protocols.split(",") if isinstance(protocols, str) else list(protocols)
    if names == [""]:
        names = V.PROTOCOLS
    test = F.col("protocol").isin(names)
    for column, pattern in [("source_address", source), ("destination_address", destination)]:
        if pattern:
            test = test & layout.starts(column, pattern) & F.col(column).rlike(pattern)
    for column, value in [("source_port", source_port), ("destination_port", destination_port), ("length", length)]:
        number = _wanted(value)
        if number is not None:
            test = test & (F.col(column) == number)
    return packets.where(test)


def page(found: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page in order of time.

    Early pages are a top-k. A far page would gather everything before it, so
    there rows get their global position from range slices instead.
    """
    start = (number - 1) * size
    if start + size <= _DIRECT_ROWS:
        return found.orderBy(*_ORDER).offset(start).limit(size)
    placed = skew.prefix_sums(found, [], _ORDER, {"_row": F.lit(1)})
    return placed.where((F.col("_row") > start) & (F.col("_row") <= start + size)).drop("_row").orderBy(*_ORDER)


def page_count(found: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n_packets")).withColumn(
        "n_pages", F.ceil(F.col("n_packets") / size)
    )


def next_batch(packets: DataFrame, n: int = 500) -> DataFrame:
    """The oldest n packets that wait for analysis."""
    return packets.orderBy(*_ORDER).limit(n)


# --- lookups -----------------------------------------------------------------------


def of_flow(packets: DataFrame, flow_key: int, l4_key: str) -> DataFrame:
    return packets.where((F.col("flow_key") == flow_key) & (F.col("l4_key") == l4_key))


def of_flow_and_protocol(packets: DataFrame, flow_key: int, protocol: str) -> DataFrame:
    return packets.where((F.col("flow_key") == flow_key) & (F.col("protocol") == protocol))


def of_flows(packets: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Packets of many flows at once."""
    return skew.lookup(
        packets, wanted.select(*keys).distinct(), keys, how="left_semi"
    )


def with_more_packets(flow_keys: DataFrame, captured: DataFrame, keys: list[str], protocol: str | None = None) -> DataFrame:
    """Flow keys that have captured packets, optionally of one protocol only.

    The packets are reduced to distinct keys before the join.
    """
    rows = captured if protocol is None else captured.where(F.col("protocol") == protocol)
    return flow_keys.join(rows.select(*keys).distinct(), keys, "left_semi")


def _of_key(rows: DataFrame, column: str, key: str) -> Column:
    """Equality with a key; in a store by key, also its partition, so others are not read."""
    test = F.col(column) == key
    return test & (F.col("bucket") == bucket_of(F.lit(key))) if "bucket" in rows.columns else test


def history_of(history: DataFrame, source: str | None = None, verdict: str | None = None) -> DataFrame:
    test: Column = F.lit(True)
    if source is not None:
        test = test & _of_key(history, "source", source)
    if verdict is not None:
        test = test & (F.col("verdict") == verdict)
    return history.where(test)


def alerts_of(alerts: DataFrame, attacker: str, scan_type: str, attack_type: str) -> DataFrame:
    return alerts.where(
        _of_key(alerts, "attacker", attacker) & (F.col("scan_type") == scan_type) & (F.col("attack_type") == attack_type)
    )


def alerts_after(alerts: DataFrame, time: int | Column) -> DataFrame:
    return alerts.where(F.col("time") > time)
