"""Readers and writers of packets, histories, alerts and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.schema import PACKET, PORT_INFO, TRAINING
from flowwatch.session import compiled

BAD_RECORD = "_bad_record"

BUCKETS = 16


def read_packets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Packets of any file format; text formats keep a bad record in `_bad_record`."""
    compiled(spark)
    if fmt not in ("json", "csv"):
        return spark.read.format(fmt).schema(PACKET).load(path)
    schema = T.StructType([*PACKET.fields, T.StructField(BAD_RECORD, T.StringType())])
    reader = spark.read.format(fmt).schema(schema).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", BAD_RECORD).load(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Labelled feature rows: a header, seven features and the label."""
    return spark.read.option("header", True).schema(TRAINING).csv(path)


def read_port_info(spark: SparkSession, path: str) -> DataFrame:
    """Port table; the description may hold commas, so only four are split at."""
    parts = F.split("value", ",", 5)
    kinds = [f.dataType.simpleString() for f in PORT_INFO.fields]
    return spark.read.text(path).select(*[
        parts[i].try_cast(kind).alias(field.name)
        for i, (field, kind) in enumerate(zip(PORT_INFO.fields, kinds))
    ])


def enrich_port(rows: DataFrame, port_info: DataFrame, port: str = "port") -> DataFrame:
    """Adds what is known of a port. Rows of the port table that are no port (0 to 65 535)
    are left out, which bounds it; adaptive execution decides whether to broadcast."""
    known = port_info.select(*[
        F.col(c).alias(port if c == "port" else f"port_{c}") for c in port_info.columns
    ]).where(F.col(port).between(0, 65_535)).dropDuplicates([port])
    return rows.join(known, port, "left")


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def append(
    rows: DataFrame, path: str, partition_by: list[str] | None = None, spread: str | None = None, files: int = 4
) -> None:
    """Appends to a Parquet table: packets, verdict history or alerts.

    With `partition_by`, rows are first dealt by folder, and by `spread` (a column) to
    `files` parts of each, so a folder gets a few files and not one from every task, and
    a folder that holds most rows is not written by one task.
    """
    if not partition_by:
        rows.write.mode("append").parquet(path)
        return
    dealt = [*map(F.col, partition_by), *([F.pmod(F.xxhash64(spread), F.lit(files))] if spread else [])]
    rows.repartition(*dealt).write.mode("append").partitionBy(*partition_by).parquet(path)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """Partition number of a key in the stores that answer by key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def by_key(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the partition column `bucket`; `history_of` and `alerts_of` read only the
    bucket of the key they ask for."""
    return rows.withColumn("bucket", bucket_of(F.col(key), buckets))


def clear(spark: SparkSession, path: str) -> None:
    """Empties a stored table; what is read back has its columns and no row."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def with_day(packets: DataFrame) -> DataFrame:
    """Adds the partition column of stored packets."""
    return packets.withColumn("day", F.to_date(F.timestamp_micros("timestamp")))
