"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.session import scratch_path

#: White space of the word definition: space and \x09-\x0D, the separators of bytes.split().
WORDS = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, archive = tempfile.mkstemp(prefix="flowwatch-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: lineage ends here.

    The folder goes when the application's file systems close.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    return df.mapInArrow(run, schema)


def buckets_for(df: DataFrame, each: int = 4) -> int:
    """A number of hash buckets that follows the input: `each` per input partition, which
    spark.sql.files.maxPartitionBytes bounds, and no fewer than the shuffle partitions."""
    spark = df.sparkSession
    return max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), each * df.rdd.getNumPartitions())


def components(links: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """(node, component) of every node of an undirected link table; component = smallest node.

    Alternating large and small stars: each round is aggregations and joins on narrow
    pairs, written to the shared folder. Links never come to the driver, only a count
    and a sum of hashes that tell when a round changed nothing. Null ends are ignored.
    """
    a, b = F.col(left), F.col(right)
    edges = keep(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        name,
    )
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(rest.union(root.select("u", F.col("m").alias("v"))).distinct(), name)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes of a pair table."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )
