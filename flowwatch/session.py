"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: HotSpot never compiles a method of more bytes: a generated stage above it runs interpreted.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("flowwatch")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> None:
    """Lets stages whose generated method HotSpot would not compile run by operator, in small methods.

    The rules of packets and flows make methods of 10 000 to 43 000 bytes.
    """
    spark.conf.set(*COMPILED)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Only a local master may run without one; then a local folder is created and set,
    once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = of_context.get() if of_context.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flowwatch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
