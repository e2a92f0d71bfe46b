"""Helpers that keep one hot key from landing in one task.

`heavy_groups`   finds the groups above a row bound, at a bounded size.
`lookup_spread`  drops the facts whose key is in a dimension, hot keys in even parts.
`lookup`         joins a fact table to a per-key dimension.
`join_on`        the same with null keys equal to each other.
`range_slices`   a table cut into numbered ranges, kept, to be read several times.
`prefix_sums`    running sums per key, split over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwatch.session import shared_dir

MAX_HEAVY = 10_000
_SIEVE = 1 << 14  # counters that are looked at before groups are counted one by one


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_groups(df: DataFrame, keys: list[str], bound: int, limit: int = MAX_HEAVY):
    """Rows `(keys…, n)` of the groups with more than `bound` rows.

    Reads the key columns only. Rows are first counted by a hash of their key: no group is larger
    than its counter, so groups are counted one by one, in a second job, only where a counter is
    above the bound. At most `limit` rows reach the driver; None means there are more than that.
    """
    counter = F.pmod(F.xxhash64(*keys), F.lit(_SIEVE))
    sums = df.groupBy(counter.alias("_counter")).agg(F.count(F.lit(1)).alias("n"))
    full = [r[0] for r in sums.where(F.col("n") > bound).select("_counter").collect()]  # _SIEVE numbers at most
    if not full:
        return []
    if len(full) <= _SIEVE // 16:
        df = df.where(counter.isin(full))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    rows = counts.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a fact table to few rows per key (inner, left, left_semi or left_anti).

    Left plain: adaptive execution splits the fact side of a hot key by its measured
    size and broadcasts `dim` where it is measured to be small, which a fixed number
    of salts can do no better and pays for without skew.
    """
    return facts.join(dim, on, how)


def lookup_spread(facts: DataFrame, dim: DataFrame, on: str, by: list[str], bound: int = 1_000_000, counted: DataFrame | None = None) -> DataFrame:
    """Facts whose key is not in `dim`, in tasks of even size whatever keys are hot.

    A count over the key column (of `counted`, if facts are costly) finds hot keys. Whether `dim` has them is looked up in a
    broadcast table of MAX_HEAVY rows at most; their rows, and those without a key, meet
    nothing in the join that is left and are dealt by the columns `by`, not by key.
    """
    heavy = heavy_groups(facts if counted is None else counted, [on], bound)
    if not heavy:  # none, or so many that none has more than its share
        return lookup(facts, dim, [on], "left_anti")
    spark, kind = facts.sparkSession, facts.schema[on].dataType.simpleString()
    keys = spark.createDataFrame([(r[on],) for r in heavy], f"{on} {kind}")
    listed = {r[0] for r in lookup(keys, dim, [on], "left_semi").collect()}
    marks = spark.createDataFrame([(r[on], r[on] in listed) for r in heavy], f"_key {kind}, _listed boolean")
    marked = facts.join(F.broadcast(marks), F.col(on).eqNullSafe(F.col("_key")), "left").where("_listed is null or not _listed")
    hot = F.col("_listed").isNotNull()
    dealt = marked.withColumns({
        "_cold": F.when(~hot, F.col(on)),
        "_part": F.when(hot, F.xxhash64(*by)).otherwise(F.xxhash64(on)),
    }).drop("_key", "_listed")
    other = dim.select(F.col(on).alias("_cold"), F.xxhash64(on).alias("_part"))
    return dealt.join(other, ["_cold", "_part"], "left_anti").select(*facts.columns)


def join_on(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by key in which a null key equals a null key, as in a grouping."""
    renamed = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(renamed, test, how).drop(*[f"_on_{c}" for c in on])


def range_slices(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows range-partitioned by `order`, with the number of their range in `_slice`.

    A hot key is cut into many ranges if `order` goes on behind it. The ranges are
    checkpointed, because a second reading must find the same numbers.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ranged = df.repartitionByRange(partitions or shuffle_width(df), *order)
    return ranged.withColumn("_slice", F.spark_partition_id()).checkpoint()


def prefix_sums(
    df: DataFrame, part: list[str], order: list[str], sums: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Inclusive running sums over `part` in the order of `order`, which must be
    unique per row within `part`.

    The numbers of the slices are used twice: for the sums inside a slice and for
    the sums of the slices before it. Null keys are a key of their own.
    """
    values = df.withColumns({f"_v_{name}": c.cast("long") for name, c in sums.items()})
    cut = range_slices(values, [*part, *order], partitions)
    here = W.partitionBy(*part, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    before = before.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    inside = cut.withColumns({name: F.sum(f"_v_{name}").over(here) for name in sums})
    offsets = (
        cut.groupBy(*part, "_slice")
        .agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
        .select(
            *part, "_slice",
            *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        )
    )
    joined = join_on(inside, offsets, [*part, "_slice"])
    return joined.select(
        *[c for c in df.columns if c not in sums],
        *[(F.col(name) + F.col(f"_o_{name}")).alias(name) for name in sums],
    )
