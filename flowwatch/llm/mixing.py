"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from weights by water-filling: shares of the total by weight, none above
`most` times its source's size, the excess shared again. A source takes every document
`whole` = floor(target / size) times; what is left of its budget is fitted by a subset of
its documents that are taken once more. Only the number of documents of each exact
length matters for that: every length gives its proportional part, then the longest that
fit are added, and a bounded-knapsack table (one bit per sum, counts split in powers of
two) fits the last few documents' worth exactly, or as near as sums allow. Within a
(source, length) the documents with the smallest seeded hashes are the ones taken.

Sizes of groups: one task sees a source's distinct lengths with counts, never documents.
Ranks inside a length come from windows over hash slices of a few thousand documents,
offset by the slices' counts, so a length that a third of all rows share is no hot group.

Defined cases: null text has size 0; the null source is a source, last in order; a source
without words has target 0 and takes nothing; rows with one id are separate documents
(equal rows are interchangeable); an empty table gives an empty one; the result does not
depend on order or partitioning; other columns stay unread.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.llm.common import WORDS, keep, ship

SLICE = 4096


def reach(counts: list[tuple[int, int]], most: int, want: int) -> list[tuple[int, int, int]]:
    """Bit sets of reachable sums: (length, number in this step, sums before the step),
    until `want` is reached."""
    mask, sums, steps = (1 << most + 1) - 1, 1, []
    for length, count in counts:
        step = 1
        count = min(count, most // length)
        while count:
            n = min(step, count)
            steps.append((length, n, sums))
            sums |= sums << length * n & mask
            count -= n
            step *= 2
            if sums >> want & 1:
                return [*steps, (0, 0, sums)]
    steps.append((0, 0, sums))
    return steps


def nearest(sums: int, want: int) -> int:
    """The set bit nearest to `want`, the lower one on ties."""
    low = (sums & (1 << want + 1) - 1).bit_length() - 1
    above = sums >> want + 1
    if not above:
        return low
    high = want + 1 + (above & -above).bit_length() - 1
    return low if want - low <= high - want else high


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come to `budget`."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not total:
        return {}
    budget = min(budget, total)
    # one less than the proportional part leaves some of every length to fit the rest with
    take = {n: max(0, c * budget // total - 1) for n, c in counts.items()}
    left = budget - sum(n * k for n, k in take.items())
    longest = max(counts)
    for n in sorted(counts, reverse=True):  # keep a few documents' worth for the exact part
        more = max(0, min(counts[n] - take[n], (left - 2 * longest) // n))
        take[n] += more
        left -= more * n
    free = sorted(((n, counts[n] - take[n]) for n in counts if counts[n] > take[n]), reverse=True)
    steps = reach(free, left + longest, left)
    at = nearest(steps.pop()[2], left)
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


def targets(sources: DataFrame, weights: tuple[float, ...], most: int, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), by water-filling.

    Places in code-point order come from a distributed sort; every round caps at least
    one source and moves one row of sums to the driver.
    """
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0]["source"], int(x[0]["source_size"]), int(x[1]))
    )
    levels = keep(
        spark.createDataFrame(ordered, "source string, source_size long, place long").withColumn(
            "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
        ),
        "mix-sources",
    )
    cap = F.col("source_size") * most
    rest, weight = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.sum("weight")).first()
    budget = rest
    while weight:
        over = F.col("weight") * rest / weight > cap
        # sources once capped stay capped: the level only rises
        closed, left = levels.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        new = budget - closed
        if (new, left) == (rest, weight):
            break
        rest, weight = new, left
    if not weight:
        return levels.select("source", "source_size", cap.cast("double").alias("target"))
    open_target = F.col("weight") * F.lit(float(rest)) / F.lit(float(weight))
    return levels.select(
        "source", "source_size", F.when(open_target > cap, cap.cast("double")).otherwise(open_target).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, repeats, taken) of every document."""
    spark = docs.sparkSession
    ship(spark)
    rows = keep(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "source", "size"))
    lengths = keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goal = keep(
        targets(
            lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most
        ),
        "mix-targets",
    )

    def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(most, int(target // size)) if size else 0
        rest = round(target - whole * size) if size and whole < most else 0
        extra = fit(dict(zip(group["size"].tolist(), group["n"].tolist(), strict=True)), rest)
        return pd.DataFrame({
            "source": group["source"], "size": group["size"], "n": group["n"], "source_size": size, "target": target,
            "whole": whole, "extra": [extra.get(int(s), 0) for s in group["size"]],
        })

    plans = keep(
        lengths.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .groupBy("source").applyInPandas(
            plan, "source string, size long, n long, source_size long, target double, whole int, extra long"
        ),
        "mix-plan",
    )
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    planned = hashed.join(plans.select(*[F.col(c).alias(f"p_{c}") for c in plans.columns]), same)
    # a slice is a range of hashes with about SLICE documents of one (source, size)
    slices = F.ceil(F.col("p_n") / SLICE)
    sliced = planned.withColumn("slice", F.floor((F.col("h") / 2.0**64 + 0.5) * slices))
    part = (0 < F.col("p_extra")) & (F.col("p_extra") < F.col("p_n"))
    group = ["p_source", "p_size", "slice"]
    ahead = (
        sliced.where(part).groupBy(*group).agg(F.count("*").alias("c"))
        .withColumn("ahead", F.sum("c").over(
            Window.partitionBy("p_source", "p_size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("p_source").alias("a_source"), F.col("p_size").alias("a_size"), F.col("slice").alias("a_slice"), "c", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    )
    placed = sliced.where(part).join(
        ahead, F.col("p_source").eqNullSafe(F.col("a_source")) & (F.col("p_size") == F.col("a_size")) & (F.col("slice") == F.col("a_slice"))
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", "id")) + F.col("ahead")
    # slices wholly inside or outside need no rank; one slice of a length has the border
    border = (F.col("ahead") < F.col("p_extra")) & (F.col("p_extra") < F.col("ahead") + F.col("c"))
    done = placed.where(~border).withColumn("more", (F.col("ahead") < F.col("p_extra")).cast("int"))
    ranked = placed.where(border).withColumn("more", (rank <= F.col("p_extra")).cast("int"))
    plain = sliced.where(~part).withColumn("more", (F.col("p_extra") > 0).cast("int"))
    return (
        plain.unionByName(done.select(plain.columns)).unionByName(ranked.select(plain.columns))
        .select(
            F.col("id").alias(id_col), F.col("source"), "size", F.col("p_source_size").alias("source_size"),
            F.col("p_target").alias("target"), (F.col("p_whole") + F.col("more")).alias("repeats"),
        )
        .withColumn("taken", F.col("repeats") * F.col("size"))
    )
