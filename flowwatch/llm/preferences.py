"""Preference formatting of chosen and rejected conversations.

Both sides of a pair are aligned turn by turn; the longest common prefix of turns (role
and text) is rendered once, as the prompt, and what follows on either side becomes a
completion. The result is one row per rendered turn, so that neither a conversation nor a
pair is ever gathered in one place, however long: the first difference of a pair is a
minimum over hashed (pair, turn) groups, aggregated before the shuffle. Rows of a pair in
the order (part, turn, tie) are the training text. The mask is the range of code points
that is trained on: text and end mark of an assistant's turn in a completion.

Defined cases: rows without pair id belong to no pair; a null turn comes first, null role
and text count as empty; turns with one number are ordered by role, then text, and equal
rows count once; a pair that only one side has, or whose sides are equal, gives no row
(there is no preference); if one side is a prefix of the other its completion has no row;
empty tables give an empty one; other columns stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
FIRST = -(1 << 63)


def turns(table: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """(pair, turn, tie, role, text): distinct turns with their place."""
    rows = table.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair"), F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    return rows.withColumn("tie", F.row_number().over(Window.partitionBy("pair", "turn").orderBy("role", "text")))


def preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(pair, part, turn, tie, role, rendered, mask_start, mask_end) of every rendered turn."""
    both = None
    for side, table in (("c", chosen), ("r", rejected)):
        one = turns(table, pair, turn, role, text).withColumn("side", F.lit(side))
        both = one if both is None else both.unionByName(one)
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s)
    aligned = both.groupBy("pair", "turn", "tie").agg(of("c"), of("r"))
    split = aligned.groupBy("pair").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.struct("turn", "tie"))).alias("split"),
        F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"),
    ).where("split is not null and has_c and has_r").select("pair", "split")
    parts = F.when(
        F.struct("turn", "tie") < F.col("split"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("t")))
    ).otherwise(F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("c").alias("t")), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("t"))
    ))
    rows = aligned.join(split, "pair").select("pair", "turn", "tie", F.explode(parts).alias("p")).where("p.t is not null")
    head = F.concat(F.lit(START), F.col("p.t.role"), F.lit(MIDDLE))
    rendered = F.concat(head, F.col("p.t.text"), F.lit(END))
    trained = (F.col("p.part") != "prompt") & (F.col("p.t.role") == "assistant")
    return rows.select(
        F.col("pair").alias(pair), F.col("p.part").alias("part"), F.when(F.col("turn") != FIRST, F.col("turn")).alias("turn"),
        "tie", F.col("p.t.role").alias("role"), rendered.alias("rendered"),
        F.when(trained, F.char_length(head)).otherwise(0).alias("mask_start"),
        F.when(trained, F.char_length(rendered)).otherwise(0).alias("mask_end"),
    )


def cut_replies(table: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rejected counterparts of conversations that have none: the last assistant's turn is
    broken off after half its words (one at least).

    Conversations without an assistant's turn have no counterpart.
    """
    rows = turns(table, pair, turn, role, text)
    last = rows.where("role = 'assistant'").groupBy("pair").agg(F.max(F.struct("turn", "tie")).alias("last"))
    return rows.join(last, "pair").select(
        F.col("pair").alias(pair), F.col("turn").alias(turn), F.col("role").alias(role),
        F.when(F.struct("turn", "tie") == F.col("last"), half("text")).otherwise(F.col("text")).alias(text),
    )


def half(text: str) -> Column:
    words = F.split(text, " ")
    return F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))), " ")
