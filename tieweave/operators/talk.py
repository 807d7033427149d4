"""Conversation history and bounded reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieweave.operators.values import rank_values

MAX_HISTORY_TURNS = 10
CONTEXT_MESSAGES = 6
MAX_ROWS = 1000


def turn_messages(turns: DataFrame) -> DataFrame:
    """Messages of ``turns(conv_id, turn, question, answer)``: question, then any answer."""
    question = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    said = F.array_compact(F.array(question, F.when(F.coalesce("answer", F.lit("")) != "", answer)))
    return turns.select("conv_id", "turn", F.posexplode(said).alias("part", "said")).select(
        "conv_id", "turn", "part", "said.role", "said.content"
    )


def last_messages(messages: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` messages of each conversation."""
    latest = [F.col("turn").desc(), F.col("part").desc()]
    return rank_values(messages, ("conv_id",), latest, limit).drop("rank")


def prune_history(messages: DataFrame, max_turns: int = MAX_HISTORY_TURNS) -> DataFrame:
    """History kept for a conversation: two messages per turn."""
    return last_messages(messages, 2 * max_turns)


def context_tail(messages: DataFrame) -> DataFrame:
    return last_messages(messages, CONTEXT_MESSAGES)


def bounded_read(rows: DataFrame, order: tuple[str, ...], limit: int = MAX_ROWS) -> DataFrame:
    """The first ``limit`` rows with ``truncated`` and ``returned_rows`` on each.

    ``order`` makes the choice repeatable; one row more than the limit is fetched to
    learn whether there are more.
    """
    taken = rows.orderBy(*order).limit(limit + 1)
    # At most limit + 1 rows meet in this window.
    fetched = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return (
        taken.withColumn("fetched", fetched)
        .withColumn("truncated", F.col("fetched") > limit)
        .withColumn("returned_rows", F.least(F.col("fetched"), F.lit(limit)))
        .drop("fetched")
        .orderBy(*order)
        .limit(limit)
    )
