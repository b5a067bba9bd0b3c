"""Stored conversations made fit to go on: old tool results cut, calls without results taken out, rounds counted.

messages(conv, n, role, text, calls, call_id): n orders a conversation; role is human, ai, tool or system; calls array<struct<id, name>> are what an ai message
asks of tools, call_id is the call that a tool message answers. The last human message opens the question at hand: only what stands before it is changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How much of an old result stays, its mark, what stands in for an empty message, and the calls that a question may have.
EXCERPT, CUT_MARK = 200, " [...]"
INTERRUPTED = "[La consultazione si e' interrotta prima dei risultati.]"
ROUNDS = 12


def _before_question(messages: DataFrame) -> DataFrame:
    """`messages` with `_old`: whether a message stands before the last human one; false without any."""
    last = F.max(F.when(F.col("role") == "human", F.col("n"))).over(Window.partitionBy("conv"))
    return messages.withColumn("_last", last).withColumn("_old", F.coalesce(F.col("n") < F.col("_last"), F.lit(False)))


def pruned(messages: DataFrame, excerpt: int = EXCERPT) -> DataFrame:
    """`messages` with old tool results cut to an excerpt and its mark; what is cut already stays as it is, so pruning again changes nothing."""
    rows = _before_question(messages)
    cut = F.col("_old") & (F.col("role") == "tool") & (F.length("text") > excerpt) & ~F.col("text").endswith(CUT_MARK)
    return rows.withColumn("text", F.when(cut, F.concat(F.left("text", F.lit(excerpt)), F.lit(CUT_MARK))).otherwise(F.col("text"))).select(messages.columns)


def without_orphans(messages: DataFrame) -> DataFrame:
    """`messages` without the old calls that no tool message answers; a message that is left with neither text nor calls says that it was interrupted.

    A call's results are the tool messages right behind it, up to the next message of another role: a window of that run, whose ids are gathered; texts are not.
    """
    rows = _before_question(messages)
    run = F.sum((F.col("role") != "tool").cast("int")).over(Window.partitionBy("conv").orderBy("n"))
    rows = rows.withColumn("_run", run)
    answered = F.collect_set(F.when(F.col("role") == "tool", F.col("call_id"))).over(Window.partitionBy("conv", "_run"))
    rows = rows.withColumn("_answered", answered)
    kept = F.filter("calls", lambda c: F.array_contains("_answered", c["id"]))
    asks = F.col("_old") & (F.col("role") == "ai") & (F.size("calls") > 0)
    rows = rows.withColumn("_kept", F.when(asks, kept).otherwise(F.col("calls"))).withColumn("_lost", F.coalesce(asks & (F.size("_kept") < F.size("calls")), F.lit(False)))
    empty = F.col("_lost") & (F.size("_kept") == 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return rows.withColumn("text", F.when(empty, INTERRUPTED).otherwise(F.col("text"))).withColumn("calls", F.col("_kept")).select(messages.columns)


def rounds(messages: DataFrame, most: int = ROUNDS) -> DataFrame:
    """(conv, rounds, close): the ai messages since the last human one, or all without any, and whether the next one must answer without tools."""
    rows = _before_question(messages)
    since = (F.col("role") == "ai") & (F.col("_last").isNull() | (F.col("n") > F.col("_last")))
    return rows.groupBy("conv").agg(F.count_if(since).alias("rounds")).withColumn("close", F.col("rounds") + 1 >= most)
