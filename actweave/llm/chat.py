"""Chat formatting with the perspective rotated, in DataFrame functions only.

Every participant of a conversation takes the assistant's part once: the dialogue is rendered with that speaker's turns as the
assistant's and all others' as named users', and the mask names the characters to train on, which are that speaker's own.
A conversation is rendered in parts of PART turns by position, each behind the conversation's first system turn, so that no conversation,
however long, is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 64
SYSTEM = "system"
NOBODY = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """Text in which nothing can be read as a mark of a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _placed(turns: DataFrame, size: int) -> DataFrame:
    """(conv, part, n, who, said): the turns with their places; `who` is null without a role.

    Places are counted in blocks of turn numbers and carried over from block to block, so that a long conversation is not sorted in one task.
    """
    who = F.nullif(F.trim(F.regexp_replace(_clean(F.col("role")), r"\s+", " ")), F.lit(""))
    rows = turns.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), who.alias("who"), _clean(F.col("text")).alias("said"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / size), F.lit(-(2**62))))
    own = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("who", F.lit(NOBODY)), "said", F.col("who").asc_nulls_first())
    rows = rows.withColumn("n", F.row_number().over(own))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("size")).select("conv", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("n") - 1
    return rows.join(blocks, ["conv", "block"]).select("conv", F.floor(place / size).alias("part"), place.alias("n"), "turn", "who", "said")


#: Parts of a conversation that meet its speakers in one task.
TOGETHER = 64


def rotated(turns: DataFrame, size: int = PART) -> DataFrame:
    """turns(conv_id, turn, role, text) → (conv_id, speaker, part, n_turns, rendered, mask, n_trained).

    One row for each participant and part; `part` counts from 0 by PART places. Roles are the speakers; `system` stays the system in every
    rendering and takes no part of its own, and neither does a turn without a role, which reads `user name=unknown`; a speaker who is really called so has
    turns of their own. A turn is `<|im_start|>assistant`, `user name=<speaker>` or `system`, a line break, the text, `<|im_end|>` and a line
    break; `<|` within texts and names is written `< |`. Every part after the first one opens with the conversation's first system turn,
    if it has one, which `n_turns` does not count. mask: "start:end" of the speaker's texts with their end marks, in characters of
    `rendered`, end exclusive, comma-joined; empty if the speaker is silent in this part. Turns are ordered by turn (null first), role
    and text; repeated rows are repeated turns; a null conv_id is a conversation like any other; other columns are ignored. Conversations
    of a system alone give no rows; no turns give no rows.
    """
    placed = _placed(turns, size)
    parts = placed.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("n", "who", "said"))).alias("m"))
    parts = parts.withColumn("lot", F.floor(F.col("part") / TOGETHER))
    convs = placed.groupBy("conv").agg(F.max("part").alias("last"), F.min_by(F.when(F.col("who") == SYSTEM, F.col("said")), F.when(F.col("who") == SYSTEM, F.col("n"))).alias("opening"))
    people = placed.filter(F.col("who").isNotNull() & (F.col("who") != SYSTEM)).select("conv", F.col("who").alias("speaker")).distinct()
    people = people.join(convs, "conv").select("conv", "speaker", "opening", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / TOGETHER))).alias("lot"))
    opening = F.when((F.col("part") > 0) & F.col("opening").isNotNull(), F.concat(F.lit(f"{OPEN}{SYSTEM}\n"), "opening", F.lit(CLOSE + "\n"))).otherwise(F.lit(""))
    both = parts.join(people, ["conv", "lot"]).withColumn("opens", opening)

    def head(x: Column) -> Column:
        role = F.when(x["who"] == SYSTEM, F.lit(SYSTEM)).when(x["who"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.coalesce(x["who"], F.lit(NOBODY))))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    pieces = F.transform("m", lambda x: F.struct(F.concat(head(x), x["said"], F.lit(CLOSE + "\n")).alias("t"), F.length(head(x)).alias("h"), F.coalesce(x["who"] == F.col("speaker"), F.lit(False)).alias("own")))
    both = both.withColumn("_p", pieces)
    start = F.struct(F.length("opens").alias("at"), F.array().cast("array<string>").alias("mask"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["t"])
        low, high = a["at"] + x["h"], end - 1
        mask = F.when(x["own"], F.concat(a["mask"], F.array(F.concat(low, F.lit(":"), high)))).otherwise(a["mask"])
        return F.struct(end.alias("at"), mask.alias("mask"), (a["n"] + F.when(x["own"], high - low).otherwise(0)).alias("n"))

    both = both.withColumn("_s", F.aggregate("_p", start, step))
    return both.select(
        "conv.conv_id",
        "speaker",
        "part",
        F.size("m").cast("long").alias("n_turns"),
        F.concat("opens", F.array_join(F.transform("_p", lambda x: x["t"]), "")).alias("rendered"),
        F.array_join("_s.mask", ",").alias("mask"),
        F.col("_s.n").cast("long").alias("n_trained"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, nullif(trim(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '\s+', ' ', 'g')), '') AS who,
         replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(who, 'unknown'), said, who NULLS FIRST) - 1 AS n FROM t
), p AS (
  SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'
), o AS (
  SELECT conv_id, arg_min(said, n) AS opening FROM n WHERE who = 'system' GROUP BY conv_id
), r AS (
  SELECT n.conv_id, speaker, CAST(n // 64 AS BIGINT) AS part, n, coalesce(who = speaker, false) AS own, said,
         '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user name=' || coalesce(who, 'unknown') END || chr(10) AS head,
         CASE WHEN n >= 64 AND opening IS NOT NULL THEN '<|im_start|>system' || chr(10) || opening || '<|im_end|>' || chr(10) ELSE '' END AS opens
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN o ON n.conv_id IS NOT DISTINCT FROM o.conv_id
), w AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS t,
         length(opens) + sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, speaker, part ORDER BY n) - length(head) - length(said) - 11 AS begun FROM r
)
SELECT conv_id, speaker, part, CAST(count(*) AS BIGINT) AS n_turns, min(opens) || string_agg(t, '' ORDER BY n) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(begun + length(head) AS BIGINT) || ':' || CAST(begun + length(head) + length(said) + 10 AS BIGINT) END, ',' ORDER BY n), '') AS mask,
       CAST(coalesce(sum(CASE WHEN own THEN length(said) + 10 END), 0) AS BIGINT) AS n_trained
FROM w GROUP BY conv_id, speaker, part
"""
