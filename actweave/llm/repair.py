"""Conversation structure repair: the cheapest edits that make roles alternate, found once for each shared beginning.

Each turn becomes a symbol of its role and its fault, each conversation a signature of its symbols. Equal signatures have equal answers,
and signatures that begin alike share the work on what they share:

1. Turns get their faults and places by windows; a conversation's symbols are joined to its signature.
2. Distinct signatures are sorted and dealt by range, so that a task has neighbours. It inserts them into a prefix trie whose path to the last one
   is a stack: a layer of the dynamic program belongs to each node, is computed when the node is first met, and serves all signatures
   through it. Answers are emitted at terminal nodes.
3. Conversations meet the answer of their signature, turns meet their edit by place.

A layer has, for each state of the roles so far (nothing, system, user last, assistant last), the least cost and, among the cheapest edits, the place
of their initials in ASCII order. Insertions come before the edit of a turn, so that two series of edits in one layer end in a turn's edit
each; none is the beginning of another, and whatever follows keeps their order. So the order within the layer before and the new initials decide,
and the initials themselves are put together at terminal nodes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_facts
from .periodic import CRC32

ROLES, FAULTS = "suax", "obdt"  # system, user, assistant, other; none, blank, duplicate, truncated
#: Turn numbers that one task puts in order at a time.
SPAN = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: state → state after a further system, user or assistant turn
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}

Layer = tuple[tuple[int, int] | None, ...]  # (cost above the layer's least, place in order) of each state


def symbol(role: str, fault: str) -> str:
    return chr(65 + 4 * ROLES.index(role) + FAULTS.index(fault))


def _inserted(state: int) -> list[tuple[int, int]]:
    """(state, insertions): what up to two insertions lead to; more come back to where they have been."""
    out = [(state, 0)]
    for n in (1, 2):
        out.append((next(to for who, to in NEXT[out[-1][0]].items() if who != "s"), n))
    return out


@cache
def moves(sym: str) -> tuple[tuple[int, str, int, int], ...]:
    """(state, initials, cost, new state): the edits of a turn, insertions before it included."""
    role, fault = ROLES[(ord(sym) - 65) // 4], FAULTS[(ord(sym) - 65) % 4]
    out, late = [], CUT if fault == "t" else 0
    for state in range(4):
        for at, n in _inserted(state):
            out.append((state, "I" * n + "D", INSERT * n + DELETE, at))
            if fault in "bd":
                continue
            for who, to in NEXT[at].items():
                if who == role:
                    out.append((state, "I" * n + "K", INSERT * n + KEEP + late, to))
                if who != "s":
                    out.append((state, "I" * n + "R", INSERT * n + REROLE + late, to))
    return tuple(out)


@cache
def step(layer: Layer, sym: str) -> tuple[Layer, int, tuple]:
    """(next layer, what its costs grow by, for each state the state before and the initials added)."""
    best: list = [None] * 4
    for state, initials, cost, to in moves(sym):
        if layer[state] is not None:
            own = (layer[state][0] + cost, layer[state][1], initials, state)
            best[to] = own if best[to] is None else min(best[to], own)
    least = min(b[0] for b in best if b)
    order = {b[1:3]: k for k, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
    return tuple(b and (b[0] - least, order[b[1:3]]) for b in best), least, tuple(b and (b[3], b[2]) for b in best)


ROOT: Layer = ((0, 0), None, None, None)


def closed(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, insertions): the cheapest end, nothing or an assistant's turn last."""
    ends = [(layer[s][0] + INSERT * n, layer[s][1], n, s) for s in range(4) if layer[s] is not None for at, n in _inserted(s) if at in (START, ASSISTANT)]
    cost, _, n, state = min(ends)
    return cost, state, n


_ANSWER = pa.schema(
    [("sig", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
    + [("plan", pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string())])))]
)
_ANSWER_DDL = "sig string, cost long, audit string, blank long, duplicate long, truncated long, illegal long, plan array<struct<at: long, role: string>>"


def _plan(audit: str) -> list[dict]:
    """The turns of the repaired conversation: which turn each is (none: a new one), and its role where that is not its own."""
    stays = [x for x in audit if x != "D"]
    role, n, out = "user", 0, []
    opens = len(stays) % 2 == 1  # a system turn comes first
    for x in audit:
        if x != "D":
            own = x == "K"
            out.append({"at": None if x == "I" else n, "role": None if own else role})
            if opens:
                opens = False
            else:
                role = "assistant" if role == "user" else "user"
        n += x != "I"
    return out


def answers(signatures: Iterator[str]) -> Iterator[dict]:
    """The answer of each signature, sorted ones: the path to the last one is kept as a stack of layers, the rest of the trie is done with."""
    path: list[tuple[Layer, int, tuple, tuple[int, int, int, int]]] = [(ROOT, 0, (), (0, 0, 0, 0))]
    last = ""
    for sig in signatures:
        shared = next((k for k, (x, y) in enumerate(zip(last, sig, strict=False)) if x != y), min(len(last), len(sig)))
        del path[shared + 1 :]
        for k in range(shared, len(sig)):
            layer, cost, _, (b, d, t, wrong) = path[-1]
            new, more, back = step(layer, sig[k])
            fault = FAULTS[(ord(sig[k]) - 65) % 4]
            pair = "".join(ROLES[(ord(x) - 65) // 4] for x in sig[k - 1 : k + 1]) if k else "su"
            path.append((new, cost + more, back, (b + (fault == "b"), d + (fault == "d"), t + (fault == "t"), wrong + (pair not in ("su", "ua", "au")))))
        last = sig
        layer, cost, _, (b, d, t, wrong) = path[-1]
        more, state, n = closed(layer)
        parts = ["I" * n]
        for _, _, back, _ in path[:0:-1]:
            state, initials = back[state]
            parts.append(initials)
        audit = "".join(reversed(parts))
        yield {"sig": sig, "cost": cost + more, "audit": audit, "blank": b, "duplicate": d, "truncated": t, "illegal": wrong, "plan": _plan(audit)}


#: Symbols of answered signatures that are sent on together.
TOGETHER = 100_000


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in answers(s for batch in batches for s in batch.column(0).to_pylist()):
        rows.append(row)
        size += len(row["sig"])
        if size > TOGETHER:
            yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)


def _some(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def placed(rows: DataFrame) -> DataFrame:
    """(conv, block, i, turn, role, text, sym, new): turns with their place in a block of SPAN turn numbers, their symbol, and whether they are first with their turn number."""
    rows = rows.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _some("role").alias("role"), _some("text").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    seen = rows.withColumn("_again", seen > 1)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", 1).when(F.col("_again"), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES[:3]), F.nullif(F.substring("role", 1, 1), F.lit(""))), F.lit(0)), F.lit(4)) - 1
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_again")
    seen = seen.withColumn("sym", F.char(F.lit(65) + role * 4 + fault)).withColumn("i", F.row_number().over(order))
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))
    return seen.withColumn("new", new).select("conv", "block", "i", "turn", "role", "text", "sym", "new")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, turn, role, text) → (report, turns).

    report(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row for each conversation. turns(conv_id, n, role, text, turn): the repaired
    conversations, n from 0; new turns have an empty text and no turn number.

    Turns stand in the order of turn (null first), role and text; nulls read as one space. A turn's first fault counts: blank (white space only), duplicate (its role and text
    stand earlier in the conversation), truncated (its last character that is no white space is none of .!?). Keeping a turn costs 0, giving it the role user or
    assistant 2, deleting it 3, which blank and duplicate ones must be; a new user's or assistant's turn costs 2; each truncated turn that is not
    deleted 1. Roles must end up as nothing, or as user and assistant in turn, with a system turn before them or not; roles count by their
    first character, any other one, or none, is never kept. audit has the initials of the edits, the least in ASCII order among the cheapest.
    gaps counts the missing turn numbers between the least and the greatest. Repeated rows are duplicates; a null conv_id is a
    conversation like any other; other columns are ignored; no rows give no rows. Turns of one conversation that have no number are put
    in order by one task.
    """
    spark = rows.sparkSession
    all_turns = materialize(placed(rows))
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sym"))), lambda x: x["sym"]), "")
    blocks = all_turns.groupBy("conv", "block").agg(symbols.alias("piece"), F.sum(F.col("new").cast("long")).alias("numbers"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    blocks = materialize(blocks)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("numbers"), F.lit(0).cast("long"))
    convs = materialize(blocks.groupBy("conv").agg(whole.alias("sig"), gaps.alias("gaps")))
    kinds = convs.groupBy("sig").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = kinds.select("sig").repartitionByRange(parts, "sig").sortWithinPartitions("sig").mapInArrow(_answered, _ANSWER_DDL)
    found = materialize(found.join(kinds, "sig"))
    all_convs = materialize(with_facts(convs, found, "sig", "n", convs.count()))
    report = all_convs.select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv", "block", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("before"))
    own = all_turns.join(offsets, ["conv", "block"]).select("conv", (F.col("before") + F.col("i") - 1).alias("at"), F.col("role").alias("own"), "text", "turn")
    plan = all_convs.select("conv", F.posexplode("plan").alias("n", "x")).select("conv", "n", "x.at", "x.role")
    turns = plan.join(own, ["conv", "at"], "left").select("conv.conv_id", F.col("n").cast("long").alias("n"), F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return report, turns


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each conversation of sorted turns; a conversation may go on in the next batch."""
    conv, hasher = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv[0]], kind), pa.array([hasher.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, role, text in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if conv != (c,):
                if conv is not None:
                    yield row()
                conv, hasher = (c,), hashlib.sha256(f"{role}:{text}".encode())
            else:
                hasher.update(f"\n{role}:{text}".encode())
    if conv is not None:
        yield row()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns(conv_id, n, role, text): sha256 of the conversation's `role:text`, joined by line feeds. Turns pass by in order; none are gathered."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.select("conv_id", "n", "role", "text").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "n")
    return ordered.mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): `rows` with faults planted by crc32 of `conv_id:turn`: turns lost, emptied, cut, repeated, or given to the user. Nulls read as one space."""
    hit = F.crc32(F.concat(_some("conv_id"), F.lit(":"), _some("turn"))) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(_some("text"), "[.!?]", "")).otherwise(_some("text"))
    rows = rows.select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(_some("role")).alias("role"), text.alias("text"), F.when(hit == 3, 2).when(hit == 0, 0).otherwise(1).alias("_n"))
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n")


def audited(rows: DataFrame) -> DataFrame:
    """The columns of op13: for each conversation of `rows`, after damage, the report of its repair and the hash of the outcome."""
    report, turns = repaired(damaged(rows))
    names = rows.select(F.struct("conv_id").alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = names.join(report.withColumn("conv", F.struct("conv_id")).drop("conv_id"), "conv", "left").join(digests(turns).withColumn("conv", F.struct("conv_id")).drop("conv_id"), "conv", "left")
    return out.select("conv.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _plus(v: str, cost: str, initials: str) -> str:
    """SQL: a state's text (six digits of cost, then initials) with an edit added."""
    return f"(lpad(CAST(CAST({v}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {v}[7:] || '{initials}')"


def _oracle() -> str:
    c2 = f"least(v2, {_plus('v0', '2', 'I')}, {_plus('v1', '2', 'I')}, {_plus('v3', '2', 'I')})"
    c3 = f"least(v3, {_plus('v2', '2', 'I')}, {_plus('v0', '4', 'II')}, {_plus('v1', '4', 'II')})"
    keep = lambda who, v: f"CASE WHEN f IN ('o', 't') AND r = '{who}' THEN {_plus(v, 't', 'K')} END"
    rerole = lambda v: f"CASE WHEN f IN ('o', 't') THEN {_plus(v, '2 + t', 'R')} END"
    n1 = f"least({_plus('c1', '3', 'D')}, {keep('s', 'c0')})"
    n2 = "least(" + ", ".join([_plus("c2", "3", "D"), *[x for v in ("c0", "c1", "c3") for x in (keep("u", v), rerole(v))]]) + ")"
    n3 = f"least({_plus('c3', '3', 'D')}, {keep('a', 'c2')}, {rerole('c2')})"
    crc = CRC32.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""
WITH RECURSIVE t0 AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations
), t1 AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t0
), t2 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e, role[1:1] AS r FROM t1
), t AS (
  SELECT *, CASE WHEN e = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS f, lag(r) OVER (PARTITION BY conv_id ORDER BY n) AS pr FROM t2
), c AS (
  SELECT DISTINCT conv_id FROM conversations
), s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
         count(*) FILTER (n > 1 AND (pr || r) NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM c
  UNION ALL
  SELECT conv_id, n, {_plus("c0", "3", "D")}, {n1}, {n2}, {n3} FROM (
    SELECT dp.conv_id, t.n, t.r, t.f, CASE WHEN t.f = 't' THEN 1 ELSE 0 END AS t, v0 AS c0, v1 AS c1, {c2} AS c2, {c3} AS c3 FROM dp JOIN t ON dp.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = dp.n + 1) x
), best AS (
  SELECT conv_id, n, least(v0, {c3}) AS v FROM dp
), a AS (
  SELECT c.conv_id, coalesce(s.n, 0) AS n, gaps, blank, duplicate, truncated, illegal, v[7:] AS audit, CAST(v[1:6] AS BIGINT) AS cost
  FROM c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND best.n = coalesce(s.n, 0)
), e AS (
  SELECT conv_id, audit, unnest(string_split(audit, '')) AS x, unnest(range(1, len(audit) + 1)) AS k FROM a WHERE audit <> ''
), p AS (
  SELECT conv_id, x, k, sum(CASE WHEN x <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN x <> 'D' THEN 1 ELSE 0 END) OVER w AS o, len(replace(audit, 'D', '')) % 2 AS odd FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), q AS (
  SELECT p.conv_id, k, CASE WHEN x = 'K' THEN role WHEN (o + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END AS line
  FROM p LEFT JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.n = t.n WHERE x <> 'D'
), z AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS whole FROM q GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM a LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""


ORACLE = _oracle()
