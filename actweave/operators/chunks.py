"""Long texts cut into overlapping chunks, and unstructured ones into blocks at sentence ends."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actweave.functions.text import short_fingerprint

# Which texts are cut, the sizes in characters, and where a cut is best.
LONG, STEP, EARLIEST, OVERLAP, TAIL = 6000, 1700, 1150, 200, 300
ENDS = (".\n", ";\n", "\n", ". ", "; ", ": ")
BLOCK = 1400
_SENTENCE = re.compile(r"(?<=[.;:])\s+")


def offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, end exclusive.

    A chunk ends behind the last of ENDS past EARLIEST characters, else behind the last space there, else after STEP; a rest under TAIL joins it.
    The next one starts at a word about OVERLAP characters before that.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        limit = start + STEP
        if n - limit < TAIL:
            out.append((start, n))
            break
        cut = max((p + len(s) for s in ENDS if (p := text.rfind(s, start + EARLIEST, limit)) >= 0), default=0) or text.rfind(" ", start + EARLIEST, limit) + 1 or limit
        out.append((start, cut))
        back = cut - OVERLAP
        space = text.find(" ", back, cut)
        start = back if space < 0 else space + 1
    return out


def sentence_blocks(text: str) -> list[str]:
    """A text of more than BLOCK characters as blocks of whole sentences; a longer sentence is a block of its own."""
    if len(text) <= BLOCK:
        return [text] if text else []
    out, held = [], ""
    for sentence in _SENTENCE.split(text):
        if held and len(held) + 1 + len(sentence) > BLOCK:
            out.append(held)
            held = sentence.strip()
        else:
            held = f"{held} {sentence}".strip()
    return [x for x in [*out, held] if x]


def _cut(rows: DataFrame, pieces: Callable[[str], list[tuple[int | None, int | None, str]]]) -> DataFrame:
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ord int, start int, end int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, k, a, e, t) for i, text in zip(b["id"], b["text"], strict=True) if text for k, (a, e, t) in enumerate(pieces(text))]
            yield pd.DataFrame(found, columns=["id", "ord", "start", "end", "text"])

    return rows.select("id", "text").mapInPandas(run, schema)


def chunked(rows: DataFrame, longer_than: int = LONG) -> DataFrame:
    """(id, ord, start, end, text) of the chunks of rows(id, text) with more than so many characters; the others never reach Python."""
    return _cut(rows.filter(F.length("text") > longer_than), lambda t: [(a, e, t[a:e]) for a, e in offsets(t)])


def blocks(rows: DataFrame) -> DataFrame:
    """(id, ord, text) of the sentence blocks of rows(id, text); texts that fit into one block stay in the JVM."""
    short = rows.filter((F.length("text") <= BLOCK) & (F.length("text") > 0)).select("id", F.lit(0).alias("ord"), "text")
    return short.unionByName(_cut(rows.filter(F.length("text") > BLOCK), lambda t: [(0, 0, x) for x in sentence_blocks(t)]).select("id", "ord", "text"))


def refreshed(paragraphs: DataFrame, chunks: DataFrame, longer_than: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(chunks that still hold, chunks to write): only paragraphs(id, text) whose fingerprint or set of chunks has changed are cut again.

    chunks(id, paragraph_id, ord, start, end, text, parent_fp, ...). Chunks whose paragraph is gone, or no longer long, are dropped.
    """
    long_ = paragraphs.filter(F.length("text") > longer_than).select(F.col("id").alias("paragraph_id"), "text", short_fingerprint(F.col("text")).alias("fp"))
    state = chunks.groupBy("paragraph_id").agg(F.min("parent_fp").alias("low"), F.max("parent_fp").alias("high"), F.count("*").alias("n"), F.max("ord").alias("last"))
    fresh = long_.join(state, "paragraph_id").filter((F.col("low") == F.col("fp")) & (F.col("high") == F.col("fp")) & (F.col("n") == F.col("last") + 1)).select("paragraph_id")
    new = _cut(long_.join(fresh, "paragraph_id", "left_anti").select(F.col("paragraph_id").alias("id"), "text"), lambda t: [(a, e, t[a:e]) for a, e in offsets(t)])
    new = new.join(long_.select(F.col("paragraph_id").alias("id"), F.col("fp").alias("parent_fp")), "id").select(F.concat("id", F.lit("#f"), "ord").alias("id"), F.col("id").alias("paragraph_id"), "ord", "start", "end", "text", "parent_fp")
    return chunks.join(fresh, "paragraph_id", "left_semi"), new
