"""Typographic lines: spans of a page put together to visual rows, notes told from the body by their size, and articles found on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actweave.functions import ids

# Notes are set smaller than this; spans within this height are one row; a gap wider than this is a space.
NOTE_SIZE, ROW_HEIGHT, GAP = 10.0, 2.0, 1.0
HEADING = r"^(?i:art(?:icolo|\.)?)\s*([0-9]+(?:\s*-?\s*(?i:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies))?)\b"


def rows(spans: DataFrame) -> DataFrame:
    """spans(doc, page, y, x, width, size, text) → (doc, page, row, line_no, text, is_note): visual rows from the top, their spans from the left.

    Spans belong to a row if no step between their heights exceeds ROW_HEIGHT; a row is a note if its largest span is smaller than NOTE_SIZE. A page is
    the unit that one task orders.
    """
    down = Window.partitionBy("doc", "page").orderBy("y", "x")
    new = F.coalesce((F.col("y") - F.lag("y").over(down) > ROW_HEIGHT).cast("int"), F.lit(1))
    placed = spans.withColumn("_n", new).withColumn("row", F.sum("_n").over(down))
    across = Window.partitionBy("doc", "page", "row").orderBy("x")
    gap = F.col("x") - (F.lag("x").over(across) + F.lag("width").over(across))
    placed = placed.withColumn("_t", F.when(gap > GAP, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))).withColumn("_i", F.row_number().over(across))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda s: s["_t"]), "")
    lines = placed.groupBy("doc", "page", "row").agg(F.rtrim(text).alias("text"), (F.max("size") < NOTE_SIZE).alias("is_note"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy("page", "row")))


def article_pages(lines: DataFrame) -> DataFrame:
    """lines(doc, page, text) → (doc, number, page): the first page on which each article is headed."""
    number = F.regexp_extract(F.trim("text"), HEADING, 1)
    heads = lines.select("doc", "page", F.regexp_replace(F.lower(number), r"(?<=[0-9])\s*-?\s*(?=[a-z])", " ").alias("number")).filter("number <> ''")
    return heads.groupBy("doc", ids.article_key(F.col("number")).alias("_k")).agg(F.min("page").alias("page"), F.min("number").alias("number")).select("doc", "number", "page")
