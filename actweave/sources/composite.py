"""Composite acts: a law with tables and regulations behind it that have articles of their own, split by configured openings.

Which section a line belongs to is the last opening at or before it; an act's few openings meet its lines as one array, so lines and intervals never meet as pairs,
and lines that lie by act stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave.functions import citations, ids
from actweave.operators import graph

# A year alone on its line, a heading with a reference mark.
YEAR_ALONE = r"(?U)^\s*\d{4}\.?\s*$"
STARRED = r"(?U)^(\s*Art\.?\s*\d+)\s*\(\*\)\s*$"


def mended(lines: DataFrame) -> DataFrame:
    """lines(act_id, line, text): a year alone on its line goes back to the end of the line before, and headings lose their reference marks."""
    by = Window.partitionBy("act_id").orderBy("line")
    blank = F.coalesce(F.trim(F.lag("text").over(by)) == "", F.lit(True))
    rows = lines.select("act_id", "line", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_own", ~F.col("text").rlike(YEAR_ALONE) | blank).withColumn("_g", F.sum(F.col("_own").cast("int")).over(by))
    years = F.collect_list(F.when(~F.col("_own"), F.trim("text"))).over(Window.partitionBy("act_id", "_g").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole = F.when(F.size(years) > 0, F.concat(F.rtrim("text"), F.lit(" "), F.array_join(years, " "))).otherwise(F.col("text"))
    return rows.withColumn("text", whole).filter("_own").select("act_id", "line", F.regexp_replace("text", STARRED, "$1").alias("text"))


def marked(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(act_id, line, text, _opens, _ends): mended lines of the acts with sections(act_id, section, opens, ends), with the sections whose pattern the line bears and whether it bears the act's end."""
    conf = sections.groupBy("act_id").agg(F.collect_list(F.struct("section", "opens")).alias("_conf"), F.first("ends").alias("_end"))
    rows = mended(lines).join(conf, "act_id")
    return rows.select("act_id", "line", "text", F.expr("transform(filter(_conf, s -> text rlike s.opens), s -> s.section)").alias("_opens"), F.expr("text rlike _end").alias("_ends"))


def opened(marked_: DataFrame, sections: DataFrame) -> DataFrame:
    """(act_id, section, line): the first of the lines of `marked` that bears the pattern of each of sections(act_id, section); null where there is none."""
    found = marked_.filter(F.size("_opens") > 0).select("act_id", "line", F.explode("_opens").alias("section"))
    return sections.select("act_id", "section").join(found.groupBy("act_id", "section").agg(F.min("line").alias("line")), ["act_id", "section"], "left")


def _judged(starts: DataFrame) -> DataFrame:
    order = Window.partitionBy("act_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    rows = starts.withColumn("_before", F.max("line").over(order))
    fault = F.when(F.col("line").isNull(), "not found").when(F.col("line") < F.col("_before"), "out of order")
    return rows.select("act_id", "section", "line", fault.alias("fault"))


def faults(starts: DataFrame) -> DataFrame:
    """(act_id, section, fault): sections that no line opens, and sections that open before an earlier one of the configuration."""
    return _judged(starts).filter("fault IS NOT NULL").drop("line")


def fitting(starts: DataFrame) -> DataFrame:
    """The openings of acts without a fault."""
    wrong = F.bool_or(F.col("fault").isNotNull()).over(Window.partitionBy("act_id"))
    return _judged(starts).withColumn("_wrong", wrong).filter(~F.col("_wrong")).select("act_id", "section", "line")


def parted(marked_: DataFrame, starts: DataFrame) -> DataFrame:
    """(act_id, section, line, text): the lines of `marked` under their sections, for the acts with `starts`, which have no faults (see `divided`)."""
    rows = marked_.join(starts.groupBy("act_id").agg(F.collect_list(F.struct("line", "section")).alias("_starts")), "act_id")
    last = F.expr("array_max(filter(_starts, x -> x.line <= line))")
    rows = rows.withColumn("_last", last).withColumns({"section": F.col("_last.section"), "_end": F.col("_ends") & ~F.coalesce(F.col("_last.line") == F.col("line"), F.lit(False))})
    ended = F.max(F.when(F.col("_end"), F.col("line"))).over(Window.partitionBy("act_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = F.when(F.col("_last").isNull(), F.col("_ended").isNotNull()).otherwise(F.coalesce(F.col("_ended") > F.col("_last.line"), F.lit(False)))
    return rows.withColumn("_ended", ended).filter(~over).select("act_id", "section", "line", "text")


def divided(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """lines(act_id, line, text), sections(act_id, section, opens, ends) → (act_id, section, line, text): which section each line is read with; null for the law itself.

    sections count from 1 in the order of the text; `ends` is the act's pattern of the
    promulgation, which ends the law before the first section, and a section if it comes again. Lines between an end and the next opening belong to nothing and are left
    out. A configuration that the text does not bear out is an error that names the sections. Acts without a configuration are left out.
    """
    rows = graph.written(marked(lines, sections))
    starts = graph.written(opened(rows, sections))
    if wrong := [f"{r.act_id} {r.section}: {r.fault}" for r in faults(starts).orderBy("act_id", "section").limit(20).collect()]:
        graph.discarded(rows, starts)
        raise ValueError("sections " + ", ".join(wrong))
    return parted(rows, starts)


def excluded(divided_: DataFrame, sections: DataFrame) -> DataFrame:
    """(act_id, section, heading, lines, reason): the sections without a prefix, which are not read, and how much they hold."""
    rows = divided_.join(sections.filter("prefix IS NULL").select("act_id", "section", "reason"), ["act_id", "section"])
    return rows.groupBy("act_id", "section", "reason").agg(F.trim(F.min_by("text", "line")).alias("heading"), F.count("*").alias("lines")).select("act_id", "section", "heading", "lines", "reason")


def qualified(articles: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, paragraphs, citations) of all sections under names that are theirs alone within the act: "reg-1", ".../art-reg-1/c-1".

    articles and paragraphs have `section` (null for the law) beside their columns; those of sections without a prefix are left out. Paragraphs
    keep what follows their article's id; citations are read anew, as they carry paragraph ids. ord counts over the whole act.
    """
    kept = articles.join(sections.select("act_id", "section", "prefix", F.col("kind").alias("_kind"), F.col("number").alias("_no"), F.col("rubric").alias("_title")), ["act_id", "section"], "left")
    kept = kept.filter("section IS NULL OR prefix IS NOT NULL").withColumn("_old", F.col("id"))
    inside = F.col("section").isNotNull()
    number = F.when(inside, F.concat("prefix", F.lit("-"), "number")).otherwise(F.col("number"))
    place = F.row_number().over(Window.partitionBy("act_id").orderBy(F.coalesce("section", F.lit(0)), "ord", "_old")) - 1
    kept = kept.withColumns({"number": number, "id": F.when(inside, ids.article_id(F.col("act_id"), number)).otherwise(F.col("id")), "ord": place.cast("double")})
    if "part_title" in articles.columns:
        kept = kept.withColumns({"part_title": F.when(inside, F.concat_ws(" ", "_kind", "_no")).otherwise(F.col("part_title")), "part_title_rubric": F.when(inside, F.col("_title")).otherwise(F.col("part_title_rubric"))})
    names = kept.select(F.col("_old").alias("article_id"), "section", F.col("id").alias("_new"))
    here = paragraphs["section"].eqNullSafe(names["section"]) & (paragraphs["article_id"] == names["article_id"])
    moved = paragraphs.join(names, here).select(*[paragraphs[c] for c in paragraphs.columns], names["_new"])

    def under(c: Column) -> Column:
        return F.concat("_new", F.substring(c, F.length("article_id") + 1, F.length(c)))

    moved = moved.withColumn("id", under(F.col("id"))).withColumn("article_id", F.col("_new")).drop("_new")
    cited = citations.extracted(moved, "text", "id", act="act_id")
    return kept.select(*articles.columns), moved, cited
