"""Citations of acts in running text, without leaving the JVM.

A citation is marked where it stands by one regexp_replace; what lies between the marks is split off, so each citation is seen together with
the characters before it, in which the cited article is looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ids

# How acts are named, the more specific before the more general.
TYPES = (
    r"Legge\s+Costituzionale",
    r"Legge\s+Qualificata",
    r"Decreto\s+Delegato",
    r"Decreto(?:\s*[-–—]\s*|\s+)Legge",
    r"Decreto\s+Reggenziale",
    r"Decreto\s+Consi(?:g)?liare",
    r"Decreto",
    r"Regolamento",
    r"Leggi",
    r"Legge",
    r"Errata\s+Corrige",
    r"Notifica",
    r"Ordinanza",
    r"Verbale",
    r"Statuto",
    r"L\.\s?C\.",
    r"L\.\s?Q\.",
    r"D\.\s?D\.",
    r"D\.\s?L\.",
    r"D\.\s?C\.",
    r"L\.",
)
# What abbreviations and the plural stand for.
ABBREVIATIONS = {"l.": "legge", "leggi": "legge", "l.c.": "legge costituzionale", "l.q.": "legge qualificata", "d.d.": "decreto delegato", "d.l.": "decreto legge", "d.c.": "decreto consiliare"}
MONTH = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
DATED = rf"[0-9]{{1,2}}\s*[°º]?\s+(?:{MONTH})\s+([0-9]{{4}})\s*,?\s*"
NUMBER_MARK = r"n\s*[.°º]\s*[°º]?\s*"
CITATION = rf"(?iU)(?<![A-Za-zÀ-ÿ])(?:{'|'.join(TYPES)})\s*(?:del\s+)?(?:{DATED.replace('([0-9]', '(?:[0-9]')})?(?:{NUMBER_MARK})?[0-9]+(?:\s*/\s*[0-9]{{4}}(?![0-9]))?"
PARTS = rf"(?iU)^({'|'.join(TYPES)})\s*(?:del\s+)?(?:{DATED})?({NUMBER_MARK})?([0-9]+)(?:\s*/\s*([0-9]{{4}}))?"
# The only words that may stand between a cited article and its act.
BETWEEN = (
    "ed", "e", "primo", "second[oa]", "terz[oa]", "quart[oa]", "quint[oa]", "sest[oa]", "ultim[oa]", "penultim[oa]", "comm[ai]", "capo", "cap", "titolo", "sezione", "letter[ae]", "lett", "punt[oi]",
    "numero", "n", "bis", "ter", "quater", "dello", "della", "degli", "delle", "dell", "dalla", "dal", "dei", "del", "allegato", "[IVXLC]+", "[0-9]+", r"[a-z]\)", "[a-z](?![a-z])",
)
LINKS = "dell[ao]|dell'|del|della|dei|degli|di|al|alla|allo|ai|agli"
TARGET = rf"(?i)(?:artt?\.?|articol[oi])\s*([0-9]+)(?:\s*,?\s*comm[ai]\s*([0-9]+))?((?:[\s,;.')]*(?:{'|'.join(BETWEEN)})){{0,8}}[\s,;.')]*(?:{LINKS}))\s*$"
IN_ANNEX = r"(?i)\bdell['’]\s*allegat"
MARK = "\x02"
REACH = 90


def _marked(text: Column) -> Column:
    """array<struct<before, found, lead>>: each citation, the characters before it, and whether nothing but a heading leads to it."""
    parts = F.split(F.regexp_replace(F.translate(text, MARK, " "), CITATION, f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast("array<struct<before:string,found:string,at:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("b"), none.alias("f"))

    def step(a: Column, x: Column) -> Column:
        odd = a["i"] % 2 == 1
        one = F.array(F.struct(a["b"].alias("before"), x.alias("found"), F.floor(a["i"] / 2).cast("int").alias("at")))
        return F.struct((a["i"] + 1).alias("i"), F.when(odd, "").otherwise(F.right(x, F.lit(REACH))).alias("b"), F.when(odd, F.concat(a["f"], one)).otherwise(a["f"]).alias("f"))

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda a: a["f"])).otherwise(none)


def extracted(rows: DataFrame, text: str, key: str, act: str | None = None, preamble: str | None = None) -> DataFrame:
    """(key, ord, type, number, year, cited_article, cited_par, cite_text, target) of every citation in the rows' text.

    type is in lower case and spelled out. A match without "n." counts only as number/year with a year from 1600 to 2099; a citation without a
    year stays with a null one. With `act`, citations of the row's own act are dropped; where the boolean column `preamble` is true, so is the act's own
    heading: the first match, at the very start or behind the republic's name and a page number, with the act's number and year.
    """
    own = F.col(act) if act else F.lit(None).cast("string")
    is_preamble = F.col(preamble) if preamble else F.lit(False)
    head = F.regexp_extract(F.col(text), rf"(?is)^(.*?){CITATION[5:]}", 1)
    raw = rows.select(key, own.alias("_own"), F.coalesce(is_preamble, F.lit(False)).alias("_pre"), F.when(F.coalesce(is_preamble, F.lit(False)), head).alias("_head"), F.explode(_marked(F.col(text))).alias("c"))
    found = F.col("c.found")
    group = lambda k: F.regexp_extract(found, PARTS, k)
    kind = F.trim(F.regexp_replace(F.lower(group(1)), r"\s+", " "))
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    parts = raw.select(
        key, "_own", "_pre", "_head", F.col("c.before").alias("before"), F.col("c.at").alias("ord"), F.trim(F.regexp_replace(found, r"\s+", " ")).alias("cite_text"),
        F.coalesce(F.try_element_at(full, F.replace(kind, F.lit(" "), F.lit(""))), kind).alias("type"), group(2).alias("y1"), group(3).alias("mark"), group(4).try_cast("int").alias("number"), group(5).alias("y2"),
    )
    year = F.coalesce(F.nullif("y2", F.lit("")), F.nullif("y1", F.lit(""))).try_cast("int")
    parts = parts.withColumn("year", year).filter((F.col("mark") != "") | F.coalesce(F.col("y2").try_cast("int").between(1600, 2099), F.lit(False)))
    article, par, between = (F.regexp_extract("before", TARGET, k) for k in (1, 2, 3))
    cited = F.when(article != "", F.when(F.concat(F.lit(" "), between).rlike(IN_ANNEX), F.concat(F.lit("all-"), article)).otherwise(article))
    parts = parts.withColumns({"cited_article": cited, "cited_par": F.nullif(par, F.lit("")), "target": F.when(F.col("year").isNotNull(), ids.act_id(F.col("type"), F.col("number"), F.col("year")))})
    heading = F.col("_pre") & (F.col("ord") == 0) & F.col("_head").rlike(r"(?i)^\s*(?:[0-9]+\s+)?(?:repubblica\s+di\s+san\s+marino\s*)?$") & (F.regexp_extract("_own", r"^[A-Z]+-([0-9]+)-[0-9]{4}", 1).try_cast("int") == F.col("number")) & (F.regexp_extract("_own", r"^[A-Z]+-[0-9]+-([0-9]{4})", 1).try_cast("int") == F.col("year"))
    self_cited = F.col("target") == F.col("_own")
    parts = parts.filter(~F.coalesce(heading, F.lit(False)) & ~F.coalesce(self_cited, F.lit(False)))
    return parts.select(key, "ord", "type", "number", "year", "cited_article", "cited_par", "cite_text", "target")
