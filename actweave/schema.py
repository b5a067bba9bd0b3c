"""The tables of a corpus: acts, articles, paragraphs, chunks, and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "acts": "id string, prefix string, type string, number string, number_int int, year int, act_date date, title string, pub_date date, force_date date, force_source string, url_card string, url_doc string, preamble string, loaded boolean, repealed boolean, repealed_by array<string>, lapsed boolean, label string",
    "articles": "id string, act_id string, number string, rubric string, ord double, part_title string, part_title_rubric string, chapter string, chapter_rubric string, number_original string, annex string, rubric_embedding array<float>, repealed boolean, repealed_by array<string>, original_text string, text_source string, text_as_of string, url_doc string, page int",
    "paragraphs": "id string, article_id string, act_id string, number string, text string, ord int, anomalous boolean, implicit boolean, part string, number_original string, embedding array<float>, repealed boolean, repealed_by array<string>",
    "chunks": "id string, paragraph_id string, ord int, start int, end int, text string, parent_fp string, embedding array<float>",
    "cites": "src_id string, src_kind string, src_act_id string, dst_act_id string, cite_text string, cited_article string, cited_par string, origin string, resolved_from string",
    "cites_article": "par_id string, dst_article_id string, origin string, named_act string, named_article string",
    "repeals": "src_act string, dst_act string, par_id string, clause string, via_ratification boolean",
    "twins": "kind string, a string, b string",
}
KEYS = {"acts": ["id"], "articles": ["id"], "paragraphs": ["id"], "chunks": ["id"], "cites": ["src_id", "dst_act_id", "cited_article"], "cites_article": ["par_id", "dst_article_id"], "repeals": ["src_act", "dst_act"], "twins": ["kind", "a", "b"]}


def conformed(rows: DataFrame, table: str) -> DataFrame:
    """`rows` with exactly the columns of a table, in their order and types; what is missing is null."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([], TABLES[table]).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, id): doubled keys, empty paragraphs, articles without paragraphs, and edges and parts whose holder is missing."""
    acts, articles, paragraphs = tables["acts"], tables["articles"], tables["paragraphs"]
    found = [tables[t].groupBy(*KEYS[t]).count().filter("count > 1").select(F.lit(f"doubled {t}").alias("check"), F.concat_ws("|", *KEYS[t]).alias("id")) for t in tables]
    found.append(paragraphs.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select(F.lit("empty paragraph").alias("check"), "id"))
    found.append(articles.join(paragraphs, articles["id"] == paragraphs["article_id"], "left_anti").select(F.lit("article without paragraphs").alias("check"), "id"))
    found.append(articles.join(acts, articles["act_id"] == acts["id"], "left_anti").select(F.lit("article without act").alias("check"), "id"))
    found.append(paragraphs.join(articles, paragraphs["article_id"] == articles["id"], "left_anti").select(F.lit("paragraph without article").alias("check"), "id"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
