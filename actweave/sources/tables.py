"""Reading and writing a corpus, and the parsed documents that it is loaded from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actweave import schema
from actweave.functions import ids
from actweave.functions.text import clean_date, repair_mojibake
from actweave.operators import graph

_CITATION = "struct<tipo:string,numero:int,anno:int,articoloCitato:string,commaCitato:string,testo:string,commaId:string,commaOrigine:string>"
_PARAGRAPH = "struct<id:string,numero:string,testo:string,numerazioneAnomala:boolean,commaImplicito:boolean,parte:string,numeroOriginale:string>"
_CHILD = "struct<id:string,tipo:string,numero:string,rubrica:string,ordine:int>"
#: A parsed act, as the parser writes it.
PARSED = (
    "id string, tipo string, numero string, anno int, data string, dataPubblicazione string, dataEntrataVigore string, titolo string, urlScheda string, urlDocumento string, preambolo string, "
    f"citazioniPreambolo array<{_CITATION}>, partizioni array<struct<id:string,tipo:string,numero:string,rubrica:string,ordine:int,figli:array<{_CHILD}>>>, "
    f"articoli array<struct<id:string,numero:string,rubrica:string,partizioneId:string,ordine:double,numeroOriginale:string,allegato:string,tabella:boolean,strutturaDedotta:boolean,commi:array<{_PARAGRAPH}>,citazioni:array<{_CITATION}>>>"
)
# Above this share of out-of-order numbers, or this often the same number, a document's numbering is none.
DISORDER, SAME_NUMBER = 0.25, 60


def read(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(spark.createDataFrame([], schema.TABLES[n]).schema).parquet(f"{path}/{n}") for n in names or schema.TABLES}


def write(tables: dict[str, DataFrame], path: str) -> None:
    for n, rows in tables.items():
        schema.conformed(rows, n).write.mode("overwrite").parquet(f"{path}/{n}")


def parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, what could not be read): JSON files of parsed acts under an explicit schema; a broken file is kept aside and stops nothing."""
    rows = spark.read.schema(PARSED + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return rows.filter("_broken IS NULL AND id IS NOT NULL").drop("_broken"), rows.filter("_broken IS NOT NULL OR id IS NULL").select("file", "_broken")


def with_reasons(documents: DataFrame) -> DataFrame:
    """`documents` with `reject_reason`: why an act must not be loaded, null if nothing speaks against it."""
    pars = F.flatten(F.transform("articoli", lambda a: a["commi"]))
    numbers = F.transform("articoli", lambda a: F.coalesce(a["numeroOriginale"], a["numero"]))
    most = F.array_max(F.transform(F.array_distinct(numbers), lambda n: F.size(F.filter(numbers, lambda m: m == n))))
    order = F.transform(F.filter("articoli", lambda a: a["allegato"].isNotNull()), lambda a: F.regexp_extract(F.coalesce(a["numeroOriginale"], a["numero"]), "([0-9]+)", 1).try_cast("int"))
    back = F.size(F.filter(F.arrays_zip(F.slice(order, 1, F.greatest(F.size(order) - 1, F.lit(0))).alias("a"), F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))).alias("b")), lambda x: x["b"] < x["a"]))
    binary = F.exists(pars, lambda c: F.coalesce(c["testo"], F.lit("")).rlike("[\\x00-\\x08\\x0e-\\x1f]{3}"))
    reason = (
        F.when(F.exists(pars, lambda c: c["id"].isNull()), "paragraph without id")
        .when(binary, "binary text")
        .when(F.coalesce(most, F.lit(0)) > SAME_NUMBER, "one number too often")
        .when((F.size(order) > 20) & (back > DISORDER * F.size(order)), "numbers out of order")
    )
    return documents.withColumn("reject_reason", reason)


def flattened(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed documents: acts, articles with their part and chapter, paragraphs, and citations that name a year.

    An annex's article takes no part or chapter of the body. Citations of paragraphs and of preambles share one table; `cites` still holds the ids that
    the texts name.
    """
    docs = documents.withColumnRenamed("id", "act_id")
    number, year = ids.repaired_extremes(F.col("numero"), F.col("anno"), F.col("data"))
    day = lambda c: clean_date(F.col(c).try_cast("date"), year.try_cast("int"))
    acts = docs.select(
        F.col("act_id").alias("id"), ids.prefix(F.col("tipo")).alias("prefix"), F.col("tipo").alias("type"), number.alias("number"), number.try_cast("int").alias("number_int"), year.try_cast("int").alias("year"), day("data").alias("act_date"),
        F.col("titolo").alias("title"), day("dataPubblicazione").alias("pub_date"), day("dataEntrataVigore").alias("force_date"), F.col("urlScheda").alias("url_card"), F.col("urlDocumento").alias("url_doc"), F.col("preambolo").alias("preamble"),
        F.lit(True).alias("loaded"), ids.label(F.col("tipo")).alias("label"),
    )
    top = docs.select("act_id", F.explode("partizioni").alias("p"))
    parts = top.select("act_id", F.col("p.id").alias("part_id"), F.col("p.numero").alias("part_title"), F.col("p.rubrica").alias("part_title_rubric"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("chapter_rubric")).unionByName(
        top.select("act_id", F.col("p.numero").alias("part_title"), F.col("p.rubrica").alias("part_title_rubric"), F.explode("p.figli").alias("f")).select("act_id", F.col("f.id").alias("part_id"), "part_title", "part_title_rubric", F.col("f.numero").alias("chapter"), F.col("f.rubrica").alias("chapter_rubric"))
    )
    art = docs.select("act_id", F.explode("articoli").alias("a"))
    own = art.select("act_id", F.when(F.col("a.allegato").isNull(), F.col("a.partizioneId")).alias("part_id"), F.col("a.id").alias("id"), F.col("a.numero").alias("number"), F.col("a.rubrica").alias("rubric"), F.col("a.ordine").alias("ord"), F.col("a.numeroOriginale").alias("number_original"), F.col("a.allegato").alias("annex"))
    articles = own.join(parts, ["act_id", "part_id"], "left").drop("part_id")
    par = art.select("act_id", F.col("a.id").alias("article_id"), F.posexplode("a.commi").alias("ord", "c"))
    paragraphs = par.select(F.col("c.id").alias("id"), "article_id", "act_id", F.col("c.numero").alias("number"), F.col("c.testo").alias("text"), (F.col("ord") + 1).alias("ord"), F.col("c.numerazioneAnomala").alias("anomalous"), F.col("c.commaImplicito").alias("implicit"), F.col("c.parte").alias("part"), F.col("c.numeroOriginale").alias("number_original"))

    def cited(rows: DataFrame, src: str, kind: str, origin: str | None) -> DataFrame:
        return rows.filter("c.anno IS NOT NULL").select(F.expr(src).alias("src_id"), F.lit(kind).alias("src_kind"), F.col("act_id").alias("src_act_id"), ids.act_id(F.col("c.tipo"), F.col("c.numero"), F.col("c.anno")).alias("dst_act_id"), F.col("c.testo").alias("cite_text"), F.col("c.articoloCitato").alias("cited_article"), F.col("c.commaCitato").alias("cited_par"), F.lit(origin).cast("string").alias("origin"))

    cites = cited(art.select("act_id", F.explode("a.citazioni").alias("c")), "c.commaId", "paragraph", None).unionByName(cited(docs.select("act_id", F.explode("citazioniPreambolo").alias("c")), "act_id", "act", "preamble"))
    return {n: schema.conformed(rows, n) for n, rows in {"acts": acts, "articles": articles, "paragraphs": paragraphs, "cites": cites}.items()}


def resolved_by_date(cites: DataFrame, acts: DataFrame) -> DataFrame:
    """`cites` whose target is no act, moved to the one act of the same number and year whose date the citation states; `resolved_from` keeps the id that it named."""
    from actweave.functions.text import written_date

    parts = [F.regexp_extract("dst_act_id", r"^[A-Z]+-([0-9]+)-([0-9]{4})$", k) for k in (1, 2)]
    known = acts.filter("loaded").select(F.col("id").alias("_id"), "act_date")
    dated = known.filter("act_date IS NOT NULL").select(F.regexp_extract("_id", r"^[A-Z]+-([0-9]+)-([0-9]{4})$", 1).alias("_n"), F.regexp_extract("_id", r"^[A-Z]+-([0-9]+)-([0-9]{4})$", 2).alias("_y"), F.col("act_date").alias("_d"), "_id").filter("_n <> ''")
    one = graph.unique(dated, ["_n", "_y", "_d"], "_id")
    lost = cites.join(known.select(F.col("_id").alias("dst_act_id")), "dst_act_id", "left_anti").select("dst_act_id", "cite_text", parts[0].alias("_n"), parts[1].alias("_y"), written_date(F.col("cite_text")).alias("_d")).distinct()
    moved = lost.join(one, ["_n", "_y", "_d"]).select("dst_act_id", "cite_text", F.col("_id").alias("_to"))
    out = cites.join(moved, ["dst_act_id", "cite_text"], "left")
    return out.withColumn("resolved_from", F.when(F.col("_to").isNotNull(), F.col("dst_act_id")).otherwise(F.col("resolved_from"))).withColumn("dst_act_id", F.coalesce("_to", "dst_act_id")).drop("_to").select(cites.columns)


def loaded(documents: DataFrame) -> dict[str, DataFrame]:
    """All tables of the documents that nothing speaks against, stubs of cited acts included.

    Citations are resolved by date, self-citations dropped, each edge kept once. An edge to an article is written only if the article is there.
    """
    good = with_reasons(documents).filter("reject_reason IS NULL").drop("reject_reason")
    t = flattened(good)
    t["acts"] = repair_mojibake(t["acts"], "title")
    cites = resolved_by_date(t["cites"], t["acts"]).filter("src_act_id <> dst_act_id")
    t["cites"] = graph.latest(cites, ["src_id", "dst_act_id", "cited_article"], [F.col("cite_text").asc(), F.col("cited_par").asc_nulls_last()])
    t["acts"] = t["acts"].unionByName(stub_acts(t["cites"], t["acts"]))
    target = t["articles"].select("act_id", F.col("id").alias("dst_article_id"), ids.article_key(F.col("number")).alias("_k"))
    edges = t["cites"].filter("src_kind = 'paragraph' AND cited_article IS NOT NULL").select(F.col("src_id").alias("par_id"), F.col("dst_act_id").alias("act_id"), ids.article_key(F.col("cited_article")).alias("_k")).join(target, ["act_id", "_k"]).select("par_id", "dst_article_id").distinct()
    t["cites_article"] = schema.conformed(edges, "cites_article")
    return t


def stub_acts(cites: DataFrame, acts: DataFrame) -> DataFrame:
    """Acts that are cited and not there, as rows with nothing but what their id says."""
    lost = cites.select(F.col("dst_act_id").alias("id")).distinct().join(acts.select("id"), "id", "left_anti")
    p, n, y = (F.regexp_extract("id", r"^([A-Z]+)-(.+)-([0-9]+)$", k) for k in (1, 2, 3))
    known = F.create_map(*[F.lit(x) for pair in ids.LABELS.items() for x in pair])
    return schema.conformed(lost.select("id", p.alias("prefix"), n.alias("number"), n.try_cast("int").alias("number_int"), y.try_cast("int").alias("year"), F.lit(False).alias("loaded"), F.try_element_at(known, p).alias("label")), "acts")
