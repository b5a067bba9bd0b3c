"""Consolidated texts: articles, their notes, the acts that changed them, who repealed what is marked as repealed, and that evidence as tables and JSON.

Lines come from a typographic scan: body(doc, line, text, x, refs) with the note numbers set small on a line, and notes(doc, line, text). What a line is
follows from its own look and its neighbours', by windows over a document's lines; matches and distances within notes become rows and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actweave import schema
from actweave.functions import ids
from actweave.functions import text as tx
from actweave.operators import graph

# Forms of headings, marks and notes of consolidated texts, and the distances that tell paragraphs, titles and repeals.
ORDINALS = "bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies|terdecies|quaterdecies"
ARTICLE = rf"(?iU)^\s*Art(?:\.|icolo)\s*(\d+)\s*(?:[-\s]\s*({ORDINALS}))?\s*\.?\s*$"
PARTITION = r"(?iU)^\s*(?:LIBRO|TITOLO|CAPO|CAPITOLO|SEZIONE)\s+[IVXLC]+\s*$"
ENUMERATOR = r"(?iU)^\s*(?:\d{1,2}\)|[a-z]\)|[a-z]\.)\s*$"
AS_OF = r"(?i)\(Aggiornato al\s+([^)]+)\)"
APPENDIX, REPEALED = "ALTRE NORME", "[ABROGATO]"
INDENT, CENTRED, HEAD_LINES = 75, 130, 400
MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
KINDS = r"Legge Costituzionale|Legge Qualificata|Legge|Decreto\s*[-–—]?\s*Legge|Decreto Delegato|Decreto Reggenziale|Decreto Consiliare|Decreto"
CHANGES = "Modifiche legislative"
CHANGE = (
    rf"(?iU)(?:{KINDS})(?:\s+\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\s*,?\s*n\.?\s*\d+|\s*n\.?\s*\d+\s*/\s*\d{{4}})"
    r"(?:[^:\n]{0,80}?,?\s*(?:Articolo|Art\.?)\s*\d+[a-z\-]*(?:\s*,?\s*comma\s+\S+?)?\s*(?::|(?=\s*\()|(?=\s*\d+\.\s))|[^:\n]{0,80}?:)"
)
CHANGE_PARTS = (
    rf"(?iU)^({KINDS})(?:\s+\d{{1,2}}\s+(?:{MONTHS})\s+(\d{{4}})\s*,?\s*n\.?\s*(\d+)|\s*n\.?\s*(\d+)\s*/\s*(\d{{4}}))"
    r"(?:[^:\n]{0,80}?,?\s*(?:Articolo|Art\.?)\s*(\d+[a-z\-]*)(?:\s*,?\s*comma\s+(\S+?))?\s*(?::|$)|[^:\n]{0,80}?:)"
)
ORIGIN = rf"(?iU)Testo originario\s*\(\s*({KINDS})\s*n\.?\s*(\d+)\s*/\s*(\d{{4}})(?:\s*,\s*(?:Articolo|Art\.?)\s*(\d+))?"
IS_REPEALED = r"(?iU)\babrogat[oiae]\b"
NUMBER = rf"(?iU)\d+(?:[\s-](?:{ORDINALS}))?"
REFERENCE = rf"(?iU)\bart(?:t?\.|icol[oi])\s*\d+(?:[\s-](?:{ORDINALS}))?(?:\s*(?:,|e|ed)\s*\d+(?:[\s-](?:{ORDINALS}))?)*"
FRAGMENT = r"(?iU)\b(?:comma|punto|numero|n\.|lettera)\b"
NEAR = 160


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def articles(body: DataFrame) -> DataFrame:
    """body(doc, line, text, x, refs), texts without space at their ends → (doc, ord, number, rubric, paragraphs, text, notes, repealed, repealed_in_part).

    An article's rubric stands in brackets below its heading, over as many lines as it takes to close. Titles of parts are left out: numbered ones, those in the
    middle of the page and those without a small letter, unless they hold a mark in square brackets. A line opens a paragraph if it is the
    first, or is indented, begins like a sentence, and the line before neither is a bare enumerator nor goes on. What follows the appendix's title is another text.
    notes are the sorted numbers of all notes on the article's lines.
    """
    by = Window.partitionBy("doc").orderBy("line")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("text").rlike(ARTICLE)
    rows = body.select("doc", "line", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("refs", F.array().cast("array<int>")).alias("refs"))
    rows = rows.withColumn("_head", own).withColumn("ord", F.sum(F.col("_head").cast("int")).over(so_far)).withColumn("_end", F.bool_or((F.col("text") == APPENDIX) & (F.col("ord") > 0)).over(so_far))
    rows = rows.filter((F.col("ord") > 0) & ~F.col("_end") & ((F.col("text") != "") | F.col("_head")))
    part = Window.partitionBy("doc", "ord").orderBy("line")
    before, until = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = ~F.col("_head")
    opened = F.max(F.when(below & F.col("text").startswith("("), F.col("line"))).over(until)
    closed = F.max(F.when(below & F.col("text").endswith(")"), F.col("line"))).over(before)
    rows = rows.withColumn("_bracket", below & F.coalesce(opened > F.coalesce(closed, F.lit(-1)), F.lit(False)))
    bare = ~F.col("text").contains("[")
    title = F.col("text").rlike(PARTITION) | F.col("text").rlike(r"^\d{1,3}$") | ((F.col("x") >= CENTRED) & bare) | ((F.upper("text") == F.col("text")) & F.col("text").rlike("[A-ZÀ-Ù]{3}") & bare)
    rows = rows.withColumn("_title", below & title)
    first = F.min(F.when(below & ~F.col("_bracket") & ~F.col("_title"), F.col("line"))).over(Window.partitionBy("doc", "ord"))
    rows = rows.withColumn("_first", first)
    rubric = F.col("_bracket") & (F.col("_first").isNull() | (F.col("line") < F.col("_first")))
    rows = rows.withColumn("what", F.when(F.col("_head"), "heading").when(rubric, "rubric").when(F.col("_title"), "title").otherwise("text"))
    lines = Window.partitionBy("doc", "ord", "what").orderBy("line")
    last = F.lag("text").over(lines)
    start = F.left(F.ltrim("text"), F.lit(1))
    sentence = ((F.upper(start) == start) & (F.lower(start) != start)) | start.rlike(r"(?U)\d") | start.isin("[", "«", "“")
    new = last.isNull() | ((F.col("x") >= INDENT) & ~last.rlike(ENUMERATOR) & ~F.rtrim(last).rlike("[:;,]$") & sentence)
    rows = rows.withColumn("_new", new).withColumn("par", F.sum((F.col("_new") & (F.col("what") == "text")).cast("int")).over(lines))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text", "refs"))), lambda x: x)
    pieces = rows.groupBy("doc", "ord", "what", "par").agg(texts.alias("x"))
    joined = _stripped(F.array_join(F.transform("x", lambda x: x["text"]), " "))

    def opens(acc: Column, x: Column) -> Column:
        whole = _stripped(F.concat(acc, F.lit(" "), x["text"]))
        return F.when(x["text"].endswith(")"), _stripped(F.regexp_replace(whole, r"^[()]+|[()]+$", ""))).otherwise(whole)

    pieces = pieces.select("doc", "ord", "what", "par", joined.alias("text"), F.flatten(F.transform("x", lambda x: x["refs"])).alias("refs"), F.when(F.col("what") == "rubric", F.aggregate("x", F.lit(""), opens)).alias("rubric"))
    number = F.concat(F.regexp_extract("text", ARTICLE, 1), F.when(F.regexp_extract("text", ARTICLE, 2) != "", F.concat(F.lit("-"), F.lower(F.regexp_extract("text", ARTICLE, 2)))).otherwise(F.lit("")))
    out = pieces.groupBy("doc", "ord").agg(
        F.max(F.when(F.col("what") == "heading", number)).alias("number"),
        F.max("rubric").alias("rubric"),
        F.array_sort(F.collect_list(F.when((F.col("what") == "text") & (F.col("text") != ""), F.struct("par", "text")))).alias("p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("notes"),
    )
    out = out.withColumn("paragraphs", F.transform("p", lambda x: x["text"])).withColumn("text", F.array_join("paragraphs", " "))
    gone = F.coalesce(F.replace(F.get("paragraphs", F.lit(0)), F.lit(" "), F.lit("")).rlike(r"^\[ABROGATO\][.;]?$"), F.lit(False))
    return out.select("doc", "ord", "number", "rubric", "paragraphs", "text", "notes", gone.alias("repealed"), (~gone & F.contains("text", F.lit(REPEALED))).alias("repealed_in_part"))


def notes(lines: DataFrame, most: DataFrame) -> DataFrame:
    """lines(doc, line, text), most(doc, n) → (doc, note, text): notes 1 to n, each from the line that its number opens.

    Numbers count only in their sequence. The last note ends where any further number opens a line: there another text's notes begin.
    """
    n = F.regexp_extract("text", r"(?U)^(\d{1,3}) \S", 1).try_cast("int")
    rows = lines.select("doc", "line", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", n)

    def step(a: Column, x: Column) -> Column:
        return F.when(x["n"] == a["want"], F.struct((a["want"] + 1).alias("want"), F.array_append(a["out"], x["line"]).alias("out"))).otherwise(a)

    kind = lines.schema["line"].dataType.simpleString()
    opened = rows.filter("n IS NOT NULL").join(most.withColumnRenamed("n", "_most"), "doc").filter(F.col("n") <= F.col("_most"))
    begin = F.struct(F.lit(1).alias("want"), F.array().cast(f"array<{kind}>").alias("out"))
    starts = opened.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line", "n"))).alias("x")).select("doc", F.posexplode(F.aggregate("x", begin, step, lambda a: a["out"])).alias("k", "line"))
    so_far = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts.select("doc", "line", (F.col("k") + 1).alias("_k")), ["doc", "line"], "left")
    rows = rows.withColumn("note", F.max("_k").over(so_far)).withColumn("_last", F.max("_k").over(Window.partitionBy("doc")))
    after = F.sum((F.col("n").isNotNull() & (F.col("note") == F.col("_last")) & F.col("_k").isNull()).cast("int")).over(so_far)
    rows = rows.withColumn("_after", after).filter("note IS NOT NULL AND _after = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc", "note").agg(text.alias("text")).select("doc", "note", _stripped(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))


def changes(noted: DataFrame) -> DataFrame:
    """noted(doc, ord, note, text) → (doc, ord, note, k, act, article, paragraph, text): the acts listed under a note's changes; the text of each reaches to the next."""
    tail = F.regexp_extract("text", rf"(?is)^.*?{CHANGES}(.*)$", 1)
    rows = noted.select("doc", "ord", "note", tail.alias("tail")).filter("tail <> ''").withColumn("x", tx.occurrences(F.col("tail"), CHANGE))
    each = F.transform("x", lambda x, i: F.struct(x["t"].alias("t"), x["e"].alias("e"), F.coalesce(F.get(F.transform("x", lambda y: y["s"]), i + 1), F.length("tail")).alias("next")))
    rows = rows.withColumn("x", each).select("doc", "ord", "note", "tail", F.posexplode("x").alias("k", "x"))
    part = lambda k: F.regexp_extract("x.t", CHANGE_PARTS, k)
    either = lambda a, b: F.coalesce(F.nullif(part(a), F.lit("")), part(b)).cast("int")
    act = ids.act_id(F.regexp_replace(part(1), r"\s+", " "), either(3, 4), either(2, 5))
    text = _stripped(F.substring(F.col("tail"), F.col("x.e") + 1, F.col("x.next") - F.col("x.e")))
    return rows.select("doc", "ord", "note", "k", act.alias("act"), F.nullif(part(6), F.lit("")).alias("article"), F.nullif(part(7), F.lit("")).alias("paragraph"), text.alias("text"))


def origins(noted: DataFrame) -> DataFrame:
    """noted(doc, ord, note, text) → (doc, ord, act, article): the act that brought an article in, from the first of its notes that says so."""
    part = lambda k: F.regexp_extract("text", ORIGIN, k)
    act = ids.act_id(F.regexp_replace(part(1), r"\s+", " "), part(2).cast("int"), part(3).cast("int"))
    rows = noted.filter(F.col("text").rlike(ORIGIN)).select("doc", "ord", F.struct("note", act.alias("act"), F.nullif(part(4), F.lit("")).alias("article")).alias("x"))
    return rows.groupBy("doc", "ord").agg(F.min("x").alias("x")).select("doc", "ord", "x.act", "x.article")


def near(a: DataFrame, b: DataFrame, keys: list[str], reach: int = NEAR) -> DataFrame:
    """Pairs of spans a(keys, s, e, ...) and b(keys, s, e, ...) that do not overlap and are at most `reach` characters apart, with `gap_s`, `gap_e`.

    An equality join on the keys and on stretches of text: what is so near lies in the same stretch or in the next one, so a long text with many spans isn't paired as
    a whole. Columns of a are followed by those of b as `b_...`. A stretch is as long as reach and the longest span of b, at most `reach` more.
    """
    wide = 2 * reach
    rest = [c for c in b.columns if c not in keys]
    left = a.withColumn("_w", F.explode(F.array(*[F.floor(F.col("s") / wide) + d for d in (-1, 0, 1)])))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest], F.floor(F.col("s") / wide).alias("_w"))
    after, ahead = F.col("b_s") > F.col("e"), F.col("b_e") < F.col("s")
    pairs = left.join(right, [*keys, "_w"]).drop("_w").withColumn("gap_s", F.when(after, F.col("e")).when(ahead, F.col("b_e"))).withColumn("gap_e", F.when(after, F.col("b_s")).when(ahead, F.col("s")))
    return pairs.filter(F.col("gap_e") - F.col("gap_s") <= reach)


def repealers(arts: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc, ord, act): of repealed articles, the acts whose listed text says so.

    The text names the article within NEAR characters of the word for repealed, on either side, and no part of an article is named between the two.
    """
    key = ["doc", "ord", "note", "k"]
    rows = changed.join(arts.filter("repealed").select("doc", "ord", F.col("number").alias("_own")), ["doc", "ord"])
    said = rows.select(*key, "act", "_own", "text", F.explode(tx.occurrences(F.col("text"), REFERENCE)).alias("m"))
    numbers = said.select(*key, "act", "_own", "text", F.col("m.s").alias("_m"), F.posexplode(tx.occurrences(F.col("m.t"), NUMBER)).alias("_i", "x"))
    own = numbers.filter(ids.article_key(F.col("x.t")) == ids.article_key(F.col("_own")))
    # the first number's span begins with the word for article
    refs = own.select(*key, "act", "text", F.when(F.col("_i") == 0, F.col("_m")).otherwise(F.col("_m") + F.col("x.s")).alias("s"), (F.col("_m") + F.col("x.e")).alias("e"))
    falls = rows.select(*key, F.explode(tx.occurrences(F.col("text"), IS_REPEALED)).alias("x")).select(*key, "x.s", "x.e")
    pairs = near(refs, falls, key)
    between = F.substring(F.col("text"), F.col("gap_s") + 1, F.col("gap_e") - F.col("gap_s"))
    return pairs.filter(~between.rlike(FRAGMENT)).select("doc", "ord", "act").distinct()


def read(body: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Tables `articles`, `notes`, `changes`, `origins`, `repealers` and `as_of`(doc, as_of) of consolidated documents. What several of them need is written once."""
    arts = graph.written(articles(body))
    each = arts.select("doc", "ord", F.explode("notes").alias("note"))
    found = graph.written(notes(lines, each.groupBy("doc").agg(F.max("note").alias("n"))))
    noted = each.join(found, ["doc", "note"])
    changed = graph.written(changes(noted))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    day = F.regexp_extract("text", AS_OF, 1)
    first = body.withColumn("_n", place).filter((F.col("_n") <= HEAD_LINES) & (day != "")).groupBy("doc").agg(F.min_by(F.trim(day), "line").alias("as_of"))
    return {"articles": arts, "notes": found, "changes": changed, "origins": origins(noted), "repealers": repealers(arts, changed), "as_of": first}


def amendments(t: dict[str, DataFrame], read_: dict[str, DataFrame], acts: DataFrame, origin: str) -> DataFrame:
    """Edges cites_article from the paragraphs of amending articles to the articles that they changed or brought in; acts(doc, act_id) says whose text a document is.

    Of an amending article the paragraphs that name the changed one; all of them, if none does.
    """
    said = read_["changes"].select("doc", "ord", "act", "article").unionByName(read_["origins"]).filter("article IS NOT NULL").distinct()
    target = read_["articles"].join(acts, "doc").select("doc", "ord", ids.article_id(F.col("act_id"), F.col("number")).alias("dst_article_id"), F.regexp_extract("number", r"^\d+", 0).alias("_n"))
    pars = t["paragraphs"].select(F.col("id").alias("par_id"), "article_id", "text").join(t["articles"].select(F.col("id").alias("article_id"), F.col("act_id").alias("act"), F.col("number").alias("article")), "article_id")
    rows = said.join(target, ["doc", "ord"]).join(pars, ["act", "article"])
    names = F.array_contains(F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"(?i)articol[oi]\s+(\d+)\b"), F.lit(1)), lambda x: x), F.col("_n"))
    rows = rows.withColumn("_names", names).withColumn("_any", F.bool_or("_names").over(Window.partitionBy("act", "article", "dst_article_id")))
    rows = rows.filter("_names OR NOT _any").select("par_id", "dst_article_id", F.lit(origin).alias("origin")).distinct()
    return schema.conformed(rows, "cites_article")


EVIDENCE = "norma string, fonte string, aggiornatoAl string, articoli array<struct<articolo: string, fonti: array<string>, articoloId: string, partizione: string>>"


def evidence(read_: dict[str, DataFrame], acts: DataFrame, source: str) -> DataFrame:
    """(norma, fonte, aggiornatoAl, articoli): one row for each document's act, as its evidence file holds it: the repealed articles and by whom."""
    gone = read_["articles"].filter("repealed").select("doc", "ord", "number")
    by = read_["repealers"].groupBy("doc", "ord").agg(F.array_sort(F.collect_set("act")).alias("fonti"))
    one = gone.join(by, ["doc", "ord"], "left").join(acts, "doc")
    item = F.struct("ord", F.col("number").alias("articolo"), F.coalesce("fonti", F.array().cast("array<string>")).alias("fonti"), ids.article_id(F.col("act_id"), F.col("number")).alias("articoloId"), F.lit(None).cast("string").alias("partizione"))
    rows = one.groupBy("doc", "act_id").agg(F.array_sort(F.collect_list(item)).alias("x")).join(read_["as_of"], "doc", "left")
    listed = F.transform("x", lambda x: F.struct(x["articolo"].alias("articolo"), x["fonti"].alias("fonti"), x["articoloId"].alias("articoloId"), x["partizione"].alias("partizione")))
    return rows.select(F.col("act_id").alias("norma"), F.lit(source).alias("fonte"), F.col("as_of").alias("aggiornatoAl"), listed.alias("articoli"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence files, one JSON object each."""
    return spark.read.schema(EVIDENCE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def evidenced_repeals(files: DataFrame, articles_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeals, counters): evidence(EVIDENCE) joined to the articles that exist.

    repeals(src_act, dst_act, article_id, article, clause): one row for each repealing act; an article that fell by nobody's known hand has one with
    a null src_act. counters(act_id, found, unsourced, unknown) by act.
    """
    each = files.select("norma", "fonte", "aggiornatoAl", F.explode("articoli").alias("a"))
    known = each.join(articles_.select(F.col("id").alias("_id")), F.col("a.articoloId") == F.col("_id"), "left")
    clause = F.concat(F.lit(f"{REPEALED} nel "), "fonte", F.lit(", aggiornato al "), "aggiornatoAl")
    rows = known.filter("_id IS NOT NULL").select(F.explode_outer("a.fonti").alias("src_act"), F.col("norma").alias("dst_act"), F.col("_id").alias("article_id"), F.col("a.articolo").alias("article"), clause.alias("clause"))
    found, empty = F.col("_id").isNotNull(), F.coalesce(F.size("a.fonti"), F.lit(0)) <= 0
    counters = known.groupBy(F.col("norma").alias("act_id")).agg(F.count_if(found).alias("found"), F.count_if(found & empty).alias("unsourced"), F.count_if(~found).alias("unknown"))
    return rows, counters
