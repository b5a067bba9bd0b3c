"""Collections of consolidated acts: several acts in one document, with notes that refer to notes, repealed titles, and a plan of what to write.

The lines are those of `consolidated` with `bold`. An act begins at a heading of its own, an article at a bold heading, a title at its number; what
follows belongs to the last of these, carried by windows. Notes that send the reader to another note meet it by note and act, and titles
and articles meet the acts that repealed them by the same nearness as single texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave.functions import ids
from actweave.functions import text as tx
from actweave.operators import graph
from actweave.sources import consolidated as cs

# Headings of acts, articles and annexes, numbered paragraphs, marks of repeal, forms of notes, margins, and prefixes that stand for each other.
ACT_KINDS = r"legge\s+costituzionale|legge\s+qualificata|legge|regolamento|decreto\s*[-–—]?\s*legge|decreto\s+delegato|decreto\s+consiliare|decreto\s+reggenziale|decreto"
ACT = rf"(?iU)^({ACT_KINDS})\s+\d{{1,2}}\s+(?:{cs.MONTHS})\s+(\d{{4}})\s*,?\s*n\.?\s*(\d+)\s*\.?$"
ARTICLE = rf"(?iU)^\s*Art(?:\.|icolo)?\s*(\d+|unico)\s*(?:[-\s/]\s*({cs.ORDINALS}))?\s*\.?\s*$"
NUMBERED = rf"(?iU)^(\d{{1,3}})\s*(?:[-\s]\s*({cs.ORDINALS}))?\s*\.\s+(?=\S)"
REPEALED_WHOLE, REPEALED_PART = r"^\[ABROGAT[OA]\][.;]?$", r"\[ABROGAT[OA]\]"
ANNEX = r"(?iU)^\s*Allegat[oi]\b"
APPENDIX = r"(?U)^ALTRE NORME\b"
REPEALED_BY = r"(?iU)^(\d{1,3}\s+)Articol[oi]\s+abrogat[oi]\s+dal(?:la|lo|l['’])?\s*"
LONG_ORIGIN = rf"(?iU)Testo originario\s+({cs.KINDS})\s+\d{{1,2}}\s+(?:{cs.MONTHS})\s+(\d{{4}})\s*,?\s*n\.?\s*(\d+)\s*,\s*(?:Articolo|Art\.?)\s*(\d+)"
TITLE = r"(?U)\bTitol[oi]\s+[IVXLC]+\b"
SUBSTANTIAL = r"(?i)Testo originario|Modifiche legislative"
REFERS = r"(?iU)(?:^|:)\W*(?:vedi|vedere)\s+(?:la\s+)?nota\b\s*(?:n\.?\s*(\d+)|(precedente))?"
TITLE_IN_LIST = r"(?iU)\s+del(?:la|l['’])?\s+(?:Titolo|Capo|Capitolo|Sezione)\s+[IVXLC]+\b(?=\s*(?:,|e\b|ed\b))"
BRINGS_ARTICLE = r"(?iU)seguent[ei]\s+articol|cos[iì]['’]?\s+sostituit[oa]\s*:|sostituit[oa]\s+dal\s+seguente"
INDENT, MARGIN, SHORT_NOTE, COVERED = 80, 70, 200, 0.9
KIN = {"D": ("D", "DC", "DR"), "DL": ("DL", "DD"), "DD": ("DD", "DL")}

_KEY = ("doc", "seg")


def _by(*more: str):
    return Window.partitionBy(*_KEY, *more).orderBy("line")


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def segments(body: DataFrame) -> DataFrame:
    """body(doc, line, text, x, refs, bold) → (doc, seg, act, appendix, line, text, x, refs, bold): the lines of each act, its heading left out.

    A bold line at the margin that is an act's name and date opens an act, if an article comes before the next one (covers list acts too). A line in capitals at the margin
    opens the appendix: it ends the act before it, and the acts after it are extracts.
    """
    order = Window.partitionBy("doc").orderBy("line")
    rows = body.withColumns({"text": F.coalesce("text", F.lit("")), "refs": F.coalesce("refs", F.array().cast("array<int>")), "x": F.coalesce("x", F.lit(0))})
    head = F.coalesce("bold", F.lit(False)) & (F.col("x") < MARGIN) & F.col("text").rlike(ACT)
    other = (F.col("x") < MARGIN) & (F.upper("text") == F.col("text")) & F.col("text").rlike(APPENDIX)
    rows = rows.withColumn("_head", head).withColumn("_other", F.min(F.when(other, F.col("line"))).over(Window.partitionBy("doc")))
    rows = rows.withColumn("seg", F.sum(F.col("_head").cast("int")).over(order)).withColumn("_from", F.max(F.when(F.col("_head"), F.col("line"))).over(order))
    rows = rows.filter("seg > 0").filter(~F.coalesce((F.col("_from") < F.col("_other")) & (F.col("line") >= F.col("_other")), F.lit(False)))
    own = Window.partitionBy(*_KEY)
    part = lambda k: F.regexp_extract("text", ACT, k)
    act = F.max(F.when(F.col("_head"), ids.act_id(part(1), part(3).cast("int"), part(2).cast("int")))).over(own)
    rows = rows.withColumn("act", act).withColumn("_any", F.bool_or(~F.col("_head") & F.col("text").rlike(ARTICLE)).over(own))
    return rows.filter("_any AND NOT _head").select(*_KEY, "act", F.coalesce(F.col("_from") > F.col("_other"), F.lit(False)).alias("appendix"), "line", "text", "x", "refs", "bold")


def _classified(lines: DataFrame) -> DataFrame:
    """Lines with `kind` (what their block is: article, annex, title, none), `block`, and whether they open it."""
    rows = lines.filter((F.col("text") != "") & ~F.col("text").rlike(r"^\d{1,3}$"))
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    shouted = (F.upper(first) == first) & (F.lower(first) != first)
    sign = F.when(F.col("bold") & F.col("text").rlike(ARTICLE), "article").when(F.col("text").rlike(ANNEX) & (shouted | (F.col("x") >= cs.CENTRED)), "annex").when(F.col("text").rlike(cs.PARTITION), "title")
    rows = rows.withColumn("_sign", sign)
    # within an annex titles are nothing
    strong = F.last(F.when(F.col("_sign").isin("article", "annex"), F.col("_sign")), ignorenulls=True).over(_by())
    rows = rows.withColumn("_sign", F.when((F.col("_sign") == "title") & (strong == "annex"), None).otherwise(F.col("_sign")))
    rows = rows.withColumn("block", F.sum(F.col("_sign").isNotNull().cast("int")).over(_by())).withColumn("kind", F.last("_sign", ignorenulls=True).over(_by()))
    return rows.withColumn("opens", F.col("_sign").isNotNull()).drop("_sign")


def titles(rows: DataFrame) -> DataFrame:
    """(doc, seg, block, name, kind_of, rubric, repealed, notes): titles, chapters and sections, with the lines below them up to the next heading."""
    own = rows.filter("kind = 'title'")
    gone = ~F.col("opens") & _bare(F.col("text")).rlike(REPEALED_WHOLE)
    kind = F.initcap(F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)))
    name = F.concat(kind, F.lit(" "), F.upper(F.regexp_extract("text", r"(\S+)\s*$", 1)))
    words = F.array_sort(F.collect_list(F.when(~F.col("opens") & ~gone, F.struct("line", "text"))))
    return own.groupBy(*_KEY, "block").agg(
        F.max(F.when(F.col("opens"), name)).alias("name"),
        F.max(F.when(F.col("opens"), kind)).alias("kind_of"),
        F.nullif(F.trim(F.array_join(F.transform(words, lambda w: w["text"]), " ")), F.lit("")).alias("rubric"),
        F.bool_or(gone).alias("repealed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("notes"),
    )


def articles(rows: DataFrame) -> DataFrame:
    """(doc, seg, block, ord, number, rubric, numbers, paragraphs, notes, repealed, repealed_in_part).

    An article whose first text line has a paragraph number is numbered: a line opens a paragraph if its number is above all before, or the same with an
    ordinal. Others go by indentation and sentences, as single texts do. A mark of repeal in place of the text ends the article; its notes still count.
    """
    own = rows.filter("kind = 'article'").drop("kind")
    part = _by("block")
    before, until = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below, text = ~F.col("opens"), F.col("text")
    opened = F.max(F.when(below & text.startswith("("), F.col("line"))).over(until)
    closed = F.max(F.when(below & text.endswith(")"), F.col("line"))).over(before)
    own = own.withColumn("_bracket", below & F.coalesce(opened > F.coalesce(closed, F.lit(-1)), F.lit(False)))
    bare = ~text.contains("[")
    own = own.withColumn("_skip", below & bare & ((F.col("x") >= cs.CENTRED) | ((F.upper(text) == text) & text.rlike("[A-ZÀ-Ù]{3}"))))
    first = F.min(F.when(below & ~F.col("_bracket") & ~F.col("_skip"), F.col("line"))).over(Window.partitionBy(*_KEY, "block"))
    own = own.withColumn("_first", first)
    rubric = F.col("_bracket") & (F.col("_first").isNull() | (F.col("line") < F.col("_first")))
    own = own.withColumn("what", F.when(F.col("opens"), "heading").when(rubric, "rubric").when(F.col("_skip"), "skip").otherwise("text"))
    lines = _by("block", "what")
    shut = F.first(_bare(text).rlike(REPEALED_WHOLE)).over(lines)
    n, bis = F.regexp_extract(text, NUMBERED, 1).try_cast("int"), F.lower(F.regexp_extract(text, NUMBERED, 2))
    own = own.withColumn("_shut", shut).withColumn("n", n).withColumn("_bis", bis).withColumn("_numbered", F.first(F.col("n").isNotNull()).over(lines))
    top = F.max("n").over(lines.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag("text").over(lines)
    start = F.left(F.ltrim("text"), F.lit(1))
    sentence = ((F.upper(start) == start) & (F.lower(start) != start)) | start.rlike(r"(?U)\d") | start.isin("[", "«", "“")
    by_number = F.coalesce(top.isNull() & F.col("n").isNotNull() | (F.col("n") > top) | ((F.col("n") == top) & (F.col("_bis") != "")), F.lit(False))
    by_look = last.isNull() | ((F.col("x") >= INDENT) & ~last.rlike(cs.ENUMERATOR) & ~F.rtrim(last).rlike("[:;,]$") & sentence)
    own = own.withColumn("_new", F.when(F.col("_numbered"), by_number).otherwise(by_look)).withColumn("_at", F.row_number().over(lines))
    own = own.withColumn("what", F.when((F.col("what") == "text") & F.col("_shut") & (F.col("_at") > 1), "skip").otherwise(F.col("what")))
    own = own.withColumn("par", F.sum((F.col("_new") & (F.col("what") == "text")).cast("int")).over(_by("block", "what")))
    said = F.when(F.col("_numbered") & F.col("_new"), F.regexp_replace(text, NUMBERED, "")).otherwise(text)
    number = F.when(F.col("_numbered") & F.col("_new"), F.concat(F.col("n").cast("string"), F.when(F.col("_bis") != "", F.concat(F.lit("-"), "_bis")).otherwise(F.lit(""))))
    pieces = own.groupBy(*_KEY, "block", "what", "par").agg(
        F.array_sort(F.collect_list(F.struct("line", said.alias("t")))).alias("x"), F.flatten(F.collect_list("refs")).alias("refs"), F.max(number).alias("no"), F.min("line").alias("line"), F.max(F.when(F.col("opens"), text)).alias("head")
    )

    def opens(acc: Column, x: Column) -> Column:
        whole = cs._stripped(F.concat(acc, F.lit(" "), x["t"]))
        return F.when(x["t"].endswith(")"), cs._stripped(F.regexp_replace(whole, r"^[()]+|[()]+$", ""))).otherwise(whole)

    joined = cs._stripped(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["t"]), " "), r"(?U)\s+", " "))
    pieces = pieces.withColumn("t", joined)
    base = F.regexp_extract("head", ARTICLE, 1)
    name = F.concat(F.when(F.lower(base) == "unico", "Unico").otherwise(base), F.when(F.regexp_extract("head", ARTICLE, 2) != "", F.concat(F.lit("-"), F.lower(F.regexp_extract("head", ARTICLE, 2)))).otherwise(F.lit("")))
    one = F.struct("par", F.coalesce("no", F.col("par").cast("string")).alias("no"), "t")
    out = pieces.groupBy(*_KEY, "block").agg(
        F.max(F.when(F.col("what") == "heading", name)).alias("number"),
        F.max(F.when(F.col("what") == "rubric", F.aggregate("x", F.lit(""), opens))).alias("rubric"),
        F.array_sort(F.collect_list(F.when((F.col("what") == "text") & (F.col("t") != ""), one))).alias("p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("notes"),
    )
    out = out.withColumn("paragraphs", F.transform("p", lambda x: x["t"])).withColumn("numbers", F.transform("p", lambda x: x["no"]))
    gone = (F.size("paragraphs") > 0) & F.forall("paragraphs", lambda t: _bare(t).rlike(REPEALED_WHOLE))
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("block"))
    return out.select(*_KEY, "block", place.alias("ord"), "number", "rubric", "numbers", "paragraphs", "notes", gone.alias("repealed"), (~gone & F.array_join("paragraphs", " ").rlike(REPEALED_PART)).alias("repealed_in_part"))


def placed(arts: DataFrame, tits: DataFrame) -> DataFrame:
    """`arts` with part_title, part_title_rubric, chapter, chapter_rubric: the last title before each, and the last chapter since that title."""
    kinds = arts.select(*_KEY, "block").unionByName(tits.select(*_KEY, "block", "name", "kind_of", "rubric"), allowMissingColumns=True)
    by = Window.partitionBy(*_KEY).orderBy("block")
    top = F.last(F.when(F.col("kind_of") == "Titolo", F.struct("block", "name", "rubric")), ignorenulls=True).over(by)
    kinds = kinds.withColumn("_t", top).withColumn("_c", F.last(F.when(F.col("kind_of").isNotNull() & (F.col("kind_of") != "Titolo"), F.struct("block", "name", "rubric")), ignorenulls=True).over(by))
    inside = F.coalesce(F.col("_c.block") > F.coalesce("_t.block", F.lit(0)), F.lit(False))
    found = kinds.filter("kind_of IS NULL").select(*_KEY, "block", F.col("_t.name").alias("part_title"), F.col("_t.rubric").alias("part_title_rubric"), F.when(inside, F.col("_c.name")).alias("chapter"), F.when(inside, F.col("_c.rubric")).alias("chapter_rubric"))
    return arts.join(found, [*_KEY, "block"])


def resolved_references(voices: DataFrame, changed: DataFrame) -> DataFrame:
    """voices(doc, seg, ord, is_title, note), changed(doc, note, k, act, article, paragraph, text) → (doc, seg, ord, is_title, note, k, act, article, text): each voice's changes, with the text that a note refers to in place of the reference.

    The note named, or the one before, if it changes by the same act and no other article; else the first voice whose note tells the same act and article in full;
    else the reference stays.
    """
    m = F.regexp_extract("text", REFERS, 1).try_cast("int")
    short = F.coalesce((F.length("text") < SHORT_NOTE) & F.col("text").rlike(REFERS), F.lit(False))
    rows = changed.withColumn("refers", short).withColumn("_to", F.coalesce(m, F.when(F.regexp_extract("text", REFERS, 2) != "", F.col("note") - 1)))
    own = F.regexp_extract("act", r"(\d+-\d+)$", 1)
    # read several times; of the voices' changes only those that refer to others are dealt again to meet them
    rows = graph.written(rows.withColumn("_act", own))
    full = rows.filter("NOT refers")
    asks = rows.filter("refers").alias("a")
    told = full.select("doc", F.col("note").alias("_to"), "_act", F.col("article").alias("_article"), F.col("k").alias("_k"), F.col("text").alias("_text"))
    direct = asks.join(told, ["doc", "_to", "_act"]).filter(F.col("_article").isNull() | F.col("article").isNull() | (F.col("_article") == F.col("article")))
    direct = direct.groupBy("doc", "note", "k").agg(F.min_by("_text", "_k").alias("_direct"))
    each = graph.written(voices.join(rows, ["doc", "note"]))
    order = F.struct("seg", "is_title", "ord", "note", "k")
    anywhere = each.filter("NOT refers").groupBy("doc", "_act", F.coalesce("article", F.lit("")).alias("_a")).agg(F.min_by("text", order).alias("_any"))
    plain = ["doc", "seg", "ord", "is_title", "note", "k", "act", "article", "text"]
    asked = each.filter("refers").withColumn("_a", F.coalesce("article", F.lit(""))).join(direct, ["doc", "note", "k"], "left").join(anywhere, ["doc", "_act", "_a"], "left")
    return each.filter("NOT refers").select(plain).unionByName(asked.withColumn("text", F.coalesce("_direct", "_any", "text")).select(plain))


def title_repealers(tits: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc, seg, block, act): of titles, the acts whose listed text names the title within NEAR characters of the word for repealed, with no part of an article between."""
    key = ["doc", "seg", "block", "note", "k"]
    rows = changed.join(tits.select(*_KEY, "block", F.regexp_extract("name", r"(\S+)$", 1).alias("_roman")), [*_KEY, "block"])
    said = rows.select(*key, "act", "text", "_roman", F.explode(tx.occurrences(F.col("text"), TITLE)).alias("m")).filter(F.regexp_extract("m.t", r"([IVXLC]+)$", 1) == F.col("_roman"))
    falls = rows.select(*key, F.explode(tx.occurrences(F.col("text"), cs.IS_REPEALED)).alias("x")).select(*key, "x.s", "x.e")
    pairs = cs.near(said.select(*key, "act", "text", "m.s", "m.e"), falls, key)
    between = F.substring(F.col("text"), F.col("gap_s") + 1, F.col("gap_e") - F.col("gap_s"))
    return pairs.filter(~between.rlike(cs.FRAGMENT)).select("doc", "seg", "block", "act").distinct()


def known_acts(named: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """named(act) → (act, id): the loaded act that a note's name means: the one of that very id, or the only one of its number and year whose type may stand for it."""
    full = t["acts"].filter(~F.contains("id", F.lit(ids.COLLISION))).join(t["articles"].select(F.col("act_id").alias("id")).distinct(), "id", "left_semi").select("id")
    numbered = full.select("id", F.regexp_extract("id", r"(\d+-\d+)$", 1).alias("_n"), F.split_part("id", F.lit("-"), F.lit(1)).alias("_p"))
    kin = F.create_map(*[x for k, v in KIN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    ask = named.select("act").distinct().withColumn("_n", F.regexp_extract("act", r"(\d+-\d+)$", 1)).withColumn("_own", F.split_part("act", F.lit("-"), F.lit(1)))
    fits = F.array_contains(F.coalesce(F.try_element_at(kin, F.col("_own")), F.array("_own")), F.col("_p"))
    found = ask.join(numbered, "_n").filter(fits).groupBy("act").agg(F.max(F.when(F.col("id") == F.col("act"), F.col("id"))).alias("_same"), F.count("*").alias("_many"), F.first("id").alias("_one"))
    return found.select("act", F.coalesce("_same", F.when(F.col("_many") == 1, F.col("_one"))).alias("id")).filter("id IS NOT NULL")


def read(body: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Tables `segments`, `titles`, `articles`, `notes`, `changes`, `origins`, `repealers` and `title_repealers` of collections. What several of them need is written once."""
    segs = graph.written(segments(body))
    rows = _classified(segs)
    tits = graph.written(titles(rows))
    arts = graph.written(placed(articles(rows), tits))
    voices = arts.select(*_KEY, "ord", "block", F.lit(False).alias("is_title"), F.explode("notes").alias("note")).unionByName(tits.select(*_KEY, F.col("block").alias("ord"), "block", F.lit(True).alias("is_title"), F.explode("notes").alias("note")))
    found = cs.notes(lines, voices.groupBy("doc").agg(F.max("note").alias("n")))
    found = graph.written(found.withColumn("text", F.regexp_replace("text", REPEALED_BY, "$1Modifiche legislative: ")))
    listed = cs.changes(found.withColumn("ord", F.lit(0))).drop("ord")
    changed = graph.written(resolved_references(voices.drop("block"), graph.written(listed)))
    clean = changed.filter("NOT is_title").withColumn("text", F.regexp_replace("text", TITLE_IN_LIST, "")).withColumn("doc", F.struct("doc", "seg"))
    by = cs.repealers(arts.withColumn("doc", F.struct("doc", "seg")), clean.select("doc", "ord", "note", "k", "act", "article", "text"))
    part = lambda k: F.regexp_extract("text", LONG_ORIGIN, k)
    noted = voices.filter("NOT is_title").join(found, ["doc", "note"])
    short = cs.origins(noted.withColumn("doc", F.struct("doc", "seg")))
    long_ = noted.filter(F.col("text").rlike(LONG_ORIGIN)).select(F.struct("doc", "seg").alias("doc"), "ord", F.struct("note", ids.act_id(F.regexp_replace(part(1), r"\s+", " "), part(3).cast("int"), part(2).cast("int")).alias("act"), part(4).alias("article")).alias("x"))
    long_ = long_.groupBy("doc", "ord").agg(F.min("x").alias("x")).select("doc", "ord", "x.act", "x.article")
    born = short.unionByName(long_.join(short.select("doc", "ord"), ["doc", "ord"], "left_anti"))
    heads = segs.select(*_KEY, "act", "appendix").distinct()
    substantial = noted.filter(F.col("text").rlike(SUBSTANTIAL)).select(*_KEY, "ord").distinct().withColumn("substantial", F.lit(True))
    arts = arts.join(substantial, [*_KEY, "ord"], "left").withColumn("substantial", F.coalesce("substantial", F.lit(False)))
    own = changed.filter("is_title").withColumnRenamed("ord", "block")
    return {"segments": heads, "titles": tits, "articles": arts, "notes": found, "changes": changed, "origins": born.select("doc.doc", "doc.seg", "ord", "act", "article"), "repealers": by.select("doc.doc", "doc.seg", "ord", "act"), "title_repealers": title_repealers(tits, own)}


def plan(read_: dict[str, DataFrame], t: dict[str, DataFrame]) -> DataFrame:
    """(doc, seg, act, ord, number, decision, new_ord, reorder): what is to be done with each article of a collection, against what the corpus has.

    decision: `doubled` (its number came before), `write`, `vehicle` (it brings an article into another act, whose later changes would be
    told as its own), `absorbed` (written because it holds the text of the new article behind it) or `keep`. An act whose stored articles are all
    one implicit paragraph each is written as a whole, if the collection has nearly all of it and is no extract. New articles stand behind the one before them.
    """
    key = lambda c: ids.article_key(F.col(c))
    pars = t["paragraphs"].groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("_old"), F.bool_and(F.coalesce("implicit", F.lit(False))).alias("_implicit"))
    have = t["articles"].select(F.col("id").alias("article_id"), F.col("act_id").alias("act"), key("number").alias("_k"), F.col("ord").alias("_ord")).join(pars, "article_id", "left")
    have = have.groupBy("act", "_k").agg(F.min("_ord").alias("_ord"), F.min_by("_old", "_ord").alias("_old"), F.bool_and(F.coalesce("_implicit", F.lit(True))).alias("_implicit"))
    rows = read_["articles"].join(read_["segments"], [*_KEY]).withColumn("_k", key("number"))
    rows = rows.join(have.withColumn("_has", F.lit(True)), ["act", "_k"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    whole = have.groupBy("act").agg(F.count("*").alias("_n"), F.bool_and("_implicit").alias("_all"), F.max(F.coalesce("_ord", F.lit(0.0))).alias("_most"))
    seg, order = Window.partitionBy(*_KEY), Window.partitionBy(*_KEY).orderBy("ord")
    rows = rows.join(whole, "act", "left").withColumn("_met", F.size(F.collect_set(F.when(F.col("_has"), F.col("_k"))).over(seg)))
    rows = rows.withColumn("_whole", F.coalesce(~F.col("appendix") & F.col("_all") & (F.col("_met") >= COVERED * F.col("_n")), F.lit(False)))
    rows = rows.withColumn("reorder", F.col("_whole") & (F.col("_met") == F.col("_n"))).withColumn("_nth", F.row_number().over(Window.partitionBy(*_KEY, "_k").orderBy("ord")))
    first = F.coalesce(F.get("paragraphs", F.lit(0)), F.lit(""))
    touched = F.col("_whole") | F.col("substantial") | F.col("repealed") | F.col("repealed_in_part")
    vehicle = ~F.col("_whole") & F.left(first, F.lit(300)).rlike(BRINGS_ARTICLE)
    decision = F.when(F.col("_nth") > 1, "doubled").when(~F.col("_has"), "write").when(touched & vehicle, "vehicle").when(touched, "write").otherwise("keep")
    rows = rows.withColumn("decision", decision)
    # the new article's first words within the text of the last stored one before it
    flat = lambda c: F.lower(cs._stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    single = F.when(F.col("_nth") == 1, F.when(F.col("_has"), F.struct("ord", "_old")))
    rows = rows.withColumn("_prev", F.last(single, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.left(flat(first), F.lit(60))
    holds = (F.col("_nth") == 1) & ~F.col("_has") & (begin != "") & F.contains(flat(F.col("_prev._old")), begin)
    held = rows.filter(holds).select(*_KEY, F.col("_prev.ord").alias("ord")).distinct().withColumn("_holds", F.lit(True))
    rows = rows.join(held, [*_KEY, "ord"], "left").withColumn("decision", F.when(F.col("_holds") & F.col("decision").isin("keep", "vehicle"), "absorbed").otherwise(F.col("decision")))
    known = F.last(F.when(F.col("_has"), F.col("_ord")), ignorenulls=True).over(order)
    run = F.sum((F.col("_has") & F.col("_ord").isNotNull()).cast("int")).over(order)
    rows = rows.withColumn("_base", known).withColumn("_run", run)
    since = F.sum((~F.col("_has")).cast("int")).over(Window.partitionBy(*_KEY, "_run").orderBy("ord"))
    place = F.when(F.col("reorder"), F.col("ord").cast("double")).when(F.col("_has"), F.col("_ord")).otherwise(F.round(F.coalesce("_base", "_most", F.lit(0.0)) + 0.01 * since, 6))
    return rows.select("doc", "seg", "act", "ord", "number", "decision", place.alias("new_ord"), "reorder")


def introducing(born: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """born(target_act, article, act) → (target_act, article, act, number): the article of `act` that brought `article` into the target act, where exactly one can be.

    Its rubric and first paragraph name the article, the act that receives it by number and year, and a verb of insertion.
    """
    first = t["paragraphs"].groupBy("article_id").agg(F.min_by("text", "ord").alias("_t"))
    arts = t["articles"].select(F.col("id").alias("article_id"), F.col("act_id").alias("act"), F.col("number").alias("_number"), "rubric").join(first, "article_id", "left")
    text = F.left(F.concat(F.coalesce("rubric", F.lit("")), F.lit(" "), F.coalesce("_t", F.lit(""))), F.lit(800))
    n, y = F.regexp_extract("target_act", r"-(\d+)-(\d+)", 1), F.regexp_extract("target_act", r"-(\d+)-(\d+)", 2)
    base, bis = F.split_part("article", F.lit("-"), F.lit(1)), F.split_part("article", F.lit("-"), F.lit(2))
    rows = born.select("target_act", "article", "act").distinct().join(arts.withColumn("_text", text), "act")
    rows = rows.withColumn("_a", F.concat(F.lit(r"(?i)articol[oi]\s+"), base, F.when(bis != "", F.concat(F.lit(r"\s*[-\s]?\s*"), bis)).otherwise(F.lit("")), F.lit(r"\b")))
    rows = rows.withColumn("_l", F.concat(F.lit(r"(?i)\b"), n, F.lit(r"\s*/\s*"), y, F.lit(r"\b|\b"), y, F.lit(r"\s*,?\s*n\.?\s*"), n, F.lit(r"\b")))
    rows = rows.filter(F.expr("_text rlike _a AND _text rlike _l") & F.col("_text").rlike("(?i)aggiunt|inserit|introdu"))
    return rows.groupBy("target_act", "article", "act").agg(F.count("*").alias("_many"), F.first("_number").alias("number")).filter("_many = 1").drop("_many")
