"""Articles of an act put in order after reading, so that each has an id of its own.

A heading glued to the end of a paragraph opens an article; what follows the promulgation, or a treaty that a ratification contains, is an annex with
numbers of its own; a number that the act itself has twice stays two articles. Paragraphs are read once by windows; what is left to
decide in order concerns the few glued headings of an act and the articles of its annexes, which fold over arrays without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave.operators import graph
from actweave.operators.renumber import SIGNED, depth, leading, marks, stripped

# The ordinals of inserted articles, the form of a glued heading, the whole promulgation, words of ratifications and treaties.
ORDINALS = "bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies|terdecies|quaterdecies"
GLUED = rf"(?isU)^(.*?)(?:^|([.;:])\s*)Art(?:icolo|\.)?\s*(\d{{1,3}})\s*(?:[-\s]?\s*({ORDINALS}))?\s*\.?\s*\(([^()]{{2,160}})\)\s*$"
PROMULGATED = r"(?isU)Dat[oa]\s+dalla\s+Nostra\s+Residenza.{0,250}?CAPITANI\s+REGGENTI"
RATIFIES = r"(?iU)ratific|piena\s+ed?\s+intera\s+esecuzione|recepit"
TREATY = r"(?U)\b(?:Convenzione|Trattato|Accordo|Protocollo|Parti\s+contraenti|Stati\s+membri)\b"
LEAST_TREATY_ARTICLES = 5

#: Columns of articles that a new article takes over from the one it was glued to.
PLACED = ("part_title", "part_title_rubric", "chapter", "chapter_rubric")


def key(number: Column) -> Column:
    """Numbers that are read alike: "19 bis", "19-bis" and "19bis"."""
    return F.lower(F.regexp_replace(F.coalesce(number, F.lit("")), r"(?U)[\s.\-–]+", ""))


def article_id(act: Column, number: Column) -> Column:
    return F.concat(act, F.lit("/art-"), F.replace(number, F.lit(" "), F.lit("-")))


def headings(paragraphs: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, number, rubric, rest, article_id, ord): paragraphs at whose end the heading of a further article stands, and what is left of them.

    The paragraph after it is numbered 1, no quotation is open where the heading begins, the act has no article of that number, and it is the
    number of the article at hand or the next one. Only these paragraphs of an act are looked at in their order.
    """
    order = Window.partitionBy("article_id").orderBy("ord", "id")
    said = F.coalesce("text", F.lit(""))
    # only texts that can hold a heading are dealt by article, of the others their quotation marks
    rows = paragraphs.select("id", "article_id", "act_id", "ord", "number", F.coalesce("implicit", F.lit(False)).alias("implicit"), F.when(said.rlike(r"(?U)\)\s*$"), F.when(said.rlike(GLUED), said)).alias("text"), marks(said).alias("_m"))
    rows = rows.withColumn("_n", F.lead(F.trim("number")).over(order)).withColumn("_i", F.lead("implicit").over(order))
    rows = rows.withColumn("_c", F.coalesce((F.col("_n") == "1") & ~F.col("_i") & F.col("text").isNotNull(), F.lit(False)))
    rows = rows.withColumn("_g", F.coalesce(F.sum(F.col("_c").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    since = F.array_join(F.collect_list("_m").over(Window.partitionBy("article_id", "_g").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, -1)), "")
    part = lambda k: F.regexp_extract("text", GLUED, k)
    number = F.concat(part(3), F.when(part(4) != "", F.concat(F.lit("-"), F.lower(part(4)))).otherwise(F.lit("")))
    found = rows.withColumn("_s", since).filter("_c").select("id", "article_id", "act_id", "ord", number.alias("number"), part(3).cast("long").alias("base"), F.trim(part(5)).alias("rubric"), stripped(F.concat(part(1), part(2))).alias("rest"), F.col("_s").alias("since"), marks(part(1)).alias("ahead"), F.col("_m").alias("own"))
    held = articles.select(F.col("id").alias("article_id"), F.col("ord").alias("at"), leading(F.col("number")).alias("mine"))
    one = F.struct("at", "article_id", "ord", "id", "mine", "number", "base", "rubric", "rest", "since", "ahead", "own")
    acts = found.join(held, "article_id").groupBy("act_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    taken = articles.join(acts.select("act_id"), "act_id", "left_semi").groupBy("act_id").agg(F.collect_set(key(F.col("number"))).alias("taken"))
    start = F.struct(F.col("taken").alias("taken"), F.lit("").alias("article"), F.lit(None).cast("long").alias("n"), F.lit(0).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        same = a["article"] == x["article_id"]
        before = depth(x["since"], F.when(same, a["open"]).otherwise(0))
        mine = F.when(same, a["n"]).otherwise(x["mine"])
        fits = mine.isNull() | x["base"].between(mine, mine + 1)
        yes = (depth(x["ahead"], before) == 0) & fits & ~F.array_contains(a["taken"], key(x["number"]))
        return F.struct(
            F.when(yes, F.array_append(a["taken"], key(x["number"]))).otherwise(a["taken"]).alias("taken"),
            x["article_id"].alias("article"),
            F.when(yes, x["base"]).otherwise(mine).alias("n"),
            F.when(yes, 0).otherwise(depth(x["own"], before)).alias("open"),
            F.when(yes, F.array_append(a["out"], x["id"])).otherwise(a["out"]).alias("out"),
        )

    accepted = acts.join(taken, "act_id").withColumn("yes", F.aggregate("x", start, step, lambda a: a["out"]))
    return accepted.select(F.explode(F.filter("x", lambda x: F.array_contains("yes", x["id"]))).alias("x")).select("x.id", "x.number", "x.rubric", "x.rest", "x.article_id", "x.ord")


def divided(articles: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, paragraphs) with an article of its own for each glued heading: articles have `origin` (null for new ones) and `_at`, their place; paragraphs `_at` of theirs."""
    paragraphs = graph.written(paragraphs)
    found = headings(paragraphs, articles).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "number", "rubric", "rest"))).alias("_found"))
    found = graph.written(found)
    # an article's few headings come to its paragraphs as one array, so these are dealt once, by article
    marked = paragraphs.join(found, "article_id", "left")
    own = F.get(F.filter("_found", lambda x: x["id"] == F.col("id")), 0)
    before = F.filter("_found", lambda x: F.struct(x["ord"], x["id"]) < F.struct(F.col("ord"), F.col("id")))
    marked = marked.withColumn("_own", own).withColumn("_k", F.when(F.col("_found").isNull(), 0).otherwise(F.size(before)).cast("long"))
    marked = marked.select(*paragraphs.columns, "_k", "_own.rest")
    new = found.select(F.col("article_id").alias("id"), F.posexplode("_found").alias("_at", "x")).select("id", (F.col("_at") + 1).cast("long").alias("_k"), F.col("x.number").alias("_number"), F.col("x.rubric").alias("_rubric"))
    base = articles.withColumn("_k", F.lit(0).cast("long")).withColumn("origin", F.col("id"))
    own = base.drop("_k").join(new, "id").withColumns({"number": F.col("_number"), "rubric": F.col("_rubric"), "origin": F.lit(None).cast("string")})
    keep = {"id", "act_id", "number", "rubric", "ord", "origin", "_k", *PLACED, *(c for c in ("inferred", "tabular") if c in articles.columns)}
    own = own.select(*[F.col(c) if c in keep else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    rows = marked.filter("rest IS NULL OR rest <> ''").withColumn("text", F.coalesce("rest", "text"))
    return base.unionByName(own), rows.select(*paragraphs.columns, "_k")


def _annexes(arts: DataFrame) -> DataFrame:
    """`arts` with `_s`: which annex of its act an article stands in; null outside of annexes.

    An annex begins behind the article with the promulgation, or at the treaty within the first articles of a ratification. A further one begins
    where numbers start again. Without a whole promulgation or a treaty, numbers must really collide.
    """
    act, order = Window.partitionBy("act_id"), Window.partitionBy("act_id").orderBy("ord", "id", "_k")
    arts = arts.withColumn("_i", F.row_number().over(order)).withColumn("_all", F.count("*").over(act)).withColumn("_key", key(F.col("number"))).withColumn("_n", leading(F.col("number")))
    sign = F.min(F.when(F.col("_signed") & (F.col("_i") < F.col("_all")), F.struct("_i", "_promulgated"))).over(act)
    arts = arts.withColumn("_f", sign)
    first = F.coalesce("_f._i", "_all")
    again = F.min(F.when((F.col("_n") == 1) & (F.col("_i") > 1) & (F.col("_i") <= first) & (first >= LEAST_TREATY_ARTICLES), F.col("_i"))).over(act)
    arts = arts.withColumn("_again", again)
    said = lambda c: F.coalesce(F.bool_or(F.col(c) & (F.col("_i") < F.col("_again"))).over(act), F.lit(False))
    inferred = F.coalesce(F.bool_or("inferred").over(act), F.lit(False)) if "inferred" in arts.columns else F.lit(False)
    sure = F.when(~inferred, F.when(said("_ratifies") & said("_treaty"), F.col("_again")).when(F.col("_f._promulgated"), F.col("_f._i") + 1))
    arts = arts.withColumn("_sure", sure).withColumn("_from", F.coalesce("_sure", F.col("_f._i") + 1))
    tabular = F.coalesce("tabular", F.lit(False)) if "tabular" in arts.columns else F.lit(False)
    arts = arts.withColumn("_in", F.coalesce((F.col("_i") >= F.col("_from")) & ~tabular, F.lit(False)))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("long").alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["s"] == 0) | F.array_contains(a["seen"], x["_key"]) | F.coalesce(x["_n"] <= a["n"], F.lit(False))
        s = a["s"] + new.cast("int")
        return F.struct(s.alias("s"), F.when(new, F.array(x["_key"])).otherwise(F.array_append(a["seen"], x["_key"])).alias("seen"), F.coalesce(x["_n"], a["n"]).alias("n"), F.array_append(a["out"], s).alias("out"))

    inside = arts.filter("_in").groupBy("act_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_key", "_n"))).alias("x"))
    inside = inside.withColumn("s", F.aggregate("x", start, step, lambda a: a["out"]))
    inside = inside.select("act_id", F.explode(F.arrays_zip(F.transform("x", lambda x: x["_i"]).alias("_i"), F.col("s").alias("_sec"))).alias("x")).select("act_id", "x._i", "x._sec")
    arts = arts.join(inside, ["act_id", "_i"], "left")
    kinds = arts.groupBy("act_id").agg(
        F.size(F.array_intersect(F.collect_set(F.when(F.col("_i") < F.col("_from"), F.col("_key"))), F.collect_set(F.when(F.col("_in"), F.col("_key"))))).alias("_both"),
        F.count_distinct(F.when(F.col("_in"), F.struct("_sec", "_key"))).alias("_a"),
        F.count_distinct(F.when(F.col("_in"), F.col("_key"))).alias("_b"),
    )
    arts = arts.join(kinds, "act_id")
    meant = (F.col("_both") > 0) | (F.col("_a") != F.col("_b")) | F.col("_sure").isNotNull()
    return arts.withColumn("_s", F.when(meant, F.col("_sec")))


def restructured(articles: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, paragraphs): articles with ids that no other has, and `origin`, the id they had (null for one that a glued heading opened).

    Numbers are those of the text first (`number_original`, where one is known). Articles of annexes are called "all-3", "all2-3" and so on, with
    `annex` set and no title or chapter; a number that an act has twice becomes "9-rip2"; both keep number_original. Paragraphs get the
    ids of their articles, their own ids stay as they are. ord counts an act's articles from 0. Optional columns: `inferred` (the
    act's structure was guessed: no annex is told by its promulgation alone) and `tabular` (read from a table: it has its annex number
    already). Applied to its own outcome it changes nothing. Articles without paragraphs are kept.
    """
    first = articles.withColumn("number", F.coalesce("number_original", "number")).withColumn("number_original", F.lit(None).cast("string"))
    arts, pars = divided(first, paragraphs)
    pars = graph.written(pars)
    text = F.coalesce("text", F.lit(""))
    said = pars.groupBy(F.col("article_id").alias("id"), "_k").agg(*[F.bool_or(text.rlike(p)).alias(c) for c, p in (("_signed", SIGNED), ("_promulgated", PROMULGATED), ("_ratifies", RATIFIES), ("_treaty", TREATY))])
    arts = arts.join(said, ["id", "_k"], "left").fillna(False, ["_signed", "_promulgated", "_ratifies", "_treaty"])
    arts = _annexes(arts)
    inside = F.col("_s").isNotNull()
    name = lambda word, gap: F.when(F.col("_s") == 1, F.lit(word)).otherwise(F.concat(F.lit(word + gap), F.col("_s").cast("string")))
    arts = arts.withColumn("_given", F.col("number")).withColumn("number", F.when(inside, F.concat(name("all", ""), F.lit("-"), "number")).otherwise(F.col("number")))
    nth = F.row_number().over(Window.partitionBy("act_id", key(F.col("number"))).orderBy("_i"))
    arts = arts.withColumn("_nth", nth).withColumn("number", F.when(F.col("_nth") > 1, F.concat("number", F.lit("-rip"), F.col("_nth").cast("string"))).otherwise(F.col("number")))
    was_annex = F.col("annex").isNotNull() & F.col("annex").rlike("^Allegato( [0-9]+)?$")
    arts = arts.withColumns(
        {
            "number_original": F.when(inside | (F.col("_nth") > 1), F.col("_given")),
            "annex": F.when(inside, name("Allegato", " ")).when(~was_annex | F.coalesce("tabular", F.lit(False)) if "tabular" in arts.columns else ~was_annex, F.col("annex")),
            **{c: F.when(~inside, F.col(c)) for c in PLACED},
            "ord": (F.col("_i") - 1).cast("double"),
            "_old": F.col("id"),
        }
    ).withColumn("id", article_id(F.col("act_id"), F.col("number")))
    arts = graph.written(arts.select(*articles.columns, "origin", "_old", "_k"))
    moved = pars.join(arts.select(F.col("_old").alias("article_id"), "_k", F.col("id").alias("_new")), ["article_id", "_k"])
    return arts.drop("_old", "_k"), moved.withColumn("article_id", F.col("_new")).select(paragraphs.columns)
