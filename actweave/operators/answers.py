"""Checking answers against their sources: which acts and articles a text names, and whether the sources hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave.functions import citations, ids
from actweave.functions import text as tx

# A marker names an act, its article and paragraph: [L-44-2015 art.3 c.1].
MARKER = r"\[([A-Z]{1,3}-[0-9A-Z]+-[0-9]{4}(?:~[0-9]+)?)(?:\s+art\.\s*([0-9]+(?:[ -][a-z]+)?))?(?:\s+c\.\s*([0-9A-Za-z.-]+))?\]"


def markers(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, ord, act_id, article, par): the source markers of each answer, in order."""
    groups = [F.regexp_extract_all(text, F.lit(MARKER), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("a", "b", "c"), strict=True)])
    rows = answers.select(key, F.posexplode(zipped).alias("ord", "m"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(key, "ord", F.col("m.a").alias("act_id"), empty("m.b").alias("article"), empty("m.c").alias("par"))


def named(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, act_id, article): what an answer names, by markers and in words."""
    words = citations.extracted(answers, text, key).filter("target IS NOT NULL").select(key, F.col("target").alias("act_id"), F.col("cited_article").alias("article"))
    return markers(answers, key, text).select(key, "act_id", "article").unionByName(words).distinct()


def unverified(answers: DataFrame, sources: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, act_id, article): what an answer names and sources(key, act_id, article) do not hold; without an article the act is enough."""
    said = named(answers, key, text).withColumns({"_b": ids.canonical(F.col("act_id")), "_k": ids.article_key(F.col("article"))})
    have = sources.select(key, ids.canonical(F.col("act_id")).alias("_b"), ids.article_key(F.col("article")).alias("_k"))
    whole = said.filter("_k IS NULL").join(have.select(key, "_b"), [key, "_b"], "left_anti")
    exact = said.filter("_k IS NOT NULL").join(have, [key, "_b", "_k"], "left_anti")
    return whole.select(key, "act_id", "article").unionByName(exact.select(key, "act_id", "article"))


def anchored(marks: DataFrame, paragraphs: DataFrame, articles: DataFrame, acts: DataFrame, key: str = "answer_id") -> DataFrame:
    """markers with `anchor` and `level`: the paragraph that one names, else its article, else its act; those that name nothing are dropped."""
    art = articles.select(F.col("id").alias("_art"), "act_id", ids.article_key(F.col("number")).alias("_k"))
    rows = marks.withColumn("_k", ids.article_key(F.col("article"))).join(art, ["act_id", "_k"], "left")
    par = paragraphs.select(F.col("id").alias("_par"), F.col("article_id").alias("_art"), F.col("number").alias("par"))
    rows = rows.join(par, ["_art", "par"], "left").join(acts.select(F.col("id").alias("act_id"), F.lit(True).alias("_act")), "act_id", "left")
    level = F.when(F.col("_par").isNotNull(), "paragraph").when(F.col("_art").isNotNull(), "article").when(F.col("_act"), "act")
    return rows.withColumns({"anchor": F.coalesce("_par", "_art", F.when(F.col("_act"), F.col("act_id"))), "level": level}).filter("anchor IS NOT NULL").select(key, "ord", "act_id", "article", "par", "anchor", "level")


def cites_expected(text: Column, act: Column) -> Column:
    """Whether a text names an act in any of its surface forms: its id, "n.44/2015", "44/2015", or "2015 n.44"."""
    n, y = F.regexp_extract(act, "^[A-Z]+-([0-9]+)-", 1), F.regexp_extract(act, "-([0-9]{4})(?:~|$)", 1)
    pattern = F.concat(F.lit(r"(?i)(?<![0-9])(?:n\.?\s*)?0*"), n, F.lit(r"\s*/\s*"), y, F.lit(r"(?![0-9])|(?<![0-9])"), y, F.lit(r"\s*,?\s*n\.?\s*0*"), n, F.lit(r"(?![0-9])"))
    return F.contains(text, act) | ((n != "") & F.regexp_like(text, pattern))


def sources_of(results: DataFrame, key: str = "answer_id") -> DataFrame:
    """Results of any tool flattened to (key, n, act_id, article, par): each source once, numbered by first sight (`seen`)."""
    first = results.groupBy(key, "act_id", "article", "par").agg(F.min("seen").alias("seen"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("seen", "act_id", F.asc_nulls_first("article"), F.asc_nulls_first("par")))).select(key, "n", "act_id", "article", "par")


def accuracy(outcomes: DataFrame) -> DataFrame:
    """outcomes(category, correct, source_ok, seconds, cost) → by category: counts, the upper median and maximum of seconds, mean cost."""
    turn = F.row_number().over(Window.partitionBy("category").orderBy("seconds"))
    counted = outcomes.withColumn("_at", turn).withColumn("_of", F.count("seconds").over(Window.partitionBy("category")))
    middle = F.col("_at") == F.count_if(F.col("seconds").isNull()).over(Window.partitionBy("category")) + F.floor(F.col("_of") / 2) + 1
    return counted.withColumn("_middle", F.when(middle, F.col("seconds"))).groupBy("category").agg(
        F.count("*").alias("n"),
        F.sum(F.col("correct").cast("int")).alias("correct"),
        F.sum(F.col("source_ok").cast("int")).alias("source_ok"),
        F.max("_middle").alias("median_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.round(F.avg("cost"), 6).alias("mean_cost"),
    )


# The marker of a stored answer.
STORED = r"\{\{cita:([^:{}]+):([^:{}]*):([^:{}]*)\}\}"


def repaired(answers: DataFrame, sources: DataFrame, acts: DataFrame, key: str = "answer_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(answers, added): texts whose markers `{{cita:act:article:paragraph}}` name what the answer's sources(key, act_id, article, par) hold.

    A marker that is no source becomes its article's, if that is one, else its act's, which is added(key, act_id) to the sources if the act is loaded; a marker of an act that
    is neither is taken out. Pieces of text meet their sources by joins and are put together again in their order.
    """
    found = answers.select(key, tx.occurrences(F.col(text), STORED).alias("x"), F.col(text).alias("_t"))
    marks = found.select(key, F.posexplode("x").alias("k", "x")).select(key, "k", *[F.regexp_extract("x.t", STORED, g).alias(n) for g, n in ((1, "act_id"), (2, "article"), (3, "par"))], "x.s", "x.e")
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    rank = lambda c: F.when(c == "-", "-").otherwise(ids.article_key(c))
    have = sources.select(key, "act_id", rank(none(F.col("article"))).alias("_a"), none(F.col("par")).alias("_p")).distinct()
    rows = marks.withColumns({"_a": F.when(none(F.col("article")) == "-", F.col("article")).otherwise(ids.article_key(F.col("article"))), "_p": none(F.col("par"))}).withColumn("_a", none(F.col("_a")))
    rows = rows.join(have.withColumn("_own", F.lit(True)), [key, "act_id", "_a", "_p"], "left")
    rows = rows.join(have.filter("_p = '-'").select(key, "act_id", "_a", F.lit(True).alias("_art")), [key, "act_id", "_a"], "left")
    rows = rows.join(have.filter("_a = '-' AND _p = '-'").select(key, "act_id", F.lit(True).alias("_act")), [key, "act_id"], "left")
    rows = rows.join(acts.filter("loaded").select(F.col("id").alias("act_id"), F.lit(True).alias("_known")), "act_id", "left")
    as_act = F.concat(F.lit("{{cita:"), "act_id", F.lit(":-:-}}"))
    new = F.when(F.col("_own"), F.concat(F.lit("{{cita:"), "act_id", F.lit(":"), "article", F.lit(":"), "par", F.lit("}}"))).when(F.col("_art") & (F.col("_a") != "-"), F.concat(F.lit("{{cita:"), "act_id", F.lit(":"), "article", F.lit(":-}}"))).when(F.col("_act") | F.col("_known"), as_act).otherwise("")
    rows = rows.withColumn("_new", new)
    added = rows.filter("_own IS NULL AND (_art IS NULL OR _a = '-') AND _act IS NULL AND _known").select(key, "act_id").distinct()
    put = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "_new"))).alias("_m"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, m: F.struct(m["e"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, m["s"] - a["at"]), m["_new"]).alias("out"))
    whole = F.aggregate("_m", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return answers.join(put, key, "left").withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(whole)).select(answers.columns), added
