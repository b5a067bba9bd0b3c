"""What later acts did to a result: currency annotations as joins on the final rows, never on candidates.

Every function takes `keys`(act_id, article) — the articles of the results — and the corpus tables, and returns rows to be joined on these two columns.
Absence of a row promises nothing: marks are positive evidence only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave.functions import text as tx
from actweave.functions.rewrites import rewriting
from actweave.operators import graph, ranking

# Origins of edges that were copied between twin acts.
COPIED = ("coordinato", "ratifica")
# Similarity from which a later provision counts, of the family and else; how many are shown.
RELATED, ALIKE, PER_ROW, IN_ALL = 0.86, 0.91, 2, 4
SHOWN, TITLE = 400, 160
MIN_RUBRIC = 12
CONSOLIDATED = r"(?i)testo\s+coordinato\s+(?:della|del|dei|delle)\s+(legge(?:\s+qualificata|\s+costituzionale)?|decreto(?:\s+delegato|\s+reggenziale|\s+consiliare)?)\b.{0,40}?\b([0-9]{4})\s*,?\s*n\.?\s*([0-9]+)"


def bases(acts: DataFrame, twins: DataFrame) -> DataFrame:
    """(act_id, base): the act that a consolidated text consolidates, by its edge or else by its title; of several the one with the shortest id."""
    edges = twins.filter("kind = 'coordina'").select(F.col("a").alias("act_id"), F.col("b").alias("base"))
    kind = F.lower(F.regexp_replace(F.regexp_extract("title", CONSOLIDATED, 1), r"\s+", " "))
    named = acts.filter(F.lower("title").contains("testo coordinato")).join(edges.select(F.col("act_id").alias("id")), "id", "left_anti")
    named = named.select(F.col("id").alias("act_id"), kind.alias("k"), F.regexp_extract("title", CONSOLIDATED, 2).try_cast("int").alias("y"), F.regexp_extract("title", CONSOLIDATED, 3).alias("n")).filter("k <> ''")
    candidates = acts.select(F.col("id").alias("base"), F.lower(F.trim("type")).alias("k"), F.col("year").alias("y"), F.col("number").alias("n"))
    found = named.join(candidates, ["k", "y", "n"]).filter("base <> act_id")
    best = found.groupBy("act_id").agg(F.min_by("base", F.struct(F.length("base"), "base")).alias("base"))
    return edges.groupBy("act_id").agg(F.min("base").alias("base")).unionByName(best)


def twin_acts(acts: DataFrame, twins: DataFrame) -> DataFrame:
    """(act_id, twin): consolidated text and base, decree and ratification, in both directions."""
    pairs = twins.select("a", "b").unionByName(bases(acts, twins).select(F.col("act_id").alias("a"), F.col("base").alias("b")))
    return graph.both_ways(pairs).distinct().select(F.col("a").alias("act_id"), F.col("b").alias("twin"))


def _targets(keys: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(act_id, article, year, base): each key with its own act and, of a consolidated text, the act below it."""
    years = t["acts"].select(F.col("id").alias("act_id"), "year")
    own = keys.select("act_id", "article").distinct().join(years, "act_id")
    return own.withColumn("base", F.col("act_id")).unionByName(own.join(bases(t["acts"], t["twins"]), "act_id").select("act_id", "article", "year", "base"))


def _later_citing(targets: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The paragraphs of later acts that cite the targets(act_id, article?, year, base): one row for each edge, with what the paragraph names."""
    acts = t["acts"].select(F.col("id").alias("_a"), F.col("number_int").alias("_n"), F.col("title").alias("_t"))
    cited = t["articles"].select(F.col("act_id").alias("base"), F.col("number").alias("target"), F.col("id").alias("dst_article_id"))
    rows = targets.join(cited, "base")
    if "article" in targets.columns:
        rows = rows.filter("article = target")
    par = t["paragraphs"].select(F.col("id").alias("par_id"), "article_id", F.col("act_id").alias("later"), F.col("number").alias("later_par"), "text", F.col("ord").alias("par_ord"))
    art = t["articles"].select(F.col("id").alias("article_id"), F.col("number").alias("later_article"), F.col("ord").alias("art_ord"))
    later = t["acts"].select(F.col("id").alias("later"), F.col("year").alias("later_year"), F.col("act_date").alias("later_date"), F.col("title").alias("later_title"))
    rows = rows.join(t["cites_article"], "dst_article_id").join(par, "par_id").join(art, "article_id").join(later, "later").filter("later_year > year AND later <> base")
    rows = rows.join(acts, rows["base"] == acts["_a"]).drop("_a").join(acts.select(F.col("_a").alias("named_act"), F.col("_n").alias("_nn"), F.col("_t").alias("_nt")), "named_act", "left")
    return rows.withColumns({"act_number": F.coalesce("_nn", "_n"), "act_title": F.coalesce("_nt", "_t"), "article_number": F.coalesce("named_article", "target")})


def cited_later(keys: DataFrame, t: dict[str, DataFrame], kept: int = 3, others: int = 2) -> DataFrame:
    """(act_id, article, cited_later): later acts that cite an article, those that rewrite it first; one entry for each act, at most `kept`."""
    rows = rewriting(_later_citing(_targets(keys, t), t))
    order = Window.partitionBy("act_id", "article", "later").orderBy(F.desc("rewrites"), F.coalesce("art_ord", F.lit(0.0)), F.coalesce("par_ord", F.lit(0)), "par_id")
    ranked = rows.withColumn("r", F.row_number().over(order)).filter((F.col("r") == 1) | (F.col("rewrites") & (F.col("r") <= 1 + others)))
    entry = F.struct(F.col("later").alias("act"), F.col("later_year").alias("year"), F.col("later_article").alias("article"), F.col("later_par").alias("par"), F.col("text"), "rewrites")
    per = ranked.groupBy("act_id", "article", "later").agg(F.min_by(entry, "r").alias("e"), F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", F.col("later_article").alias("article"), F.col("later_par").alias("par"))))).alias("others"), F.max("later_year").alias("y"), F.max("later_date").alias("d"))
    best = ranking.top(per, kept, ["act_id", "article"], [F.desc(F.col("e.rewrites")), F.coalesce("y", F.lit(0)).desc(), F.desc_nulls_last("d"), F.desc("later")])
    out = F.struct("rank", "e.act", "e.year", "e.article", "e.par", F.left("e.text", F.lit(600)).alias("text"), "e.rewrites", F.transform("others", lambda o: F.struct(o["article"].alias("article"), o["par"].alias("par"))).alias("others"))
    return best.groupBy("act_id", "article").agg(F.array_sort(F.collect_list(out)).alias("cited_later"))


def updated_in(keys: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(act_id, article, updated_in): where the text that an article wrote into another act stands today, at most five places."""
    rows = _written_into(keys, t).filter(F.col("origin").isNotNull() & ~F.col("origin").isin(*COPIED) & F.col("text_source").isNotNull() & (F.col("to_act") != F.col("act_id")))
    return rows.groupBy("act_id", "article").agg(tx.capped(F.collect_set(F.struct(F.col("to_act").alias("act"), F.col("to_article").alias("article"), "text_as_of")), 5).alias("updated_in"))


def fallen(keys: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(act_id, article, fallen): articles that an article introduced or cites and that are repealed, at most three."""
    rows = _written_into(keys, t).filter("to_repealed")
    return rows.groupBy("act_id", "article").agg(tx.capped(F.collect_set(F.struct(F.col("to_act").alias("act"), F.col("to_article").alias("article"), F.array_sort("to_repealed_by").alias("repealed_by"))), 3).alias("fallen"))


def _written_into(keys: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    own = keys.select("act_id", "article").distinct().join(t["articles"].select("act_id", F.col("number").alias("article"), F.col("id").alias("article_id")), ["act_id", "article"])
    own = own.join(t["paragraphs"].select(F.col("id").alias("par_id"), "article_id"), "article_id").join(t["cites_article"].select("par_id", "dst_article_id", "origin"), "par_id")
    to = t["articles"].select(F.col("id").alias("dst_article_id"), F.col("act_id").alias("to_act"), F.col("number").alias("to_article"), "text_source", "text_as_of", F.coalesce("repealed", F.lit(False)).alias("to_repealed"), F.col("repealed_by").alias("to_repealed_by"))
    return own.join(to, "dst_article_id")


def act_rewritten_by(keys: DataFrame, t: dict[str, DataFrame], kept: int = 3) -> DataFrame:
    """(act_id, article, act_rewritten_by): later acts that rewrite any article of the result's act, whether this one, and at most six of them."""
    acts = keys.select("act_id").distinct()
    years = t["acts"].select(F.col("id").alias("act_id"), "year")
    own = acts.join(years, "act_id")
    both = own.withColumn("base", F.col("act_id")).unionByName(own.join(bases(t["acts"], t["twins"]), "act_id").select("act_id", "year", "base"))
    rows = rewriting(_later_citing(both, t).filter("later <> act_id")).filter("rewrites")
    per = rows.groupBy("act_id", "later").agg(F.max("later_year").alias("y"), F.max("later_date").alias("d"), F.max("later_title").alias("title"), F.array_sort(F.collect_set("target")).alias("articles"))
    best = ranking.top(per, kept, ["act_id"], [F.coalesce("y", F.lit(0)).desc(), F.desc_nulls_last("d"), F.desc("later")])
    found = best.join(keys.select("act_id", "article").distinct(), "act_id")
    out = F.struct("rank", F.col("later").alias("act"), F.col("y").alias("year"), tx.truncated(F.col("title"), TITLE).alias("title"), F.slice("articles", 1, 6).alias("articles"), F.coalesce(F.array_contains("articles", F.col("article")), F.lit(False)).alias("touches_this"))
    return found.groupBy("act_id", "article").agg(F.array_sort(F.collect_list(out)).alias("act_rewritten_by"))


def later_provisions(keys: DataFrame, t: dict[str, DataFrame], related: float = RELATED, alike: float = ALIKE, per_row: int = PER_ROW) -> DataFrame:
    """(act_id, article, later_provisions): provisions of later acts close in meaning that do not cite the article.

    The family is the act, its twins and what cites the article later. A candidate outside it counts if it cites the family and is `related`, or is
    `alike`; not if it cites an article of the act itself. One for each act, the most similar; texts that are the same count once, as the latest.
    """
    tw = twin_acts(t["acts"], t["twins"]).select("act_id", F.col("twin").alias("member"))
    own = keys.select("act_id", "article").distinct()
    citing = _later_citing(_targets(keys, t), t).select("act_id", "article", F.col("later").alias("member"))
    self_ = own.select("act_id", "article", F.col("act_id").alias("member")).unionByName(own.join(tw, "act_id").select("act_id", "article", "member"))
    family = self_.unionByName(citing).distinct()
    years = t["acts"].select(F.col("id").alias("act_id"), "year")
    anchors = own.join(t["articles"].select("act_id", F.col("number").alias("article"), F.col("id").alias("article_id")), ["act_id", "article"]).join(t["paragraphs"].select("article_id", F.col("id").alias("x"), "embedding"), "article_id").filter("embedding IS NOT NULL").join(years, "act_id")
    later = t["acts"].select(F.col("id").alias("later"), F.col("year").alias("later_year"), F.col("act_date").alias("later_date"), F.col("title").alias("later_title"))
    near = ranking.cosine(t["paragraphs"].filter("embedding IS NOT NULL").select(F.col("id").alias("par"), "embedding"), anchors.select(F.col("x").alias("par"), "embedding").distinct(), k=100, key="par").filter(F.col("score") >= related)
    rows = near.join(anchors.select(F.col("x").alias("query_id"), "act_id", "article", "year"), "query_id").join(t["paragraphs"].select(F.col("id").alias("par"), F.col("act_id").alias("later"), "article_id", "number", "text"), "par").join(later, "later").filter("later_year > year")
    rows = rows.join(family.withColumnRenamed("member", "later"), ["act_id", "article", "later"], "left_anti")
    rows = rows.groupBy("act_id", "article", "later", "later_year", "later_date", "later_title", "article_id", "par", "number", "text").agg(F.max("score").alias("score"))
    to_self = t["cites_article"].select(F.col("par_id").alias("par"), "dst_article_id").join(t["articles"].select(F.col("id").alias("dst_article_id"), F.col("act_id").alias("member")), "dst_article_id").join(self_, "member").select("par", "act_id", "article").distinct()
    rows = rows.join(to_self, ["par", "act_id", "article"], "left_anti")
    calls = t["cites"].select(F.col("src_id").alias("par"), F.col("dst_act_id").alias("member")).join(family, "member").select("par", "act_id", "article").distinct().withColumn("calls", F.lit(True))
    rows = rows.join(calls, ["par", "act_id", "article"], "left").withColumn("calls", F.coalesce("calls", F.lit(False))).filter((F.col("calls")) | (F.col("score") >= alike))
    one = graph.latest(rows, ["act_id", "article", "later"], [F.desc("calls"), F.desc("score"), F.asc("par")])
    one = graph.latest(one.withColumn("fp", tx.fingerprint(F.col("text"))), ["act_id", "article", "fp"], [F.desc_nulls_last("later_year"), F.desc_nulls_last("later_date"), F.desc("later")])
    recent = [F.desc_nulls_last("later_year"), F.desc_nulls_last("later_date"), F.desc("later")]
    turn = Window.partitionBy("act_id", "article", "calls").orderBy(F.when(F.col("calls"), 0.0).otherwise(-F.col("score")), *recent)
    # related ones fill the places but for one that the most similar other takes
    one = one.withColumn("i", F.row_number().over(turn)).withColumn("place", F.when(F.col("calls"), F.when(F.col("i") < max(per_row, 2), F.col("i")).otherwise(F.col("i") + 1)).when(F.col("i") == 1, F.lit(max(per_row - 1, 1) + 0.5)))
    best = ranking.top(one.filter("place IS NOT NULL"), per_row, ["act_id", "article"], [F.asc("place")])
    best = best.withColumn("shown", F.row_number().over(Window.partitionBy("act_id", "article").orderBy(*recent)))
    numbers = t["articles"].select(F.col("id").alias("article_id"), F.col("number").alias("later_article"))
    out = F.struct("shown", F.col("later").alias("act"), F.col("later_year").alias("year"), tx.truncated(F.col("later_title"), TITLE).alias("title"), "later_article", F.col("number").alias("par"), tx.truncated(F.col("text"), SHOWN).alias("text"), "calls")
    return best.join(numbers, "article_id").groupBy("act_id", "article").agg(F.array_sort(F.collect_list(out)).alias("later_provisions"))


def newer_in_list(rows: DataFrame, group: Column) -> DataFrame:
    """`rows` with `newer`: of results with the same long rubric, the latest, on those of earlier years."""
    key = tx.collapsed(F.lower("rubric"))
    same = Window.partitionBy("_g", "_k")
    rows = rows.withColumns({"_g": group, "_k": F.when(F.length(key) > MIN_RUBRIC, key)})
    latest = F.max(F.struct(F.coalesce("year", F.lit(0)).alias("year"), (-F.col("rank")).alias("o"), F.col("act_id").alias("act"), F.col("article").alias("article"), F.col("par_number").alias("par"), tx.truncated(F.col("text"), SHOWN).alias("text"))).over(same)
    rows = rows.withColumn("_l", latest)
    return rows.withColumn("newer", F.when(F.col("_k").isNotNull() & (F.coalesce("year", F.lit(0)) < F.col("_l.year")), F.struct("_l.act", "_l.year", "_l.article", "_l.par", "_l.text"))).drop("_g", "_k", "_l")


def newer_versions(keys: DataFrame, t: dict[str, DataFrame], n: int = 2) -> DataFrame:
    """(act_id, article, newer_versions): articles of later acts with the same long rubric, the latest first."""
    rubric = F.lower(F.trim("rubric"))
    arts = t["articles"].filter(F.length(F.trim("rubric")) > MIN_RUBRIC).select("id", "act_id", "number", rubric.alias("k")).join(t["acts"].select(F.col("id").alias("act_id"), "year"), "act_id")
    mine = keys.select("act_id", "article").distinct().join(arts.select("act_id", F.col("number").alias("article"), "k", "year"), ["act_id", "article"])
    rows = mine.join(arts.select(F.col("act_id").alias("later"), F.col("number").alias("later_article"), F.col("id").alias("article_id"), "k", F.col("year").alias("later_year")), "k").filter("later_year > year")
    best = ranking.top(rows, n, ["act_id", "article"], [F.desc("later_year"), F.desc("later"), F.asc("later_article")])
    first = ranking.top(t["paragraphs"].join(best.select("article_id").distinct(), "article_id", "left_semi"), 3, ["article_id"], [F.asc("ord")])
    texts = first.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"))
    out = F.struct("rank", F.col("later").alias("act"), F.col("later_year").alias("year"), "later_article", tx.truncated(F.col("text"), 1200).alias("text"))
    return best.join(texts, "article_id", "left").groupBy("act_id", "article").agg(F.array_sort(F.collect_list(out)).alias("newer_versions"))
