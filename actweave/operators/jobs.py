"""Maintenance of a corpus: every job maps tables to tables, changes nothing when run again, and is planned before it is applied."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actweave import schema
from actweave.functions import citations, ids
from actweave.functions import text as tx
from actweave.operators import graph

# The least text that tells a duplicate, words that mark another act in a title, what a rebuilt act may lose.
LEAST_TEXT = 400
USEFUL_TITLE = 12
KEPT_SHARE, LOST_WORDS, LOST_SHARE = 0.9, 3, 0.01
FORCE_DAYS = 366
FORCE = r"(?i)\b(?:il|la)\s+presente\b[^.;]{0,80}?\bentra\s+in\s+vigore\s+(?:il|dal|a\s+(?:datare|decorrere)\s+dal)\s*(?:giorno\s+)?"
SAME_ARTICLE, SAME_TEXT = 0.8, 0.9


def act_fingerprints(t: dict[str, DataFrame]) -> DataFrame:
    """(act_id, fp, n_articles, n_chars): md5 of an act's sorted paragraphs, letters and digits only.

    The sorted list of one act's paragraph hashes is gathered, not their texts.
    """
    own = t["paragraphs"].select("act_id", F.md5(tx.letters(F.col("text"))).alias("h"), F.length(tx.letters(F.col("text"))).alias("n"))
    per = own.groupBy("act_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("fp"), F.sum("n").alias("n_chars"))
    return per.join(t["articles"].groupBy("act_id").agg(F.count("*").alias("n_articles")), "act_id")


def _compatible(a: Column, b: Column) -> Column:
    """Whether two titles can be the same act's: one is missing, says nothing, or contains the other."""
    x, y = tx.title_words(F.coalesce(a, F.lit(""))), tx.title_words(F.coalesce(b, F.lit("")))
    return (F.length(x) < USEFUL_TITLE) | (F.length(y) < USEFUL_TITLE) | F.contains(x, y) | F.contains(y, x)


def _families(t: dict[str, DataFrame]) -> DataFrame:
    """Acts that share their canonical id with others: (id, base, canonical title, title, fp, ...); each is held against the canonical one only."""
    base = t["acts"].select("id", ids.canonical(F.col("id")).alias("base"), "title", "preamble").join(act_fingerprints(t).withColumnRenamed("act_id", "id"), "id").filter(F.col("n_chars") >= LEAST_TEXT)
    first = graph.latest(base, ["base", "fp", "n_articles"], [F.length("id").asc(), F.asc("id")]).select("base", "fp", "n_articles", F.col("id").alias("kept"), F.col("title").alias("kept_title"), F.col("preamble").alias("kept_preamble"))
    return base.join(first, ["base", "fp", "n_articles"]).filter("id <> kept")


def duplicates(t: dict[str, DataFrame]) -> DataFrame:
    """(id, kept, title): cards of a contested id that hold the same text as an earlier one, under a title that may be its own; `title` is the better of both."""
    rows = _families(t).filter(_compatible(F.col("title"), F.col("kept_title")))
    better = F.when(F.length(F.coalesce("title", F.lit(""))) > F.length(F.coalesce("kept_title", F.lit(""))), F.col("title")).otherwise(F.col("kept_title"))
    return rows.select("id", "kept", better.alias("title"))


def swapped_texts(t: dict[str, DataFrame]) -> DataFrame:
    """(id, kept): cards that hold another act's text: the same text and preamble under titles that cannot be the same act's."""
    rows = _families(t).filter(~_compatible(F.col("title"), F.col("kept_title")) & F.col("preamble").eqNullSafe(F.col("kept_preamble")))
    return rows.select("id", "kept")


def removed(t: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without gone(id) acts, all they hold and all edges at either end."""
    g = gone.select("id").distinct()
    drop = lambda rows, c: rows.join(g.select(F.col("id").alias(c)), c, "left_anti").select(rows.columns)
    lost_par = t["paragraphs"].join(g.select(F.col("id").alias("act_id")), "act_id", "left_semi").select("id")
    lost_art = t["articles"].join(g.select(F.col("id").alias("act_id")), "act_id", "left_semi").select("id")
    out = dict(t)
    out["acts"], out["articles"], out["paragraphs"] = drop(t["acts"], "id"), drop(t["articles"], "act_id"), drop(t["paragraphs"], "act_id")
    out["chunks"] = t["chunks"].join(lost_par.select(F.col("id").alias("paragraph_id")), "paragraph_id", "left_anti").select(t["chunks"].columns)
    out["cites"] = drop(drop(t["cites"], "src_act_id"), "dst_act_id")
    ca = t["cites_article"].join(lost_par.select(F.col("id").alias("par_id")), "par_id", "left_anti").join(lost_art.select(F.col("id").alias("dst_article_id")), "dst_article_id", "left_anti")
    out["cites_article"] = ca.select(t["cites_article"].columns)
    out["repeals"] = drop(drop(t["repeals"], "src_act"), "dst_act")
    out["twins"] = drop(drop(t["twins"], "a"), "b")
    return out


def deduplicated(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without duplicate cards; the kept card takes the better title."""
    dup = graph.written(duplicates(t))
    out = removed(t, dup)
    titles = dup.groupBy(F.col("kept").alias("id")).agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("_t"))
    out["acts"] = out["acts"].join(titles, "id", "left").withColumn("title", F.coalesce("_t", "title")).select(t["acts"].columns)
    return out


def missing_citations(t: dict[str, DataFrame]) -> DataFrame:
    """Edges that the stored texts state and the table lacks, resolved by date as when loading."""
    from actweave.sources.tables import resolved_by_date

    rows = t["paragraphs"].select(F.col("id").alias("src_id"), "text", F.col("act_id").alias("src_act_id"))
    found = citations.extracted(rows, "text", "src_id", act="src_act_id").filter("target IS NOT NULL").join(rows.select("src_id", "src_act_id"), "src_id")
    new = schema.conformed(found.select("src_id", F.lit("paragraph").alias("src_kind"), "src_act_id", F.col("target").alias("dst_act_id"), "cite_text", "cited_article", "cited_par"), "cites")
    new = resolved_by_date(new, t["acts"]).filter("src_act_id <> dst_act_id")
    new = graph.latest(new, ["src_id", "dst_act_id", "cited_article"], [F.asc("cite_text"), F.asc_nulls_last("cited_par")])
    have = t["cites"].select("src_id", "dst_act_id", F.coalesce("cited_article", F.lit("")).alias("_a"))
    return new.withColumn("_a", F.coalesce("cited_article", F.lit(""))).join(have, ["src_id", "dst_act_id", "_a"], "left_anti").select(t["cites"].columns)


def tidied(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Citations of ghosts moved to the act that they mean, self-citations and stubs that nothing cites removed, titles and dates repaired."""
    from actweave.sources.tables import resolved_by_date

    cites = resolved_by_date(t["cites"], t["acts"]).filter("src_act_id <> dst_act_id")
    cites = graph.latest(cites, ["src_id", "dst_act_id", "cited_article"], [F.asc("cite_text"), F.asc_nulls_last("cited_par")])
    acts = tx.repair_mojibake(t["acts"], "title")
    acts = acts.withColumns({c: tx.clean_date(F.col(c), F.col("year")) for c in ("act_date", "pub_date", "force_date")})
    named = cites.select(F.col("dst_act_id").alias("id")).unionByName(t["repeals"].select(F.col("dst_act").alias("id"))).distinct()
    acts = acts.filter(F.coalesce("loaded", F.lit(False))).unionByName(acts.filter(~F.coalesce("loaded", F.lit(False))).join(named, "id", "left_semi").select(acts.columns))
    return t | {"cites": cites.select(t["cites"].columns), "acts": acts.select(t["acts"].columns)}


def force_dates(t: dict[str, DataFrame]) -> DataFrame:
    """`acts` with the day of entry into force that an act's own text states, where none is known and it lies within a year of the act; the first such clause counts."""
    day = tx.written_date(F.col("text"), FORCE)
    rows = t["paragraphs"].filter(F.lower("text").contains("in vigore")).select("act_id", F.col("id").alias("pid"), "ord", "article_id", day.alias("d")).filter("d IS NOT NULL")
    rows = rows.join(t["articles"].select(F.col("id").alias("article_id"), F.col("ord").alias("ao")), "article_id").join(t["acts"].select(F.col("id").alias("act_id"), "act_date"), "act_id").filter(F.abs(F.datediff("d", "act_date")) <= FORCE_DAYS)
    first = rows.groupBy("act_id").agg(F.min_by("d", F.struct("ao", "ord", "pid")).alias("_d")).withColumnRenamed("act_id", "id")
    out = t["acts"].join(first, "id", "left")
    return out.withColumn("force_source", F.when(F.col("force_date").isNull() & F.col("_d").isNotNull(), F.lit("text")).otherwise(F.col("force_source"))).withColumn("force_date", F.coalesce("force_date", "_d")).select(t["acts"].columns)


def located(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """`articles` with the document and first page of pages(act_id, number, url_doc, page), met by the article's key; what they had already stays."""
    first = pages.groupBy("act_id", ids.article_key(F.col("number")).alias("_k")).agg(F.min_by("url_doc", "page").alias("_u"), F.min("page").alias("_p"))
    out = articles.withColumn("_k", ids.article_key(F.col("number"))).join(first, ["act_id", "_k"], "left")
    return out.withColumns({"url_doc": F.coalesce("url_doc", "_u"), "page": F.coalesce("page", "_p")}).select(articles.columns)


def overlaid(paragraphs: DataFrame, articles: DataFrame, consolidated: DataFrame, source: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, articles) with the texts of consolidated(article_id, number, text) in place of the old ones.

    An article keeps its original text once: what it stored if that differs from the new text, else its old text if that does, else nothing. A paragraph whose
    text changes loses its vector; one that stays the same keeps it.
    """
    joined = lambda rows: rows.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("_t"))
    order = Window.partitionBy("article_id").orderBy(tx.leading_int(F.col("number")).asc_nulls_last(), "number")
    fresh = consolidated.select("article_id", "number", "text", F.row_number().over(order).alias("ord"))
    touched = fresh.select("article_id").distinct()
    old = joined(paragraphs.join(touched, "article_id", "left_semi")).withColumnRenamed("_t", "_old")
    new = joined(fresh).withColumnRenamed("_t", "_new")
    changes = new.join(old, "article_id", "left")
    stored = F.when(F.col("original_text") != F.col("_new"), F.col("original_text")).when(F.col("_old") != F.col("_new"), F.col("_old"))
    arts = articles.join(changes.withColumnRenamed("article_id", "id"), "id", "left")
    hit = F.col("_new").isNotNull()
    arts = arts.withColumns({"original_text": F.when(hit, stored).otherwise(F.col("original_text")), "text_source": F.when(hit, F.lit(source)).otherwise(F.col("text_source")), "text_as_of": F.when(hit, F.lit(as_of)).otherwise(F.col("text_as_of"))}).select(articles.columns)
    before = paragraphs.select("article_id", "number", F.col("text").alias("_was"), F.col("embedding").alias("_v"), F.col("id").alias("_id"))
    own = articles.select(F.col("id").alias("article_id"), "act_id")
    rows = fresh.join(own, "article_id").join(before, ["article_id", "number"], "left")
    rows = rows.select(F.coalesce("_id", ids.paragraph_id(F.col("article_id"), F.col("number"))).alias("id"), "article_id", "act_id", "number", "text", "ord", F.when(F.col("_was") == F.col("text"), F.col("_v")).alias("embedding"))
    kept = paragraphs.join(touched, "article_id", "left_anti").select(paragraphs.columns)
    return kept.unionByName(schema.conformed(rows, "paragraphs")), arts


def lost_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """(act_id, words, lost, chars, new_chars, ok) of before and after(act_id, text): how many words a rebuilt act loses, each as often as it does, and whether it may be written.

    It may if it keeps nine tenths of its characters and loses no more than three words or a hundredth of them.
    """
    words = lambda rows, c: rows.select("act_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("w")).groupBy("act_id", "w").agg(F.count("*").alias(c))
    both = words(before, "n").join(words(after, "m"), ["act_id", "w"], "left")
    per = both.groupBy("act_id").agg(F.sum("n").alias("words"), F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("lost"))
    size = before.groupBy("act_id").agg(F.sum(F.length("text")).alias("chars")).join(after.groupBy("act_id").agg(F.sum(F.length("text")).alias("new_chars")), "act_id", "left")
    rows = per.join(size, "act_id")
    ok = (F.coalesce("new_chars", F.lit(0)) >= KEPT_SHARE * F.col("chars")) & (F.col("lost") <= F.greatest(F.lit(LOST_WORDS), LOST_SHARE * F.col("words")))
    return rows.withColumn("ok", ok)


def reused_vectors(rows: DataFrame, old: DataFrame) -> DataFrame:
    """`rows`(id, text, ...) with the embedding of old(text, embedding) where the texts are equal; no call to an embedder is needed for these."""
    known = old.filter("embedding IS NOT NULL").groupBy(F.xxhash64("text").alias("_h"), F.md5("text").alias("_m")).agg(F.first("embedding").alias("_v"))
    out = rows.withColumns({"_h": F.xxhash64("text"), "_m": F.md5("text")}).join(known, ["_h", "_m"], "left").withColumnRenamed("_v", "embedding_new")
    return out.withColumn("embedding", F.coalesce("embedding", "embedding_new") if "embedding" in rows.columns else F.col("embedding_new")).drop("_h", "_m", "embedding_new")


def article_texts(paragraphs: DataFrame) -> DataFrame:
    """(article_id, text): an article's paragraphs in order; computed when needed, never stored, so it cannot drift."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))), lambda x: x["text"])
    return paragraphs.groupBy("article_id").agg(F.array_join(ordered, " ").alias("text"))


def twin_pairs(acts: DataFrame, ratified: DataFrame) -> DataFrame:
    """The table `twins`: consolidated texts with their base acts, decrees with the acts that ratify them."""
    from actweave.operators.enrich import bases

    own = bases(acts, schema.empty(acts.sparkSession, "twins")).select(F.lit("coordina").alias("kind"), F.col("act_id").alias("a"), F.col("base").alias("b"))
    return own.unionByName(ratified.select(F.lit("ratifica").alias("kind"), F.col("ratification").alias("a"), F.col("decree").alias("b"))).distinct()


def homologous(t: dict[str, DataFrame], pairs: DataFrame, least: float = SAME_ARTICLE) -> DataFrame:
    """(article_id, twin_article_id, ratio) of pairs(a, b): the article of the twin with the same number, or else the most similar one of `least` or more.

    Only articles of the same pair and of nearly the same length are compared; the ratio of matching blocks is computed in Python.
    """
    texts = article_texts(t["paragraphs"]).withColumnRenamed("article_id", "id")
    art = t["articles"].select("id", "act_id", ids.article_key(F.col("number")).alias("k")).join(texts, "id").withColumn("text", tx.collapsed(F.lower("text")))
    left = pairs.select("a", "b").distinct().join(art.select(F.col("id").alias("article_id"), F.col("act_id").alias("a"), "k", F.col("text").alias("ta")), "a")
    right = art.select(F.col("id").alias("twin_article_id"), F.col("act_id").alias("b"), "k", F.col("text").alias("tb"))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    same = left.join(right, ["b", "k"]).select("article_id", "twin_article_id", ratio("ta", "tb").alias("ratio"))
    rest = left.join(same.select("article_id"), "article_id", "left_anti").join(right.drop("k"), "b").filter((F.length("ta") * 0.6 <= F.length("tb")) & (F.length("tb") * 0.6 <= F.length("ta")))
    close = rest.select("article_id", "twin_article_id", ratio("ta", "tb").alias("ratio")).filter(F.col("ratio") >= least)
    return same.unionByName(graph.latest(close, ["article_id"], [F.desc("ratio"), F.asc("twin_article_id")]))


def twin_citations(t: dict[str, DataFrame]) -> DataFrame:
    """Edges to articles copied to the twin: who cites an article of one act of a pair, after both acts, cites its counterpart too."""
    pairs = graph.both_ways(t["twins"].select("a", "b")).distinct().join(t["twins"].select(F.col("a"), F.col("b"), F.col("kind").alias("k1")), ["a", "b"], "left").join(t["twins"].select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("kind").alias("k2")), ["a", "b"], "left").select("a", "b", F.when(F.coalesce("k1", "k2") == "coordina", "coordinato").otherwise("ratifica").alias("origin"))
    when = t["acts"].select("id", F.struct(F.coalesce("year", F.lit(0)).alias("y"), F.coalesce("act_date", F.lit("1000-01-01").cast("date")).alias("d")).alias("w"))
    art = t["articles"].select(F.col("id").alias("dst_article_id"), F.col("act_id").alias("a"), "number")
    edges = t["cites_article"].filter("origin IS NULL").select("par_id", "dst_article_id").join(art, "dst_article_id").join(pairs, "a").join(t["paragraphs"].select(F.col("id").alias("par_id"), F.col("act_id").alias("src")), "par_id")
    for c in ("a", "b", "src"):
        edges = edges.join(when.select(F.col("id").alias(c), F.col("w").alias(f"w_{c}")), c)
    edges = edges.filter("w_src > w_a AND w_src > w_b AND src <> b AND src <> a")
    to = homologous(t, pairs).select(F.col("article_id").alias("dst_article_id"), "twin_article_id")
    twin_act = t["articles"].select(F.col("id").alias("twin_article_id"), F.col("act_id").alias("ta"))
    new = edges.join(to, "dst_article_id").join(twin_act, "twin_article_id").filter("ta = b").select("par_id", F.col("twin_article_id").alias("dst_article_id"), "origin", F.col("a").alias("named_act"), F.col("number").alias("named_article"))
    return graph.missing(schema.conformed(new, "cites_article"), t["cites_article"], ["par_id", "dst_article_id"])


def qa_metrics(t: dict[str, DataFrame], long: int = 6000, short: int = 200) -> DataFrame:
    """One row for each act: articles, characters, whether nearly empty, long paragraphs, the highest number and the share of numbers that are missing."""
    par = t["paragraphs"].groupBy("act_id").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.when(F.length("text") > long, 1).otherwise(0)).alias("long_paragraphs"), F.count("*").alias("n_paragraphs"))
    base = F.when(F.col("annex").isNull(), tx.leading_int(F.col("number")))
    art = t["articles"].groupBy("act_id").agg(F.count("*").alias("n_articles"), F.max(base).alias("highest"), F.countDistinct(base).alias("numbers"))
    rows = art.join(par, "act_id", "full_outer")
    return rows.select("act_id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), (F.coalesce("n_chars", F.lit(0)) < short).alias("nearly_empty"), F.coalesce("long_paragraphs", F.lit(0)).alias("long_paragraphs"), "highest", F.when(F.col("highest") > 0, 1 - F.col("numbers") / F.col("highest")).alias("gap_ratio"))


def increasing_runs(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """(key, longest): the longest run of strictly increasing numbers of each key, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.when(F.lag(number).over(w) < F.col(number), 0).otherwise(1)
    return rows.withColumn("_s", starts).withColumn("_i", F.sum("_s").over(w)).groupBy(key, "_i").count().groupBy(key).agg(F.max("count").alias("longest"))
