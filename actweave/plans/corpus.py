"""The query API over a corpus: search, read, outline, find, catalogue, and citations in both directions."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actweave import schema
from actweave.functions import ids
from actweave.functions import text as tx
from actweave.operators import enrich, graph, lexicon, ranking
from actweave.sources import tables as store

# Weights of the lists in the fusion, over-fetching, limits of what is shown and read.
SEMANTIC, LEXICAL, PARAGRAPHS, RUBRICS = 1.0, 0.75, 1.0, 0.7
POOL, FILTERED = 3, 8
MAX_TEXT, READ_PARAGRAPH, READ_ARTICLE, PREVIEW = 2000, 10_000, 15_000, 200
ALIKE, MIN_RUBRIC, COMPARED = 0.82, 12, 400
POINTS = 6


def merged(pool: pd.DataFrame, limit: int) -> pd.DataFrame:
    """One query's fused candidates in order of their score → what is shown: later editions of the same entry take its place.

    Two entries are the same if their acts differ, rubric (a long one) and article number agree and their texts share most characters. The entry
    shown is that of the latest year, then not repealed, of a canonical id, of the largest id; the acts of the others go into `also_in`.
    """
    shown: list[dict] = []
    for r in pool.sort_values(["score", "first"], ascending=[False, True]).to_dict("records"):
        r["also_in"] = list(r["also_in"]) if r["also_in"] is not None else []
        twin = next((k for k, x in enumerate(shown) if _same_entry(x, r)), None)
        if twin is not None:
            shown[twin] = _representative(shown[twin], r)
        elif len(shown) < limit:
            shown.append(r)
    out = pd.DataFrame(shown, columns=pool.columns)
    out["rank"] = range(1, len(out) + 1)
    return out


def _same_entry(a: dict, b: dict) -> bool:
    rubric = " ".join((a["rubric"] or "").lower().split())
    if a["act_id"] == b["act_id"] or len(rubric) < MIN_RUBRIC or rubric != " ".join((b["rubric"] or "").lower().split()) or a["article"] != b["article"]:
        return False
    one, two = (a["text"] or "")[:COMPARED], (b["text"] or "")[:COMPARED]
    return bool(one and two) and difflib.SequenceMatcher(None, one, two).quick_ratio() >= ALIKE


def _representative(a: dict, b: dict) -> dict:
    def rank(x: dict) -> tuple:
        year = 0 if pd.isna(x["year"]) else x["year"]
        return year, not (x["act_repealed"] is True), "~" not in x["act_id"], x["act_id"]

    best, other = (b, a) if rank(b) > rank(a) else (a, b)
    also = [x for x in dict.fromkeys([*a["also_in"], other["act_id"], *b["also_in"]]) if x != best["act_id"]]
    return {**best, "also_in": also, "score": max(a["score"], b["score"])}


class Corpus:
    """A corpus of acts as tables (see schema.TABLES); every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], index: str | None = None):
        self.spark = spark
        self.t = {n: tables[n] if n in tables else schema.empty(spark, n) for n in schema.TABLES}
        self.lexicons = {n: lexicon.Lexicon(spark, f"{index}/{n}") for n in ("paragraphs", "chunks")} if index else None

    @classmethod
    def read(cls, spark: SparkSession, path: str, index: str | None = None) -> Corpus:
        """The corpus of a folder, and the full-text index of another one, if there is one."""
        return cls(spark, store.read(spark, path), index)

    def indexed(self, path: str) -> Corpus:
        """Builds the full-text index of paragraphs with their rubrics and of chunks in a new folder; searches of the corpus returned read it instead of the texts."""
        rubrics = self.t["articles"].select(F.col("id").alias("article_id"), "rubric")
        pars = self.t["paragraphs"].filter("text IS NOT NULL AND trim(text) <> ''").join(rubrics, "article_id", "left")
        lexicon.Lexicon.build(pars.select("id", F.concat_ws(" ", "rubric", "text").alias("text")), f"{path}/paragraphs", key="id")
        lexicon.Lexicon.build(self.t["chunks"], f"{path}/chunks", key="id")
        return Corpus(self.spark, self.t, path)

    def register_views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for n, rows in self.t.items():
            rows.createOrReplaceTempView(prefix + n)

    # ---- search

    def _filters(self, year_from, year_to, prefixes: Iterable[str] | None, exclude_repealed: bool) -> DataFrame:
        """Paragraphs with their article and act, filtered by what is asked for; unknown prefixes are an error, not an empty result."""
        acts = self.t["acts"]
        if prefixes is not None:
            wanted = [p.upper() for p in prefixes]
            if unknown := sorted(set(wanted) - set(ids.LABELS) - {"X"}):
                raise ValueError(f"unknown types {unknown}; known are {sorted(ids.LABELS)}")
            acts = acts.filter(F.split_part("id", F.lit("-"), F.lit(1)).isin(wanted))
        if year_from is not None:
            acts = acts.filter(F.col("year") >= year_from)
        if year_to is not None:
            acts = acts.filter(F.col("year") <= year_to)
        a = acts.select(F.col("id").alias("act_id"), F.col("title").alias("act_title"), "year", "act_date", "force_date", F.col("repealed").alias("act_repealed"), F.col("repealed_by").alias("act_repealed_by"), F.col("url_doc").alias("_url"))
        art = self.t["articles"].select(F.col("id").alias("article_id"), F.col("number").alias("article"), "rubric", "rubric_embedding", "part_title", "chapter_rubric", F.col("repealed").alias("_ar"), F.col("repealed_by").alias("_arb"), F.coalesce("url_doc", F.lit(None)).alias("_aurl"), "page")
        par = self.t["paragraphs"].filter("text IS NOT NULL AND trim(text) <> ''").select(F.col("id").alias("par_id"), "article_id", "act_id", F.col("number").alias("par_number"), "text", "embedding", F.col("repealed").alias("_pr"), F.col("repealed_by").alias("_prb"))
        rows = par.join(art, "article_id").join(a, "act_id")
        no = F.lit(False)
        if exclude_repealed:
            rows = rows.filter(~(F.coalesce("act_repealed", no) | F.coalesce("_pr", no) | F.coalesce("_ar", no)))
        return rows.withColumns({"repealed": F.when(F.coalesce("_pr", no) | F.coalesce("_ar", no), F.lit(True)), "repealed_by": F.coalesce("_prb", "_arb"), "url_doc": F.coalesce("_aurl", "_url")}).drop("_pr", "_ar", "_prb", "_arb", "_aurl", "_url")

    def _lexical(self, units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, par_id, start, score): BM25 over paragraphs with their rubrics, and over chunks, each shown as its paragraph; from the stored index, if there is one."""
        if self.lexicons:
            allowed = units.select(F.col("par_id").alias("id"))
            whole = self.lexicons["paragraphs"].search(queries, "query_id", k, key="id", allowed=allowed).select("query_id", F.col("id").alias("par_id"), F.lit(None).cast("int").alias("start"), "score")
            own = self.t["chunks"].select("id", F.col("paragraph_id").alias("par_id"), "start").join(units.select("par_id"), "par_id", "left_semi")
            return whole.unionByName(self.lexicons["chunks"].search(queries, "query_id", k, key="id", allowed=own).join(own, "id").select("query_id", "par_id", "start", "score"))
        docs = units.select("par_id", F.concat_ws(" ", "rubric", "text").alias("text"))
        whole = ranking.bm25(docs, queries, "query_id", k, key="par_id").select("query_id", "par_id", F.lit(None).cast("int").alias("start"), "score")
        parts = self.t["chunks"].join(units.select(F.col("par_id").alias("paragraph_id")), "paragraph_id", "left_semi").select("id", "text")
        found = ranking.bm25(parts, queries, "query_id", k, key="id").join(self.t["chunks"].select("id", F.col("paragraph_id").alias("par_id"), "start"), "id")
        return whole.unionByName(found.select("query_id", "par_id", "start", "score"))

    def _semantic(self, units: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Cosine neighbours among paragraphs and chunks, and among rubrics, whose article's first paragraph stands for them."""
        asked = queries.filter("vector IS NOT NULL").select(F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("id"), F.col("vector").alias("embedding"), "query_id")
        back = asked.select(F.col("id").alias("_q"), F.col("query_id").alias("_id"))

        def near(rows: DataFrame) -> DataFrame:
            found = ranking.cosine(rows.filter("embedding IS NOT NULL"), asked.select("id", "embedding"), k, key="id")
            return found.join(back, F.col("query_id") == F.col("_q")).select(F.col("_id").alias("query_id"), "id", "score")

        whole = near(units.select(F.col("par_id").alias("id"), "embedding")).select("query_id", F.col("id").alias("par_id"), F.lit(None).cast("int").alias("start"), "score")
        allowed = self.t["chunks"].join(units.select(F.col("par_id").alias("paragraph_id")), "paragraph_id", "left_semi")
        parts = near(allowed.select("id", "embedding")).join(allowed.select("id", F.col("paragraph_id").alias("par_id"), "start"), "id").select("query_id", "par_id", "start", "score")
        first = units.groupBy("article_id").agg(F.min("par_id").alias("par_id"), F.first("rubric_embedding").alias("embedding"))
        rubrics = near(first.select(F.col("article_id").alias("id"), "embedding")).join(first.select(F.col("article_id").alias("id"), "par_id"), "id").select("query_id", "par_id", F.lit(None).cast("int").alias("start"), "score")
        return whole.unionByName(parts), rubrics

    def _ranked(self, hits: DataFrame, units: DataFrame, k: int) -> DataFrame:
        """(query_id, par_id, rank, start, more, fp): one entry for a paragraph, with the offset of its best chunk and of three more; of equal texts the best."""
        best = hits.groupBy("query_id", "par_id").agg(F.max("score").alias("score"), F.max_by("start", "score").alias("start"), F.collect_set("start").alias("all"))
        rows = best.join(units.select("par_id", "year", tx.fingerprint(F.col("text")).alias("fp")), "par_id")
        order = [F.desc("score"), F.desc_nulls_last("year"), F.asc("par_id")]
        # equal texts of one act count once here; those of different acts meet in the fusion
        rows = rows.join(units.select("par_id", "act_id"), "par_id")
        rows = ranking.top(rows, 1, ["query_id", "fp", "act_id"], order).drop("rank")
        more = F.slice(F.array_sort(F.filter("all", lambda x: ~x.eqNullSafe(F.col("start")))), 1, 3)
        return ranking.top(rows, k, ["query_id"], order).select("query_id", "par_id", "act_id", "rank", "start", more.alias("more"), "fp")

    def search(self, queries, k: int = 8, year_from: int | None = None, year_to: int | None = None, prefixes: Iterable[str] | None = None, exclude_repealed: bool = False, mode: str = "hybrid", currency: bool = True) -> DataFrame:
        """Hybrid search for one text or for a DataFrame(query_id, text, vector), filtered before it ranks.

        Lexical and semantic lists are fused by reciprocal ranks, equal and nearly equal texts of different acts merged, and the k (10 at most) results
        annotated with what later acts did to them. mode: "hybrid", "lexical" or "semantic".
        """
        if mode not in ("hybrid", "lexical", "semantic"):
            raise ValueError(f"unknown mode {mode!r}")
        k = max(1, min(k, 10))
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries, None)], "query_id int, text string, vector array<float>")
        units = self._filters(year_from, year_to, prefixes, exclude_repealed)
        pool = POOL * k
        lists = []
        if mode != "lexical":
            close, rubrics = self._semantic(units, queries, pool * FILTERED)
            inner = [(self._ranked(close, units, pool), PARAGRAPHS, 0), (self._ranked(rubrics, units, pool), RUBRICS, 1)]
            lists.append((self._fuse(inner, pool), SEMANTIC, 0))
        if mode != "semantic":
            lists.append((self._ranked(self._lexical(units, queries, pool * FILTERED), units, pool), LEXICAL, 1))
        fused = graph.written(self._fuse(lists, pool))  # at most `pool` rows of each query
        rows = fused.join(units.drop("embedding", "rubric_embedding"), ["par_id", "act_id"])
        merged_schema = rows.select("*").schema

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            return merged(pdf, k)

        # at most `pool` candidates of one query meet here
        rows = rows.groupBy("query_id").applyInPandas(finish, merged_schema)
        offset = F.coalesce(F.col("start"), F.lit(0))
        part = F.when(F.col("start").isNotNull(), F.substring("text", offset + 1, F.lit(MAX_TEXT + 1))).otherwise(F.col("text"))
        rows = rows.withColumns({"length": F.length("text"), "text": part}).withColumns({"truncated": F.length("text") > MAX_TEXT, "text": tx.truncated(F.col("text"), MAX_TEXT)})
        return self.with_currency(enrich.newer_in_list(rows, F.col("query_id"))) if currency else rows

    def _fuse(self, lists: list[tuple[DataFrame, float, int]], k: int) -> DataFrame:
        """Lists with weights → (query_id, par_id, act_id, rank, score, first, start, more, fp, also_in): equal texts are one candidate, shown as their best act's."""
        union = None
        for rows, weight, number in lists:
            part = rows.select("query_id", "par_id", "act_id", "fp", "start", "more", (F.lit(weight) / (ranking.RRF_K + F.col("rank"))).alias("w"), (F.lit(number * 1000) + F.col("rank")).alias("o"), F.lit(number).alias("list"))
            union = part if union is None else union.unionByName(part)
        acts = self.t["acts"].select(F.col("id").alias("act_id"), "year", F.coalesce("repealed", F.lit(False)).alias("gone"))
        rows = union.join(acts, "act_id")
        rank = F.struct(F.coalesce("year", F.lit(0)).alias("a"), (~F.col("gone")).alias("b"), (~F.col("act_id").contains("~")).alias("c"), F.col("act_id").alias("d"), F.col("start").isNotNull().alias("e"), (-F.col("o")).alias("f"))
        best = F.max_by(F.struct("par_id", "act_id", "start", "more"), rank)
        # in one list a text counts once, at its best rank
        first = F.row_number().over(Window.partitionBy("query_id", "fp", "list").orderBy("o", "par_id"))
        rows = rows.withColumn("w", F.when(first == 1, F.col("w")).otherwise(0.0))
        one = rows.groupBy("query_id", "fp").agg(F.sum("w").alias("score"), F.min("o").alias("first"), best.alias("x"), F.collect_set("act_id").alias("all"))
        one = one.select("query_id", "x.par_id", "x.act_id", F.round("score", 9).alias("score"), "first", "x.start", "x.more", "fp", F.array_sort(F.array_remove("all", F.col("x.act_id"))).alias("also_in"))
        return ranking.top(one, k, ["query_id"], [F.desc("score"), F.asc("first"), F.asc("par_id")])

    def with_currency(self, rows: DataFrame) -> DataFrame:
        """Results (act_id, article) with every annotation of enrich; top-k comes first, so the joins see few rows."""
        rows = graph.written(rows)  # few rows, and the annotations read them often
        keys = rows.select("act_id", "article").distinct()
        for f in (enrich.cited_later, enrich.updated_in, enrich.fallen, enrich.act_rewritten_by, enrich.later_provisions):
            rows = rows.join(f(keys, self.t), ["act_id", "article"], "left")
        return rows

    # ---- reading

    def article(self, act_id: str, number: str, par: str | None = None, start: int = 0) -> DataFrame:
        """An article's paragraphs in order, within the reading limits; with `par` one paragraph from the character `start` on. Unknown articles are an error that names those there are."""
        arts = self.t["articles"].filter(F.col("act_id") == act_id)
        own = arts.filter(F.col("number") == str(number))
        if own.isEmpty():
            there = [r["number"] for r in arts.orderBy("ord").select("number").limit(61).collect()]
            raise LookupError(f"{act_id} is not loaded" if not there else f"no article {number} in {act_id}; there are {there[:60]}{' and more' if len(there) > 60 else ''}")
        rows = self.t["paragraphs"].join(own.select(F.col("id").alias("article_id"), "rubric", F.col("repealed").alias("article_repealed")), "article_id")
        full = F.length("text")
        if par is not None:
            rows = rows.filter(F.col("number") == str(par))
            if rows.isEmpty():
                raise LookupError(f"no paragraph {par} in article {number} of {act_id}")
            shown = F.substring("text", start + 1, READ_PARAGRAPH)
            return rows.select("id", "number", shown.alias("text"), full.alias("length"), F.lit(start).alias("from_char"), (F.lit(start + READ_PARAGRAPH) < full).alias("truncated"), F.when(F.lit(start + READ_PARAGRAPH) < full, start + READ_PARAGRAPH).alias("continue_at"), F.lit(False).alias("omitted"), "repealed", "repealed_by", "ord")
        order = Window.partitionBy("article_id").orderBy("ord", "id")
        p = ranking.portions(F.coalesce(full, F.lit(0)).cast("double"), order, float(READ_PARAGRAPH), float(READ_ARTICLE))
        rows = rows.withColumns({"shown": p["shown"].cast("int"), "omitted": p["omitted"], "_t": p["truncated"]})
        text = F.when(F.col("omitted"), F.left("text", F.lit(PREVIEW))).otherwise(F.substring("text", F.lit(1), F.col("shown")))
        cut = F.col("_t") & ~F.col("omitted")
        return rows.select("id", "number", text.alias("text"), full.alias("length"), F.lit(0).alias("from_char"), cut.alias("truncated"), F.when(cut, F.col("shown")).alias("continue_at"), "omitted", "repealed", "repealed_by", "ord").orderBy("ord", "id")

    def article_currency(self, act_id: str, number: str) -> DataFrame:
        """One row with the annotations of an article, newer versions by rubric included."""
        keys = self.t["articles"].filter((F.col("act_id") == act_id) & (F.col("number") == str(number))).select("act_id", F.col("number").alias("article"))
        return self.with_currency(keys).join(enrich.newer_versions(keys, self.t), ["act_id", "article"], "left")

    def outline(self, act_id: str) -> DataFrame:
        """The articles of an act in order with the counts of their paragraphs."""
        arts = self.t["articles"].filter(F.col("act_id") == act_id)
        n = self.t["paragraphs"].filter(F.col("act_id") == act_id).groupBy("article_id").agg(F.count("*").alias("n"))
        return arts.join(n, arts["id"] == n["article_id"], "left").select("number", "rubric", "part_title", "part_title_rubric", "chapter", "chapter_rubric", F.coalesce("n", F.lit(0)).alias("n_paragraphs"), "ord").orderBy("ord", "number")

    def document_url(self, act_id: str, number: str | None = None) -> str | None:
        """The article's document if it has its own, else the act's."""
        act = self.t["acts"].filter(F.col("id") == act_id).select("url_doc").first()
        art = None if number is None else self.t["articles"].filter((F.col("act_id") == act_id) & (F.col("number") == str(number))).select("url_doc").first()
        return (art and art[0]) or (act and act[0])

    # ---- finding

    def _counted(self, acts: DataFrame) -> DataFrame:
        n = self.t["articles"].join(acts.select(F.col("id").alias("act_id")), "act_id", "left_semi").groupBy("act_id").agg(F.count("*").alias("n"))
        return acts.join(n, acts["id"] == n["act_id"], "left").select("id", "type", "number", "year", "act_date", "title", "loaded", "repealed", "repealed_by", F.coalesce("n", F.lit(0)).alias("n_articles"))

    def find_act(self, number: int | None = None, year: int | None = None, type: str | None = None, title: str | None = None) -> DataFrame:
        """Acts by number, year and type, the latest first, ten at most; or by words of the title, whose last letters may be missing.

        `match` is "exact", "title", or "nearest" for the acts of the same number offered on a miss.
        """
        acts = self.t["acts"]
        if number is not None:
            same = acts.filter(F.col("number_int") == number)
            found = same if year is None else same.filter(F.col("year") == year)
            if type is not None:
                found = found.filter(F.lower("type").contains(type.lower()))
            if not found.isEmpty():
                return self._counted(found.orderBy(F.desc_nulls_first("year"), "id").limit(10)).withColumn("match", F.lit("exact")).orderBy(F.desc_nulls_first("year"), "id")
            if title is None:
                near = same.withColumn("_d", F.abs(F.col("year") - F.lit(year)) if year is not None else F.lit(0)).orderBy(F.asc_nulls_last("_d"), F.desc_nulls_last("year"), "id").limit(8).drop("_d")
                return self._counted(near).withColumn("match", F.lit("nearest")).orderBy(F.asc_nulls_last(F.abs(F.col("year") - F.lit(year or 0))), F.desc_nulls_last("year"), "id")
        words = self.spark.createDataFrame([(0, title or "")], "query_id int, text string").select(F.explode(F.array_distinct(ranking.terms(F.col("text")))).alias("w"))
        vocabulary = acts.select(F.explode(ranking.terms(F.coalesce("title", F.lit("")))).alias("term")).distinct()
        known = vocabulary.join(F.broadcast(words), (F.col("term") == F.col("w")) | ((F.length("w") >= 4) & F.col("term").startswith(F.col("w")))).select("term").distinct()
        query = known.agg(F.array_join(F.collect_set("term"), " ").alias("text")).select(F.lit(0).alias("query_id"), "text")
        hits = ranking.bm25(acts.select("id", F.coalesce("title", F.lit("")).alias("text")), query, "query_id", 50, key="id").select("id", "score")
        rows = acts.join(hits, "id")
        if year is not None:
            rows = rows.filter(F.col("year") == year)
        top = rows.orderBy(F.desc("score"), F.desc_nulls_last("year"), "id").limit(10)
        return self._counted(top.drop("score")).join(hits, "id").withColumn("match", F.lit("title")).orderBy(F.desc("score"), F.desc_nulls_last("year"), "id")

    def catalogue(self) -> DataFrame:
        """Acts by type: in all, with text and as stubs."""
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        loaded = F.coalesce("loaded", F.lit(False))
        return self.t["acts"].groupBy("prefix").agg(F.count("*").alias("total"), one(loaded).alias("loaded"), one(~loaded).alias("stubs"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).orderBy(F.desc("loaded"), F.asc_nulls_last("prefix"))

    def acts_of(self, prefix: str | None = None, year: int | None = None, month: int | None = None, repealed: bool | None = None, limit: int = 50) -> DataFrame:
        """An extract of the catalogue, the latest first, a hundred at most."""
        rows = self.t["acts"].filter(F.coalesce("loaded", F.lit(False)))
        if prefix is not None:
            rows = rows.filter(F.col("prefix") == prefix)
        if year is not None:
            rows = rows.filter(F.col("year") == year)
        if month is not None:
            rows = rows.filter(F.month("act_date") == month)
        if repealed is not None:
            rows = rows.filter(F.coalesce("repealed", F.lit(False)) == repealed)
        order = [F.desc_nulls_first("act_date"), F.desc_nulls_first("year"), F.asc("id")]
        return self._counted(rows.orderBy(*order).limit(max(1, min(limit, 100)))).orderBy(*order)

    # ---- citations

    def outgoing(self, act_id: str) -> DataFrame:
        """What an act cites, the most cited first, with at most six places; preambles count as the basis."""
        rows = self.t["cites"].filter(F.col("src_act_id") == act_id)
        point = F.when(F.col("cited_article").isNotNull(), F.concat(F.lit("art."), "cited_article", F.coalesce(F.concat(F.lit(" c."), "cited_par"), F.lit(""))))
        per = rows.groupBy("dst_act_id").agg(F.count("*").alias("times"), F.bool_or(F.coalesce(F.col("origin") == "preamble", F.lit(False))).alias("basis"), tx.capped(F.collect_set(point), POINTS).alias("points"))
        acts = self.t["acts"].select(F.col("id").alias("dst_act_id"), "title", "year", "loaded", "repealed")
        return per.join(acts, "dst_act_id", "left").orderBy(F.desc("times"), "dst_act_id")

    def incoming(self, act_id: str, year_from: int | None = None, limit: int = 20) -> DataFrame:
        """Which acts cite an act or its twins; by year where a first year is given, else by how often."""
        twins = enrich.twin_acts(self.t["acts"], self.t["twins"]).filter(F.col("act_id") == act_id).select(F.col("twin").alias("dst_act_id"))
        wanted = twins.unionByName(self.spark.createDataFrame([(act_id,)], "dst_act_id string")).distinct()
        rows = self.t["cites"].join(F.broadcast(wanted), "dst_act_id", "left_semi").filter(F.col("src_act_id") != F.lit(act_id))
        art = self.t["paragraphs"].select(F.col("id").alias("src_id"), "article_id").join(self.t["articles"].select(F.col("id").alias("article_id"), F.col("number").alias("article")), "article_id").select("src_id", "article")
        per = rows.join(art, "src_id", "left").groupBy("src_act_id").agg(F.count("*").alias("times"), tx.capped(F.collect_set("article"), POINTS).alias("articles"))
        acts = self.t["acts"].select(F.col("id").alias("src_act_id"), "title", "year", "repealed")
        per = per.join(acts, "src_act_id")
        if year_from is not None:
            per = per.filter(F.col("year") >= year_from).orderBy(F.desc_nulls_last("year"), F.desc("times"), "src_act_id")
        else:
            per = per.orderBy(F.desc("times"), "src_act_id")
        return per.limit(limit)

    # ---- state

    def status(self) -> DataFrame:
        """One row: loaded and stub acts, articles, paragraphs, chunks and edges."""
        loaded = F.coalesce("loaded", F.lit(False))
        out = self.t["acts"].agg(F.sum(F.when(loaded, 1).otherwise(0)).alias("acts"), F.sum(F.when(loaded, 0).otherwise(1)).alias("stubs"))
        for n in ("articles", "paragraphs", "chunks", "cites", "cites_article", "repeals", "twins"):
            out = out.withColumn(n, F.lit(self.t[n].count()))
        return out

    def most_cited(self, n: int = 10) -> DataFrame:
        """The acts with the most citations, and whether they are loaded."""
        per = self.t["cites"].groupBy(F.col("dst_act_id").alias("id")).agg(F.count("*").alias("citations"))
        return per.join(self.t["acts"].select("id", "title", "loaded"), "id", "left").orderBy(F.desc("citations"), "id").limit(n)

    def worklist(self) -> DataFrame:
        """Acts that are cited but not loaded, the most cited first."""
        return graph.stubs(self.t["cites"].select(F.col("dst_act_id").alias("dst")), self.t["acts"].filter("loaded").select("id"))

    def violations(self) -> DataFrame:
        return schema.violations(self.t)
