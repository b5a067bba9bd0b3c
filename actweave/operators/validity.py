"""What later acts repealed: edges between acts, marks on acts, articles and paragraphs, and the clauses that still wait.

Marks are positive evidence only: null means that nothing was found, never that something is in force. All results depend on the day that is given.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actweave import schema
from actweave.functions import citations, ids, repeals
from actweave.functions import text as tx
from actweave.operators import graph

# Days by which a cited date may miss the act's, and titles that say that an act is gone.
TOLERANCE = 31
TITLE_REPEALED, TITLE_LAPSED = r"(?i)\bAB(?:R|G)OGAT", r"(?i)\bDECADUT"
CLAUSE = 400


def _prefixes() -> Column:
    return F.create_map(*[x for kind, ps in repeals.PREFIXES.items() for x in (F.lit(kind), F.array(*map(F.lit, sorted(ps))))])


def resolved(targets: DataFrame, acts: DataFrame) -> DataFrame:
    """targets(number, year, kind, ...) with `dst_act` and `reject_reason`: the one act of that number, year and type.

    The stated type chooses among the acts that share number and year: "absent" without any, "type" if none has it, "ambiguous" if several do.
    """
    known = acts.select(F.col("id").alias("_id"), F.col("number_int").alias("number"), "year", F.split_part("id", F.lit("-"), F.lit(1)).alias("_p"))
    wanted = F.try_element_at(_prefixes(), F.col("kind"))
    keys = targets.select("number", "year", "kind").distinct()
    rows = keys.join(known, ["number", "year"], "left").withColumn("_ok", F.col("_id").isNotNull() & (wanted.isNull() | F.array_contains(wanted, F.col("_p"))))
    one = rows.groupBy("number", "year", "kind").agg(F.sum(F.col("_ok").cast("int")).alias("_n"), F.count("_id").alias("_all"), F.max(F.when(F.col("_ok"), F.col("_id"))).alias("_to"))
    reason = F.when(F.col("_all") == 0, "absent").when(F.col("_n") == 0, "type").when(F.col("_n") > 1, "ambiguous")
    return targets.join(one.select("number", "year", "kind", F.when(F.col("_n") == 1, F.col("_to")).alias("dst_act"), reason.alias("reject_reason")), ["number", "year", "kind"], "left")


def _stated_date(text: Column, number: Column) -> Column:
    """The date written right before "n.<number>" in the text."""
    dates = F.regexp_extract_all(text, F.lit(rf"(?i)([0-9]{{1,2}}\s*[°º]?\s+(?:{citations.MONTH})\s+[0-9]{{4}})\s*,?\s*n\.?\s*[0-9]+\b"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(rf"(?i)[0-9]{{1,2}}\s*[°º]?\s+(?:{citations.MONTH})\s+[0-9]{{4}}\s*,?\s*n\.?\s*([0-9]+)\b"), F.lit(1))
    hit = F.filter(F.arrays_zip(dates.alias("d"), numbers.alias("n")), lambda x: x["n"].try_cast("int") == number)
    return tx.written_date(F.try_element_at(F.transform(hit, lambda x: x["d"]), F.lit(1)))


def repealing_edges(paragraphs: DataFrame, acts: DataFrame, as_of: datetime.date) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects): acts repealed as a whole by paragraphs(id, act_id, text).

    A target is rejected if it cannot be resolved, is the act itself, is later than it, or if the clause dates it more than TOLERANCE days away.
    """
    rows = paragraphs.select(F.col("id").alias("par_id"), "act_id", "text")
    found = repeals.targets(rows.select("par_id", "text"), as_of).join(rows, "par_id")
    found = resolved(found, acts)
    src = acts.select(F.col("id").alias("act_id"), F.col("year").alias("src_year"), F.col("act_date").alias("src_date"))
    dst = acts.select(F.col("id").alias("dst_act"), F.col("year").alias("dst_year"), F.col("act_date").alias("dst_date"))
    found = found.join(src, "act_id").join(dst, "dst_act", "left")
    off = F.abs(F.datediff(_stated_date(F.translate("text", "’‘ʼ", "'''"), F.col("number")), F.col("dst_date"))) > TOLERANCE
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("dst_act") == F.col("act_id"), "itself")
        .when((F.col("dst_year") > F.col("src_year")) | (F.col("dst_date") > F.col("src_date")), "later than the source")
        .when(off, "another date")
    )
    found = found.withColumn("reject_reason", reason)
    good = found.filter("reject_reason IS NULL").groupBy(F.col("act_id").alias("src_act"), "dst_act").agg(F.min_by(F.struct("par_id", F.left("text", F.lit(CLAUSE)).alias("clause")), "par_id").alias("x"))
    edges = schema.conformed(good.select("src_act", "dst_act", "x.par_id", "x.clause", F.lit(False).alias("via_ratification")), "repeals")
    return edges, found.filter("reject_reason IS NOT NULL").select("par_id", "act_id", "number", "year", "kind", "reject_reason")


def ratifications(acts: DataFrame) -> DataFrame:
    """(ratification, decree): acts whose title ratifies exactly one decree that is there and not later."""
    rows = acts.filter(F.lower("title").rlike(r"\bratific") & F.lower("title").contains("decret")).select(F.col("id").alias("act_id"), F.col("title").alias("text"), "year")
    cited = citations.extracted(rows.select("act_id", "text"), "text", "act_id", act="act_id").filter("target IS NOT NULL AND type LIKE 'decreto%'")
    there = acts.select(F.col("id").alias("target"), F.col("year").alias("decree_year"))
    found = cited.join(there, "target").join(rows.select("act_id", F.col("year").alias("own_year")), "act_id").filter("decree_year <= own_year")
    return graph.unique(found.select("act_id", "target").distinct(), ["act_id"], "target").select(F.col("act_id").alias("ratification"), F.col("target").alias("decree"))


def propagated(pairs: DataFrame, edges: DataFrame, acts: DataFrame) -> DataFrame:
    """`edges` with those that follow from pairs(ratification, decree), until nothing new follows: who repeals one of a pair repeals the other.

    An act never repeals a later one, nor itself, nor the other of its own pair.
    """
    spark = edges.sparkSession
    twin = graph.both_ways(pairs.select(F.col("ratification").alias("a"), F.col("decree").alias("b"))).distinct()
    years = acts.select("id", "year")
    seen = graph.written(edges.select("src_act", "dst_act").distinct())
    new = seen
    derived = spark.createDataFrame([], "src_act string, dst_act string")
    own = twin.select(F.col("a").alias("src_act"), F.col("b").alias("dst_act"))
    while True:
        found = new.join(twin, F.col("dst_act") == F.col("a")).select("src_act", F.col("b").alias("dst_act")).distinct().filter("src_act <> dst_act")
        found = found.join(years.select(F.col("id").alias("src_act"), F.col("year").alias("ys")), "src_act").join(years.select(F.col("id").alias("dst_act"), F.col("year").alias("yd")), "dst_act").filter("yd <= ys").select("src_act", "dst_act")
        new = graph.written(found.join(own, ["src_act", "dst_act"], "left_anti").join(seen, ["src_act", "dst_act"], "left_anti"))
        if new.isEmpty():
            break
        derived = derived.unionByName(new)
        seen = graph.written(seen.unionByName(new))
    return edges.unionByName(schema.conformed(derived.withColumn("via_ratification", F.lit(True)), "repeals"))


def partial_marks(t: dict[str, DataFrame], as_of: datetime.date) -> tuple[DataFrame, DataFrame]:
    """(articles, paragraphs): (id, repealed_by) of those that clauses repeal within living acts.

    A target counts if the clause names exactly one resolvable act for it, no later than its own, and exactly one article or paragraph has that number. Where
    no act is named next to it, the edge from the paragraph to the article decides.
    """
    rows = t["paragraphs"].select(F.col("id").alias("par_id"), F.col("act_id").alias("src"), "text")
    found = repeals.partial_targets(rows.select("par_id", "text"), as_of).join(rows.select("par_id", "src"), "par_id")
    acts = t["acts"]
    named = resolved(found.filter("number IS NOT NULL"), acts).filter("reject_reason IS NULL").select("par_id", "src", "article", "paragraph", F.col("dst_act").alias("act_id"))
    art = t["articles"].select(F.col("id").alias("article_id"), "act_id", ids.article_key(F.col("number")).alias("k"))
    by_edge = found.filter("number IS NULL").join(t["cites_article"].select("par_id", F.col("dst_article_id").alias("article_id")), "par_id").join(art, "article_id").filter(F.col("k") == ids.article_key(F.col("article"))).select("par_id", "src", "article", "paragraph", "act_id")
    years = acts.select("id", "year")
    all_ = named.unionByName(by_edge).distinct().join(years.select(F.col("id").alias("src"), F.col("year").alias("ys")), "src").join(years.select(F.col("id").alias("act_id"), F.col("year").alias("yd")), "act_id").filter("yd <= ys AND src <> act_id").withColumn("k", ids.article_key(F.col("article")))
    one = graph.unique(art, ["act_id", "k"], "article_id")
    hit = all_.join(one, ["act_id", "k"])
    articles = hit.filter("paragraph IS NULL").groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("repealed_by"))
    par = t["paragraphs"].select(F.col("id").alias("pid"), "article_id", ids.article_key(F.col("number")).alias("pk"))
    one_par = graph.unique(par, ["article_id", "pk"], "pid")
    pars = hit.filter("paragraph IS NOT NULL").withColumn("pk", ids.article_key(F.col("paragraph"))).join(one_par, ["article_id", "pk"]).groupBy(F.col("pid").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("repealed_by"))
    return articles, pars


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """`rows` with marks(id, repealed_by) written over whatever marks they had; unmarked rows are null."""
    out = rows.drop("repealed", "repealed_by").join(marks, "id", "left").withColumn("repealed", F.when(F.col("repealed_by").isNotNull(), F.lit(True)))
    return out.select(rows.columns)


def validity(t: dict[str, DataFrame], as_of: datetime.date) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables with edges and marks as of a day, one row of run state). Everything derived before is dropped, so a second run changes nothing."""
    edges, _ = repealing_edges(t["paragraphs"], t["acts"], as_of)
    edges = propagated(ratifications(t["acts"]), edges, t["acts"])
    articles, pars = partial_marks(t, as_of)
    acts = _marked(t["acts"], edges.groupBy(F.col("dst_act").alias("id")).agg(F.array_sort(F.collect_set("src_act")).alias("repealed_by")))
    acts = acts.withColumn("repealed", F.when(F.col("title").rlike(TITLE_REPEALED) | F.col("title").rlike(TITLE_LAPSED), F.lit(True)).otherwise(F.col("repealed"))).withColumn("lapsed", F.when(F.col("title").rlike(TITLE_LAPSED), F.lit(True)))
    out = t | {"acts": acts, "articles": _marked(t["articles"], articles), "paragraphs": _marked(t["paragraphs"], pars), "repeals": edges}
    wait = repeals.waiting(t["paragraphs"].select(F.col("id").alias("par_id"), "text"), as_of)
    state = wait.agg(F.lit(as_of).alias("as_of"), F.count("*").alias("waiting"), F.min("due").alias("next_due"))
    return out, state
