"""Paragraphs put in order after reading, and the tables brought to the new names.

A reader takes for paragraphs what is none: a heading without brackets, a page number alone on its line, a figure broken in two, the numbered text that an
amendment quotes, the entries of a list, and whatever follows the promulgation. `planned` says of each paragraph what it is and what it is called; `migrated`
applies that to a corpus. All rules look at an article's paragraphs in their order: windows by article, one shuffle in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from actweave import schema
from actweave.functions import citations
from actweave.operators import graph

# The phrases by which an amendment announces text, the promulgation, the annex at an end, forms of list entries and of numbers.
ANNOUNCES = r"(?iU)(?:\bseguent[ei]\b|\bcome\s+segue\b|\bche\s+segue\b|cos[iì]['’]?\s+(?:sostituit|modificat|riformulat|integrat|formulat)|sostituit[oa]\s+(?:dal|con)\b|\b(?:è|e['’]|sono|viene|vengono)\s+(?:aggiunt|inserit|introdott|premess)|seguente\s+tenore)"
SIGNED = r"(?iU)\bDat[oa]\s+dalla\s+Nostra\s+Residenza"
ANNEX_AT_END = r"(?U)\bAllegat[oi]\b[^.;:]{0,80}$|\bArticle\s+1\b"
COLON_AT_END = r"(?U):\s*\d{0,3}\s*$"
LIST_ENTRY = r"(?iU)^\s*(?:[a-z]\)|[a-z]\.\s|\d+\)|[-•])"
ORDINAL = r"(?i)^(\d+)\s*[-\s]?\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies)$"
OPENING, CLOSING, STRAIGHT = "“«―", "”»‖", '"'
HEADING_CHARS, QUOTED_ROWS = 120, 60
# What parts are called, and how their names are made.
QUOTED, ENTRY, ANNEX, REPEATED = "capoverso", "punto", "allegato", "ripetizione"

KEPT, ABSORBED, PAGE, HEADING = "kept", "absorbed", "page number", "heading"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def leading(number: Column) -> Column:
    """The integer that a number begins with, or null."""
    return F.regexp_extract(number, r"^(\d+)", 1).try_cast("long")


def marks(text: Column) -> Column:
    """The quotation marks of a text and nothing else; two apostrophes are a straight mark."""
    return F.regexp_replace(F.replace(text, F.lit("''"), F.lit(STRAIGHT)), f'[^{OPENING}{CLOSING}{STRAIGHT}]', "")


def depth(signs: Column, before: Column) -> Column:
    """How many quotations are open after these marks, if `before` were open ahead of them; a straight mark closes what is open, or opens."""

    def step(n: Column, c: Column) -> Column:
        closes = c.isin(*CLOSING) | ((c == STRAIGHT) & (n > 0))
        return F.when(c == "", n).when(closes, F.greatest(n - 1, F.lit(0))).otherwise(n + 1)

    return F.aggregate(F.split(signs, ""), before, step)


def _whole(*parts: str) -> WindowSpec:
    return Window.partitionBy("article_id", *parts)


def _places() -> WindowSpec:
    """A part of an article in its order."""
    return _whole("tail").orderBy("pos")


def _before() -> WindowSpec:
    return _places().rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return _places().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _joined(rows: DataFrame) -> DataFrame:
    """Fragments numbered 0 go back to the end of the paragraph before them."""
    own = F.col("implicit") | (F.trim("number") != "0") | (F.row_number().over(_whole().orderBy("ord", "id")) == 1)
    rows = rows.withColumn("_own", own).withColumn("_g", F.sum(F.col("_own").cast("int")).over(_whole().orderBy("ord", "id")))
    fragments = F.collect_list(F.when(~F.col("_own"), F.struct("id", "text"))).over(Window.partitionBy("article_id", "_g").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_f", fragments)
    text = F.when(F.size("_f") == 0, F.col("text")).otherwise(F.aggregate("_f", F.col("text"), lambda t, x: stripped(F.concat(t, F.lit(" "), x["text"]))))
    return rows.withColumn("text", F.when(F.col("_own"), text).otherwise(F.col("text"))).withColumn("absorbed", F.transform("_f", lambda x: x["id"])).withColumn("what", F.when(F.col("_own"), KEPT).otherwise(ABSORBED))


def _sifted(rows: DataFrame) -> DataFrame:
    """Page numbers alone in their paragraph go, unless an article has nothing else; a heading taken for the first paragraph is marked as one."""
    kept = F.col("what") == KEPT
    bare = kept & stripped(F.col("text")).rlike(r"^\d{1,4}$")
    count = lambda c: F.sum(c.cast("int")).over(_whole())
    rows = rows.withColumn("what", F.when(bare & (count(kept & ~bare) > 0), PAGE).otherwise(F.col("what")))
    live = Window.partitionBy("article_id", "_live").orderBy("ord", "id")
    rows = rows.withColumn("_live", F.col("what") == KEPT)
    after = lambda c: F.lead(c).over(live)
    t = stripped(F.col("text"))
    title = F.col("implicit") & ~after("implicit") & (after("number") == "1") & (F.length(t) <= HEADING_CHARS) & t.rlike("[A-Za-zÀ-ÿ]{3}") & ~t.rlike(r"[.;:,]\s*$")
    title = title & ~t.rlike(ANNOUNCES) & (depth(marks(t), F.lit(0)) == 0) & ~t.rlike(LIST_ENTRY)
    first = F.col("_live") & (F.row_number().over(live) == 1) & (stripped(F.coalesce("_rubric", F.lit(""))) == "")
    return rows.withColumn("what", F.when(first & F.coalesce(title, F.lit(False)), HEADING).otherwise(F.col("what")))


def _annexed(rows: DataFrame) -> DataFrame:
    """pos, and whether a paragraph stands behind the promulgation or the line that opens an annex."""
    live = Window.partitionBy("article_id", "what").orderBy("ord", "id")
    again = ~F.lead("implicit").over(live) & (F.trim(F.lead("number").over(live)) == "1")
    last = F.lead("id").over(live).isNull()
    opens = (F.col("what") == KEPT) & ~last & (F.col("text").rlike(SIGNED) | (F.col("text").rlike(ANNEX_AT_END) & F.coalesce(again, F.lit(False))))
    rows = rows.withColumn("pos", F.row_number().over(live)).withColumn("_opens", opens)
    start = F.min(F.when(F.col("_opens"), F.col("pos"))).over(_whole())
    return rows.withColumn("tail", F.when(F.col("what") != KEPT, F.col("what")).when(F.col("pos") > start, ANNEX).otherwise(KEPT))


def _quoted(rows: DataFrame) -> DataFrame:
    """`block`: the place of the paragraph that introduces the quotation a paragraph belongs to.

    A quotation starts behind a paragraph that leaves marks open, announces text or begins with a mark, and is followed by a number not above its own. It
    ends where the running balance of marks is back at zero; where it never is, with the sequence of numbers that follows, if that
    leads up to the introducing paragraph's next number or to the end.
    """
    text, n = F.col("text"), F.col("n")
    rows = rows.withColumn("n", leading(F.col("number"))).withColumn("_m", marks(text))
    plain = F.coalesce(~F.col("implicit") & (F.trim("number") == n.cast("string")), F.lit(False))
    rows = rows.withColumn("plain", plain).withColumn("open", depth(F.col("_m"), F.lit(0)))
    lag, lead = (lambda c: F.lag(c).over(_places())), (lambda c: F.lead(c).over(_places()))
    inserted = F.regexp_extract(F.trim("number"), ORDINAL, 1).try_cast("long")
    goes_on = ~F.col("implicit") & ((F.col("plain") & (n == lag("n") + 1)) | (inserted == lag("n")))
    rows = rows.withColumn("_break", ~F.coalesce(goes_on, F.lit(False))).withColumn("_next", lead("n")).withColumn("_next_plain", lead("plain"))
    begins = F.left(F.ltrim(text), F.lit(1)).isin(*OPENING, STRAIGHT) | F.startswith(F.ltrim(text), F.lit("''"))
    rows = rows.withColumn("_starts", F.coalesce((F.col("open") > 0) & (text.rlike(ANNOUNCES) | begins) & (F.col("_next") <= n), F.lit(False)))
    ahead = F.collect_list("_m").over(_places().rowsBetween(1, QUOTED_ROWS))
    none = F.struct(F.lit(0).alias("k"), F.col("open").alias("d"), F.lit(None).cast("int").alias("at"))

    def closing(a: Column, m: Column) -> Column:
        d = depth(m, a["d"])
        return F.struct((a["k"] + 1).alias("k"), d.alias("d"), F.coalesce(a["at"], F.when(d == 0, a["k"] + 1)).alias("at"))

    by_marks = F.col("pos") + F.aggregate("_ahead", none, closing, lambda a: a["at"])
    later = Window.partitionBy("article_id", "tail").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -2)
    rows = rows.withColumn("_ahead", F.when(F.col("_starts"), ahead)).withColumn("_stop", F.min(F.when(F.col("_break"), F.struct("pos", "n"))).over(later)).withColumn("_last", F.max("pos").over(_whole("tail")))
    by_numbers = F.when(F.col("_next_plain") & (F.col("_stop").isNull() | (F.col("_stop.n") == n + 1)), F.coalesce(F.col("_stop.pos") - 1, F.col("_last")))
    end = F.when(F.col("_starts"), F.coalesce(by_marks, by_numbers))
    rows = rows.withColumn("_end", end)
    spans = F.array_sort(F.collect_list(F.when(F.col("_end").isNotNull(), F.struct(F.col("pos").alias("s"), F.col("_end").alias("e")))).over(_whole("tail")))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    apart = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("e"), empty.alias("x")),
        lambda a, x: F.when(x["s"] > a["e"], F.struct(x["e"].cast("int").alias("e"), F.concat(a["x"], F.array(F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e")))).alias("x"))).otherwise(a),
        lambda a: a["x"],
    )
    rows = rows.withColumn("_spans", spans).withColumn("_spans", F.when(F.size("_spans") > 0, apart).otherwise(empty))
    block = F.try_element_at(F.filter("_spans", lambda x: (x["s"] < F.col("pos")) & (F.col("pos") <= x["e"])), F.lit(1))["s"]
    used = F.col("block").isNotNull() | F.exists("_spans", lambda x: x["s"] == F.col("pos"))
    return rows.withColumn("block", block).withColumn("used", used).drop("_m", "_ahead", "_stop", "_last", "_break", "_next_plain", "_starts", "_end", "_spans", "open")


def _listed(rows: DataFrame, colon_at_end: str) -> DataFrame:
    """`entry`: the place of the paragraph whose list a paragraph is an entry of.

    A list starts with number 1 behind a colon and goes on by ones. An entry that ends in a colon opens a further list of the same paragraph. An entry
    that ends in a full stop is the last one, if the paragraph's own next number comes after it.
    """
    lag = lambda c: F.lag(c).over(_places())
    free = F.col("plain") & ~F.col("used")
    colon = F.col("text").rlike(colon_at_end) & ~F.col("used")
    rows = rows.withColumn("_free", free).withColumn("_colon", colon).withColumn("_stop", F.rtrim("text").endswith("."))
    rows = rows.withColumn("_first", F.coalesce(F.col("_free") & (F.col("n") == 1) & lag("_colon"), F.lit(False)))
    rows = rows.withColumn("_link", F.coalesce(F.col("_free") & lag("_free") & (F.col("n") > 1) & (F.col("n") == lag("n") + 1), F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.col("_link")).cast("int")).over(_so_far()))
    rows = rows.withColumn("_maybe", F.first("_first").over(Window.partitionBy("article_id", "tail", "_run").orderBy("pos")))
    rows = rows.withColumn("_chain", F.sum((~F.col("_maybe")).cast("int")).over(_so_far()))
    so_far = F.collect_list(F.struct("pos", "n", "_maybe", "_first", "_stop", "_next")).over(Window.partitionBy("article_id", "tail", "_chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    unknown = F.lit(None).cast("int"), F.lit(None).cast("long")
    start = F.struct(unknown[0].alias("root"), unknown[1].alias("own"), F.lit(False).alias("on"), F.lit(False).alias("done"), unknown[0].alias("pos"), unknown[1].alias("n"))

    def step(a: Column, x: Column) -> Column:
        anew = x["_first"] & ~a["on"]
        root, own = F.when(anew, a["pos"]).otherwise(a["root"]), F.when(anew, a["n"]).otherwise(a["own"])
        on = x["_maybe"] & F.when(x["_first"], own.isNotNull()).otherwise(a["on"] & ~a["done"])
        done = F.coalesce(on & x["_stop"] & (x["_next"] == own + 1), F.lit(False))
        return F.struct(root.alias("root"), own.alias("own"), on.alias("on"), done.alias("done"), x["pos"].alias("pos"), x["n"].alias("n"))

    state = F.when(F.col("_maybe"), F.aggregate(F.when(F.col("_maybe"), F.col("_so_far")), start, step))
    rows = rows.withColumn("_so_far", so_far).withColumn("_state", state)
    return rows.withColumn("entry", F.when(F.col("_state.on"), F.col("_state.root"))).drop("_free", "_colon", "_stop", "_first", "_link", "_run", "_maybe", "_chain", "_so_far", "_state", "_next")


def _named(rows: DataFrame) -> DataFrame:
    """Numbers, kinds of parts and ids."""
    body = F.col("tail") == KEPT
    rows = rows.withColumns({c: F.when(body, F.col(c)) for c in ("block", "entry")})
    own = body & F.coalesce("block", "entry").isNull()
    rows = rows.withColumn("_own", own).withColumn("_said", F.when(own & F.col("implicit"), F.sum(own.cast("int")).over(_so_far()).cast("string")).otherwise(F.col("number")))
    before = F.last(F.when(F.col("_own"), F.col("_said")), ignorenulls=True).over(_before())
    whole = lambda c: F.trim(c).try_cast("long")
    odd = F.coalesce(~F.col("implicit") & ~(whole(F.col("_said")) > whole(before)), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("article_id", "tail", "_own", "_said").orderBy("pos"))
    rows = rows.withColumn("_nth", nth).withColumn("_odd", odd).withColumn("_name", F.when(F.col("_nth") > 1, F.concat("_said", F.lit(".rip"), "_nth")).otherwise(F.col("_said")))
    holder = F.last(F.when(F.col("_own"), F.col("_name")), ignorenulls=True).over(_before())
    kind = F.when(F.col("tail") == ANNEX, ANNEX).when(F.col("block").isNotNull(), QUOTED).when(F.col("entry").isNotNull(), ENTRY).when(F.col("_nth") > 1, REPEATED)
    rows = rows.withColumn("_holder", holder).withColumn("new_part", kind)
    k = F.row_number().over(Window.partitionBy("article_id", "tail", F.coalesce("block", "entry"), "new_part").orderBy("pos")).cast("string")
    rows = rows.withColumn("_k", F.when(F.col("new_part").isin(QUOTED, ENTRY, ANNEX), k))
    sign = F.when(F.col("new_part") == QUOTED, "cap").otherwise("p")
    inside = F.col("new_part").isin(QUOTED, ENTRY)
    number = F.when(F.col("new_part") == ANNEX, F.concat(F.lit("all"), "_k")).when(inside, F.concat("_holder", F.lit("."), sign, "_k")).otherwise(F.col("_name"))
    rows = rows.withColumn("new_number", number)
    base = F.concat("article_id", F.lit("/c-"), F.when(inside, F.concat("_holder", F.lit("-"), sign, "_k")).otherwise(F.replace("new_number", F.lit("."), F.lit("-"))))
    rows = rows.withColumn("_base", base)
    again = F.row_number().over(Window.partitionBy("article_id", "what", "_base").orderBy("pos"))
    rows = rows.withColumn("_again", again)
    # what stands for itself, for the first time, keeps its flags and has no other number
    plain = F.col("_own") & F.col("new_part").isNull()
    return rows.select(
        "article_id",
        "act_id",
        "id",
        "what",
        F.when(F.col("what") == KEPT, F.when(F.col("_again") > 1, F.concat("_base", F.lit("-"), F.col("_again").cast("string"))).otherwise(F.col("_base"))).alias("new_id"),
        F.when(F.col("what") == KEPT, F.col("new_number")).alias("number"),
        F.when(F.col("what") == KEPT, F.col("new_part")).alias("part"),
        F.when((F.col("what") == KEPT) & ~plain, F.when(F.col("new_part") == REPEATED, F.col("_said")).otherwise(F.col("number"))).alias("number_original"),
        (plain & F.col("implicit")).alias("implicit"),
        F.when(F.col("what") == KEPT, F.when(F.col("_own"), F.col("_odd") | (F.col("_nth") > 1)).otherwise(F.lit(False))).otherwise(F.lit(False)).alias("anomalous"),
        "text",
        "absorbed",
        (F.row_number().over(Window.partitionBy("article_id", "what").orderBy("pos")) - 1).alias("ord"),
    )


def planned(paragraphs: DataFrame, articles: DataFrame, colon_at_end: str = COLON_AT_END) -> DataFrame:
    """(article_id, act_id, id, what, new_id, number, part, number_original, implicit, anomalous, text, absorbed, ord): what becomes of each paragraph.

    what: `kept`, `absorbed` (a fragment that went to the end of the paragraph which lists it in `absorbed`), `page number` or `heading`; only kept rows
    have a new id. part: `capoverso` for quoted text (number "1.cap2"), `punto` for entries of a list ("1.p2"), `allegato` behind the
    promulgation ("all3"), `ripetizione` for a number that came before ("1.rip2"); number_original is what such a paragraph was called in
    the text. Applied to its own outcome it changes nothing. Paragraphs need id and article_id; a null number or text is empty. Articles are (id, rubric).
    `colon_at_end` tells the texts behind which a list can start; by default a page number may stand behind the colon.
    """
    rubric = articles.select(F.col("id").alias("article_id"), F.col("rubric").alias("_rubric"))
    number = F.when(F.col("part").isNotNull(), F.coalesce("number_original", "number")).otherwise(F.col("number"))
    rows = paragraphs.select("article_id", "act_id", "id", "ord", F.coalesce(number, F.lit("")).alias("number"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("implicit", F.lit(False)).alias("implicit"))
    rows = rows.join(rubric, "article_id", "left")
    return _named(_listed(_quoted(_annexed(_sifted(_joined(rows)))), colon_at_end))


def renumbered(paragraphs: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, articles) in order: new numbers, ids and parts, and the rubrics that had been taken for paragraphs."""
    plan = graph.written(planned(paragraphs, articles))
    return _applied(plan, paragraphs), _with_rubrics(plan, articles)


def _applied(plan: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraphs under their new names; what a paragraph has beside its text stays with it, a vector only if the text is the same."""
    new = plan.filter(F.col("what") == KEPT).drop("what", "absorbed", "act_id").withColumnRenamed("text", "_text")
    rest = [c for c in paragraphs.columns if c not in new.columns or c in ("id", "article_id")]
    kept = paragraphs.select(*rest).join(new, ["article_id", "id"]).withColumn("id", F.col("new_id"))
    if "embedding" in paragraphs.columns:
        kept = kept.withColumn("embedding", F.when(F.col("text") == F.col("_text"), F.col("embedding"))) if "text" in kept.columns else kept
    return schema.conformed(kept.withColumn("text", F.col("_text")), "paragraphs")


def _with_rubrics(plan: DataFrame, articles: DataFrame) -> DataFrame:
    found = plan.filter(F.col("what") == HEADING).select(F.col("article_id").alias("id"), stripped(F.col("text")).alias("_r"))
    out = articles.join(found, "id", "left")
    if "rubric_embedding" in articles.columns:
        out = out.withColumn("rubric_embedding", F.when(F.col("_r").isNull(), F.col("rubric_embedding")))
    return out.withColumn("rubric", F.coalesce("_r", "rubric")).select(articles.columns)


def changes(plan: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(article_id, rebuild): the articles whose paragraphs the plan changes; `rebuild` where ids stood twice, so that edges cannot say whose they are."""
    old = paragraphs.select("article_id", "id", F.col("number").alias("n0"), F.col("part").alias("p0"), F.col("number_original").alias("o0"), F.coalesce("implicit", F.lit(False)).alias("i0"), F.coalesce("anomalous", F.lit(False)).alias("a0"), F.coalesce("text", F.lit("")).alias("t0"))
    both = old.join(plan, ["article_id", "id"])
    same = (F.col("what") == KEPT) & (F.col("new_id") == F.col("id"))
    for a, b in (("n0", "number"), ("p0", "part"), ("o0", "number_original"), ("i0", "implicit"), ("a0", "anomalous"), ("t0", "text")):
        same = same & F.col(a).eqNullSafe(F.col(b))
    doubled = old.groupBy("article_id", "id").count().groupBy("article_id").agg((F.max("count") > 1).alias("rebuild"))
    return both.groupBy("article_id").agg(F.max(~same).alias("_changed")).join(doubled, "article_id").filter("_changed OR rebuild").select("article_id", "rebuild")


def out_of_step(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """(article_id): articles whose stored paragraphs are not, in this order and with these texts, those that were parsed."""
    one = lambda rows: rows.select("article_id", F.struct("ord", "id", F.md5(F.coalesce("text", F.lit(""))).alias("t")).alias("x")).groupBy("article_id")
    shape = lambda rows: one(rows).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("|", x["id"], x["t"])), "\n")).alias("h"))
    a, b = shape(parsed).alias("a"), shape(stored).alias("b")
    return a.join(b, "article_id", "left").filter(~F.col("a.h").eqNullSafe(F.col("b.h"))).select("article_id")


def migrated(t: dict[str, DataFrame], parsed: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counters): the corpus with all paragraphs in order, and how often each rule applied, as (what, n).

    Articles of acts that are not loaded, those whose text comes from elsewhere (`text_source`) and those whose stored paragraphs differ from
    `parsed` are left as they are. Old names meet new ones in one table, by which every edge is renamed at once: no name is given to two
    rows in between. Edges of what goes are dropped; a paragraph that took in fragments loses its citations and its vector, and gets those that its whole
    text states. Articles in which an id stands twice lose their paragraphs' edges and get those that their texts state.
    """
    paragraphs, articles = t["paragraphs"], t["articles"]
    loaded = t["acts"].filter("loaded").select(F.col("id").alias("act_id"))
    may = articles.filter("text_source IS NULL").join(loaded, "act_id", "left_semi").select(F.col("id").alias("article_id"))
    astray = graph.written(out_of_step(parsed if parsed is not None else paragraphs, paragraphs))
    # two rows with one id are told apart by their place
    own = paragraphs.join(may, "article_id", "left_semi").join(astray, "article_id", "left_anti")
    numbered = own.withColumn("_old", F.col("id")).withColumn("_twin", F.row_number().over(Window.partitionBy("article_id", "id").orderBy("ord", "text")))
    numbered = numbered.withColumn("id", F.when(F.col("_twin") > 1, F.concat("id", F.lit("\x00"), F.col("_twin").cast("string"))).otherwise(F.col("id")))
    plan = graph.written(planned(numbered, articles))
    touched = changes(plan, numbered).select("article_id").unionByName(numbered.filter("_twin > 1").select("article_id")).distinct()
    rebuild = graph.written(numbered.filter("_twin > 1").select("article_id").distinct())
    plan = graph.written(plan.join(touched, "article_id", "left_semi"))
    moved = numbered.drop("_old", "_twin").join(touched, "article_id", "left_semi")
    rest = paragraphs.join(touched, "article_id", "left_anti")
    out = dict(t)
    out["paragraphs"] = rest.select(paragraphs.columns).unionByName(_applied(plan, moved).select(paragraphs.columns))
    out["articles"] = _with_rubrics(plan, articles)

    again = plan.filter(F.size("absorbed") > 0).select("id").unionByName(plan.join(rebuild, "article_id", "left_semi").select("id")).distinct()
    names = graph.written(plan.select(F.regexp_replace("id", "\x00.*", "").alias("old"), "new_id", "id").join(again.withColumn("_again", F.lit(True)), "id", "left").select("old", "new_id", F.coalesce("_again", F.lit(False)).alias("again")).groupBy("old").agg(F.min("new_id").alias("new_id"), F.bool_or("again").alias("again")))

    def renamed(table: str, key: str, stale: bool) -> DataFrame:
        """Edges under new names; those of what is gone are dropped, and where texts changed (`stale`) those read from them."""
        rows = t[table].join(names, F.col(key) == F.col("old"), "left")
        stays = F.col("old").isNull() | (F.col("new_id").isNotNull() & ~(F.col("again") if stale else F.lit(False)))
        return rows.filter(stays).withColumn(key, F.coalesce("new_id", key)).select(t[table].columns)

    source = plan.filter(F.col("what") == KEPT).join(again, "id", "left_semi").select(F.col("new_id").alias("src_id"), "text", F.col("act_id").alias("src_act_id"))
    found = citations.extracted(source, "text", "src_id", act="src_act_id").filter("target IS NOT NULL").join(source.select("src_id", "src_act_id"), "src_id")
    found = schema.conformed(found.select("src_id", F.lit("paragraph").alias("src_kind"), "src_act_id", F.col("target").alias("dst_act_id"), "cite_text", "cited_article", "cited_par"), "cites")
    found = graph.latest(found, schema.KEYS["cites"], [F.asc("cite_text"), F.asc_nulls_last("cited_par")]).select(t["cites"].columns)
    out["cites"] = renamed("cites", "src_id", True).unionByName(found)
    out["cites_article"] = renamed("cites_article", "par_id", True)
    out["chunks"] = renamed("chunks", "paragraph_id", True)
    repeals = t["repeals"].join(names.select("old", "new_id"), F.col("par_id") == F.col("old"), "left")
    out["repeals"] = repeals.withColumn("par_id", F.when(F.col("old").isNull(), F.col("par_id")).otherwise(F.col("new_id"))).select(t["repeals"].columns)
    return out, counted(plan).unionByName(astray.agg(F.lit("articles out of step").alias("what"), F.count("*").alias("n"))).unionByName(rebuild.agg(F.lit("articles rebuilt").alias("what"), F.count("*").alias("n")))


def counted(plan: DataFrame) -> DataFrame:
    """(what, n): how many paragraphs and articles each rule changed, in one pass."""
    kept = F.col("what") == KEPT
    per = plan.groupBy("article_id").agg(
        *[F.count_if(F.col("what") == w).alias(w) for w in (HEADING, PAGE, ABSORBED)],
        *[F.count_if(F.col("part") == p).alias(p) for p in (QUOTED, ENTRY, ANNEX, REPEATED)],
        F.count_if(kept & (F.col("new_id") != F.col("id"))).alias("renamed"),
        (F.count_if(kept) - F.count_distinct(F.when(kept, F.col("number"))) > 0).cast("int").alias("doubled"),
    )
    pairs = [("articles", F.count("*")), ("headings", F.sum(HEADING)), ("page numbers", F.sum(F.col(f"`{PAGE}`"))), ("fragments", F.sum(ABSORBED))]
    for p in (QUOTED, ENTRY, ANNEX, REPEATED):
        pairs += [(f"{p}: articles", F.count_if(F.col(p) > 0)), (f"{p}: paragraphs", F.sum(p))]
    pairs += [("renamed", F.sum("renamed")), ("articles with a number twice", F.sum("doubled"))]
    one = per.agg(F.array(*[F.struct(F.lit(k).alias("what"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for k, c in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")
