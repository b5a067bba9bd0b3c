import datetime
import time

import pytest
from pyspark.sql import functions as F

from actweave import schema
from actweave.operators import graph, jobs, validity
from actweave.sources import tables as store
from actweave.streaming import limits
from tests import hand

DAY = datetime.date(2026, 9, 1)


@pytest.fixture(scope="module")
def t(spark):
    return hand.tables(spark)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_repeals_are_found_and_found_again(t):
    once, state = validity.validity(t, DAY)
    assert [(r.src_act, r.dst_act) for r in once["repeals"].collect()] == [("L-158-2020", "L-9-1999")]
    assert [r.id for r in once["acts"].filter("repealed").collect()] == ["L-9-1999"] and state.first().waiting == 0
    twice, _ = validity.validity(once, DAY)
    for n in ("acts", "articles", "paragraphs", "repeals"):
        assert same(once[n], twice[n]), n


def test_rejects_have_reasons(spark, t):
    rows = [("p1", "L-158-2020", "È abrogata la Legge n.9/1999."), ("p2", "L-9-1999", "È abrogata la Legge n.158/2020."), ("p3", "L-9-1999", "È abrogata la Legge n.9/1999."), ("p4", "L-158-2020", "È abrogata la Legge n.8/1998."), ("p5", "L-158-2020", "È abrogato il Decreto Delegato n.9/1999."), ("p6", "L-158-2020", "È abrogata la Legge 2 giugno 1999 n.9.")]
    edges, rejects = validity.repealing_edges(spark.createDataFrame(rows, "id string, act_id string, text string"), t["acts"], DAY)
    assert {(r.par_id, r.reject_reason) for r in rejects.collect()} == {("p2", "later than the source"), ("p3", "itself"), ("p4", "absent"), ("p5", "type"), ("p6", "another date")}
    assert [r.par_id for r in edges.collect()] == ["p1"]


def test_partial_repeals(spark, t):
    rows = [("q1", "L-64-2025", "L'articolo 26 della Legge n.44/2015 è abrogato."), ("q2", "L-64-2025", "È abrogato il comma 2 dell'articolo 3 della Legge n.44/2015."), ("q3", "L-64-2025", "L'articolo 99 della Legge n.44/2015 è abrogato.")]
    extra = schema.conformed(spark.createDataFrame(rows, "id string, act_id string, text string"), "paragraphs")
    arts, pars = validity.partial_marks(t | {"paragraphs": t["paragraphs"].unionByName(extra)}, DAY)
    assert [(r.id, r.repealed_by) for r in arts.collect()] == [("L-44-2015/art-26", ["L-64-2025"])]
    assert [(r.id, r.repealed_by) for r in pars.collect()] == [("L-44-2015/art-3/c-2", ["L-64-2025"])]


def test_repeals_follow_ratifications(spark):
    acts = schema.conformed(spark.createDataFrame([(i, int(i[-4:])) for i in ("DD-1-2001", "L-2-2001", "L-3-2010", "L-4-1990")], "id string, year int"), "acts")
    pairs = spark.createDataFrame([("L-2-2001", "DD-1-2001")], "ratification string, decree string")
    edges = schema.conformed(spark.createDataFrame([("L-3-2010", "DD-1-2001"), ("L-4-1990", "L-2-2001"), ("L-2-2001", "DD-1-2001")], "src_act string, dst_act string"), "repeals")
    got = {(r.src_act, r.dst_act) for r in validity.propagated(pairs, edges, acts).filter("via_ratification").collect()}
    assert got == {("L-3-2010", "L-2-2001")}


def test_duplicates_and_swapped_texts(spark, t):
    assert [(r.id, r.kept) for r in jobs.duplicates(t).collect()] == [("D-66-1983~17012616", "D-66-1983")] and jobs.swapped_texts(t).count() == 0
    out = jobs.deduplicated(t)
    assert out["acts"].count() == t["acts"].count() - 1 and out["paragraphs"].count() == t["paragraphs"].count() - 1 and jobs.duplicates(out).count() == 0
    other = t["acts"].withColumn("title", F.when(F.col("id").contains("~"), "Regolamento sulla pesca nelle acque interne").when(F.col("id") == "D-66-1983", "Norme sulla circolazione dei veicoli").otherwise(F.col("title")))
    assert [r.id for r in jobs.swapped_texts(t | {"acts": other}).collect()] == ["D-66-1983~17012616"] and jobs.duplicates(t | {"acts": other}).count() == 0


def test_citations_are_completed_once(t):
    bare = t | {"cites": t["cites"].filter("src_kind = 'act'")}
    new = jobs.missing_citations(bare).cache()
    assert {(r.src_id, r.dst_act_id, r.cited_article) for r in new.collect()} >= {("L-64-2025/art-2/c-1", "L-44-2015", "3"), ("L-158-2020/art-4/c-2", "L-9-1999", None)}
    assert jobs.missing_citations(bare | {"cites": bare["cites"].unionByName(new)}).count() == 0


def test_tidying(spark, t):
    ghost = schema.conformed(spark.createDataFrame([("L-9-1999/art-1/c-1", "paragraph", "L-9-1999", "LC-44-2015", "Legge Costituzionale 31 marzo 2015 n.44"), ("L-9-1999/art-1/c-1", "paragraph", "L-9-1999", "L-9-1999", "Legge n.9/1999")], "src_id string, src_kind string, src_act_id string, dst_act_id string, cite_text string"), "cites")
    out = jobs.tidied(t | {"cites": t["cites"].unionByName(ghost)})
    moved = out["cites"].filter("resolved_from IS NOT NULL").collect()
    assert [(r.dst_act_id, r.resolved_from) for r in moved] == [("L-44-2015", "LC-44-2015")] and out["cites"].filter("src_act_id = dst_act_id").count() == 0
    assert "L-30-1977" in {r.id for r in out["acts"].collect()}
    lone = t | {"cites": t["cites"].filter("dst_act_id <> 'L-30-1977'")}
    assert "L-30-1977" not in {r.id for r in jobs.tidied(lone)["acts"].collect()}


def test_force_dates(spark, t):
    extra = schema.conformed(spark.createDataFrame([("f", "L-9-1999/art-1", "L-9-1999", "La presente legge entra in vigore il 15 marzo 1999.", 9), ("g", "L-64-2025/art-9", "L-64-2025", "La presente legge entra in vigore il 1° gennaio 2035.", 9)], "id string, article_id string, act_id string, text string, ord int"), "paragraphs")
    got = {r.id: r.force_date for r in jobs.force_dates(t | {"paragraphs": t["paragraphs"].unionByName(extra)}).filter("force_date IS NOT NULL").collect()}
    assert got == {"L-9-1999": datetime.date(1999, 3, 15)}


def test_overlay_keeps_the_original_once(spark, t):
    new = spark.createDataFrame([("L-44-2015/art-3", "1", "Testo nuovo del comma."), ("L-44-2015/art-3", "2", hand.TEXTS["L-44-2015", "3"][1])], "article_id string, number string, text string")
    pars, arts = jobs.overlaid(t["paragraphs"], t["articles"], new, "raccolta", "2026")
    a = arts.filter("id = 'L-44-2015/art-3'").first()
    assert a.original_text == " ".join(hand.TEXTS["L-44-2015", "3"]) and a.text_source == "raccolta"
    rows = {r.number: r for r in pars.filter("article_id = 'L-44-2015/art-3'").collect()}
    assert rows["1"].embedding is None and rows["2"].embedding is not None and pars.count() == t["paragraphs"].count()
    pars, arts = pars.cache(), arts.cache()
    again_p, again_a = jobs.overlaid(pars, arts, new, "raccolta", "2026")
    assert again_a.filter("id = 'L-44-2015/art-3'").first().original_text == a.original_text and again_p.count() == pars.count()


def test_lost_words(spark):
    before = spark.createDataFrame([("a", "uno due due tre"), ("b", "uno due tre quattro")], "act_id string, text string")
    after = spark.createDataFrame([("a", "uno due tre uno extra"), ("b", "altro")], "act_id string, text string")
    assert {r.act_id: (r.words, r.lost, r.ok) for r in jobs.lost_words(before, after).collect()} == {"a": (4, 1, True), "b": (4, 4, False)}


def test_twins(spark, t):
    tw = jobs.twin_pairs(t["acts"], validity.ratifications(t["acts"])).collect()
    assert [(r.kind, r.a, r.b) for r in tw] == [("coordina", "DD-7-2018", "L-44-2015")]
    new = jobs.twin_citations(t | {"twins": spark.createDataFrame(tw)}).collect()
    assert [(r.par_id, r.dst_article_id, r.origin, r.named_act, r.named_article) for r in new] == [("L-64-2025/art-2/c-1", "DD-7-2018/art-3", "coordinato", "L-44-2015", "3")]


def test_graph_helpers(spark, t):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src_id string, dst_id string")
    assert graph.without_nodes(edges, spark.createDataFrame([("a",)], "id string")).collect() == [("b", "c")] or graph.without_nodes(edges, spark.createDataFrame([("a",)], "id string")).count() == 1
    target = spark.createDataFrame([("x", 1, "old"), ("y", 2, None)], "id string, n int, s string")
    rows = spark.createDataFrame([("x", None, "new"), ("z", 3, "z")], "id string, n int, s string")
    assert sorted(map(tuple, graph.upserted(target, rows, "id").collect())) == [("x", 1, "new"), ("y", 2, None), ("z", 3, "z")]
    assert sorted(map(tuple, graph.upserted(target, rows, "id", keep=("s",)).collect()))[0] == ("x", 1, "old")


def test_metrics_and_runs(spark, t):
    m = {r.act_id: r for r in jobs.qa_metrics(t).collect()}
    assert m["L-44-2015"].long_paragraphs == 1 and m["L-44-2015"].highest == 26 and m["L-9-1999"].nearly_empty
    rows = spark.createDataFrame([("d", k, n) for k, n in enumerate([1, 2, 5, 3, 4, 6, 7, 2])], "k string, o int, n int")
    assert jobs.increasing_runs(rows, "k", "o", "n").first().longest == 4


def test_loading_parsed_documents(spark, tmp_path):
    import json

    cit = lambda **k: {"tipo": "Legge", "numero": 5, "anno": 2001, "articoloCitato": None, "commaCitato": None, "testo": "Legge n.5/2001", **k}
    doc = {"id": "L-1-2000", "tipo": "Legge", "numero": "1", "anno": 2000, "data": "2000-01-02", "titolo": "NÂ° 1", "preambolo": "Noi", "citazioniPreambolo": [cit()],
           "partizioni": [{"id": "T1", "tipo": "titolo", "numero": "I", "rubrica": "Uno", "ordine": 1, "figli": [{"id": "T1/C1", "tipo": "capo", "numero": "I", "rubrica": "Capo", "ordine": 1}]}],
           "articoli": [{"id": "L-1-2000/art-1", "numero": "1", "rubrica": "R", "partizioneId": "T1/C1", "ordine": 1, "commi": [{"id": "L-1-2000/art-1/c-1", "numero": "1", "testo": "x"}], "citazioni": [cit(commaId="L-1-2000/art-1/c-1", articoloCitato="1"), cit(anno=None), cit(numero=1, anno=2000, commaId="L-1-2000/art-1/c-1")]},
                        {"id": "L-1-2000/art-all-1", "numero": "all-1", "partizioneId": "T1", "ordine": 2, "allegato": "A", "commi": [{"id": "L-1-2000/art-all-1/c-1", "numero": "1", "testo": "y"}], "citazioni": []}]}
    bad = {**doc, "id": "L-9-2000", "articoli": [{"id": "L-9-2000/art-1", "numero": "1", "ordine": 1, "commi": [{"numero": "1", "testo": "senza id"}], "citazioni": []}]}
    for name, d in (("a", json.dumps(doc)), ("b", json.dumps(bad)), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(d)
    docs, broken = store.parsed(spark, str(tmp_path))
    assert broken.count() == 1 and {r.id: r.reject_reason for r in store.with_reasons(docs).collect()} == {"L-1-2000": None, "L-9-2000": "paragraph without id"}
    t = store.loaded(docs)
    acts = {r.id: r for r in t["acts"].collect()}
    assert set(acts) == {"L-1-2000", "L-5-2001"} and acts["L-1-2000"].title == "N° 1" and not acts["L-5-2001"].loaded
    arts = {r.number: (r.part_title, r.chapter) for r in t["articles"].collect()}
    assert arts == {"1": ("I", "I"), "all-1": (None, None)}
    assert sorted((r.src_kind, r.dst_act_id) for r in t["cites"].collect()) == [("act", "L-5-2001"), ("paragraph", "L-5-2001")]
    store.write(t, str(tmp_path / "out"))
    assert store.read(spark, str(tmp_path / "out"), "acts")["acts"].count() == 2


def test_rate_limits(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    rows = [("a", base + datetime.timedelta(minutes=10 * k), k) for k in range(12)] + [("b", base, 100)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    got = {r.id: r.accepted for r in limits.limited(df, limits.Limit(3, 3600)).collect()}
    assert [k for k in range(12) if got[k]] == [0, 1, 2, 6, 7, 8] and got[100]
    assert [r.id for r in limits.limited(df, limits.Limit(3, 3600, 7200)).filter("accepted").orderBy("id").collect()] == [0, 1, 2, 100]
    df.filter("id < 5 OR id = 100").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limits.Limit(3, 3600))
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:  # a query with timeouts never runs out of batches
        for _ in range(80):
            if spark.sql("SELECT * FROM limited").count() == 6:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert {r.id for r in spark.sql("SELECT * FROM limited WHERE accepted").collect()} == {0, 1, 2, 100}
