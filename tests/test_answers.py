from pyspark.sql import functions as F

from actweave.operators import answers
from actweave.sources import spans
from tests import hand


def test_markers_and_anchors(spark):
    t = hand.tables(spark)
    df = spark.createDataFrame([(1, "Vedi [L-44-2015 art.3 c.1], [L-44-2015 art.3 c.9], [L-44-2015 art.77], [L-9-1990] e la Legge n.64/2025.")], "answer_id int, text string")
    got = answers.anchored(answers.markers(df), t["paragraphs"], t["articles"], t["acts"]).orderBy("ord").collect()
    assert [(r.anchor, r.level) for r in got] == [("L-44-2015/art-3/c-1", "paragraph"), ("L-44-2015/art-3", "article"), ("L-44-2015", "act")]
    seen = spark.createDataFrame([(1, "L-44-2015", "3"), (1, "L-64-2025", "2")], "answer_id int, act_id string, article string")
    assert {(r.act_id, r.article) for r in answers.unverified(df, seen).collect()} == {("L-44-2015", "77"), ("L-9-1990", None)}


def test_expected_citations(spark):
    said = [("la Legge n.44/2015", True), ("Legge 31 marzo 2015 n. 44", True), ("44 / 2015", True), ("[L-44-2015]", True), ("n.144/2015", False), ("44/20155", False), ("2015, n.440", False), (None, None)]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(said)], "k int, t string").select("k", answers.cites_expected(F.col("t"), F.lit("L-44-2015")).alias("y"))
    assert [r.y for r in df.orderBy("k").collect()] == [w for _, w in said]


def test_sources_and_accuracy(spark):
    rows = spark.createDataFrame([(1, "A", "1", None, 5), (1, "B", None, None, 2), (1, "A", "1", None, 1)], "answer_id int, act_id string, article string, par string, seen int")
    assert [(r.n, r.act_id) for r in answers.sources_of(rows).orderBy("n").collect()] == [(1, "A"), (2, "B")]
    out = spark.createDataFrame([("x", True, False, s, 0.5) for s in (1.0, 9.0, 2.0, 3.0)], "category string, correct boolean, source_ok boolean, seconds double, cost double")
    r = answers.accuracy(out).first()
    assert (r.n, r.correct, r.source_ok, r.median_seconds, r.max_seconds, r.mean_cost) == (4, 4, 0, 3.0, 9.0, 0.5)


def test_visual_rows(spark):
    rows = [("d", 1, 10.0, 5.0, 20.0, 12.0, "Art. 1"), ("d", 1, 30.5, 40.0, 10.0, 12.0, "destra"), ("d", 1, 30.0, 5.0, 20.0, 12.0, "sinistra"), ("d", 1, 90.0, 5.0, 9.0, 8.0, "(1) nota"), ("d", 2, 10.0, 5.0, 9.0, 12.0, "Art. 2-bis"), ("d", 3, 10.0, 5.0, 9.0, 12.0, "Art. 1")]
    df = spark.createDataFrame(rows, "doc string, page int, y double, x double, width double, size double, text string")
    got = spans.rows(df).orderBy("line_no").collect()
    assert [(r.page, r.text, r.is_note) for r in got] == [(1, "Art. 1", False), (1, "sinistra destra", False), (1, "(1) nota", True), (2, "Art. 2-bis", False), (3, "Art. 1", False)]
    assert sorted((r.number, r.page) for r in spans.article_pages(spans.rows(df)).collect()) == [("1", 1), ("2 bis", 2)]
