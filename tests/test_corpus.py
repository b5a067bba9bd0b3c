import pytest

from actweave.plans.corpus import Corpus
from tests import hand


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, hand.tables(spark))


def test_lexical_search_merges_and_annotates(corpus):
    rows = corpus.search("mutuo soggetti residenti trentacinque anni").orderBy("rank").collect()
    assert rows[0].act_id == "DD-7-2018" and rows[0].also_in == ["L-44-2015"] and rows[0].article == "3"
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    # the consolidated text is told of the act that rewrote its base
    assert [(x.act, x.rewrites) for x in rows[0].cited_later] == [("L-64-2025", True)]
    assert [(x.act, list(x.articles), x.touches_this) for x in rows[0].act_rewritten_by] == [("L-64-2025", ["3"], True)]


def test_near_editions_and_newer_rubrics(corpus):
    rows = corpus.search("imposta prima casa ridotta residenza", currency=True).collect()
    first = [r for r in rows if r.rank == 1][0]
    assert first.act_id == "DD-52-2026" or first.newer.act == "DD-52-2026"


def test_filters(corpus):
    acts = lambda **k: {r.act_id for r in corpus.search("imposta prima casa orario lavoro mutuo", currency=False, **k).collect()}
    assert acts(prefixes=["DD"]) <= {"DD-52-2026", "DD-7-2018"} and acts(year_from=2020, year_to=2020) == {"L-158-2020"}
    assert "L-9-1999" in acts() and "L-9-1999" not in acts(exclude_repealed=True)
    with pytest.raises(ValueError, match="unknown types"):
        corpus.search("x", prefixes=["ZZ"])


def test_chunks_are_shown_as_their_paragraph(corpus):
    r = [x for x in corpus.search("disposizione molto lunga continua", currency=False).collect() if x.par_id == "L-44-2015/art-26/c-2"][0]
    assert r.length == len(hand.LONG) and r.truncated in (True, False) and len(r.text) <= 2000 + len(" [...]")


def test_semantic_and_hybrid(spark, corpus):
    text = hand.TEXTS["L-9-1999", "1"][0]
    q = spark.createDataFrame([(5, "quaranta ore", [float(text.count(c)) for c in "aeioulmnrst"]), (6, "edilizia commissione", None)], "query_id int, text string, vector array<float>")
    rows = corpus.search(q, mode="hybrid", currency=False).filter("rank = 1").collect()
    assert {r.query_id: r.act_id for r in rows} == {5: "L-9-1999", 6: "L-44-2015"}
    assert corpus.search(q, mode="semantic", currency=False).filter("query_id = 5 AND rank = 1").first().par_id == "L-9-1999/art-1/c-1"


def test_reading(corpus):
    rows = corpus.article("L-44-2015", "26").collect()
    assert [r.number for r in rows] == ["1", "2"] and not rows[0].truncated and rows[1].length == len(hand.LONG)
    part = corpus.article("L-44-2015", "26", par="2", start=6000).first()
    assert part.text == hand.LONG[6000:16000] and not part.truncated
    with pytest.raises(LookupError, match="there are"):
        corpus.article("L-44-2015", "99")
    with pytest.raises(LookupError, match="not loaded"):
        corpus.article("L-30-1977", "1")
    one = corpus.article_currency("L-44-2015", "3").first()
    assert [x.act for x in one.cited_later] == ["L-64-2025"] and one.newer_versions[0].act == "DD-7-2018"


def test_outline_and_urls(corpus):
    assert [(r.number, r.n_paragraphs) for r in corpus.outline("L-44-2015").collect()] == [("3", 2), ("26", 2)]
    assert corpus.document_url("L-44-2015", "26") == "u/own" and corpus.document_url("L-44-2015", "3") == "u/44" and corpus.document_url("L-9-1999") is None


def test_finding(corpus):
    assert [(r.id, r.match) for r in corpus.find_act(number=44, year=2015).collect()] == [("L-44-2015", "exact")]
    assert [(r.id, r.match) for r in corpus.find_act(number=44, year=2011).collect()] == [("L-44-2015", "nearest")]
    assert corpus.find_act(title="ediliz sovvenzionata").first().id == "L-44-2015"
    assert {r.id for r in corpus.find_act(number=66).collect()} == {"D-66-1983", "D-66-1983~17012616"}


def test_catalogue(corpus):
    got = {r.prefix: (r.total, r.loaded, r.stubs) for r in corpus.catalogue().collect()}
    assert got == {"L": (5, 4, 1), "DD": (2, 2, 0), "D": (2, 2, 0)}
    assert [r.id for r in corpus.acts_of(prefix="L", limit=2).collect()] == ["L-64-2025", "L-158-2020"] and [r.id for r in corpus.acts_of(repealed=True).collect()] == ["L-9-1999"]
    s = corpus.status().first()
    assert (s.acts, s.stubs, s.articles, s.cites) == (8, 1, 10, 4)


def test_citations(corpus):
    out = corpus.outgoing("L-64-2025").collect()
    assert [(r.dst_act_id, r.times, r.points) for r in out] == [("L-44-2015", 2, ["art.26", "art.3 c.1"])]
    assert [(r.dst_act_id, r.basis) for r in corpus.outgoing("L-44-2015").collect()] == [("L-30-1977", True)]
    assert [(r.src_act_id, r.times, r.articles) for r in corpus.incoming("DD-7-2018").collect()] == [("L-64-2025", 2, ["2", "9"])]
    assert corpus.incoming("L-44-2015", year_from=2026).count() == 0
    assert [(r.target, r.citations) for r in corpus.worklist().collect()] == [("L-30-1977", 1)]
    assert corpus.most_cited(1).first().id == "L-44-2015"


def test_integrity(corpus):
    assert corpus.violations().count() == 0
