import math
import random
import re

import pytest

from actweave.operators import lexicon
from actweave.plans.corpus import Corpus
from tests.hand import tables

FOLD = str.maketrans(lexicon.ACCENTS, lexicon.PLAIN)


def stems(text):
    out = []
    for t in re.findall(r"[^\W_]+", text.lower()):
        if t in lexicon.ELIDED or t in lexicon.EMPTY:
            continue
        if len(t) >= 6:
            t = t.translate(FOLD)
            cut = 2 if (t[-1] in "ei" and t[-2] in "hi") or (t[-1] in "ao" and t[-2] == "i") else 1 if t[-1] in "aeio" else 0
            t = t[: len(t) - cut]
        out.append(t)
    return out


def plain_bm25(docs, queries, k, allowed=None):
    words = {d: stems(t or "") for d, t in docs.items()}
    words = {d: w for d, w in words.items() if w}
    n, average = len(words), sum(map(len, words.values())) / max(len(words), 1)
    out = []
    for q, text in queries.items():
        score = {}
        for term in set(stems(text)):
            df = sum(term in w for w in words.values())
            for d, w in words.items():
                if term in w and (allowed is None or d in allowed):
                    tf = w.count(term)
                    score[d] = score.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        ranked = sorted(score, key=lambda d: (-round(score[d], 6), d))[:k]
        out += [(q, d, round(score[d], 6), r) for r, d in enumerate(ranked, 1)]
    return sorted(out)


WORDS = "mutuo mutui abitazione abitazioni l'imposta imposte richiedente richiedenti commissione commissioni è della età città necessaria necessario articolo articoli banche banca 44 2015 dell'articolo perché".split()


@pytest.fixture(scope="module")
def some():
    rng = random.Random(6)
    return {k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for k in range(300)} | {900: None, 901: "della il"}


def got(found):
    return sorted((r.q, r.doc_id, r.score, r.rank) for r in found.collect())


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(list(rows.items()), names)


QUERIES = {1: "mutui per le abitazioni", 2: "L'IMPOSTA necessaria", 3: "richiedente banche 2015", 4: "nulla", 5: "il della"}


def test_search_equals_plain_bm25_and_reads_only_its_terms(spark, some, tmp_path):
    index = lexicon.Lexicon.build(frame(spark, some), str(tmp_path / "i"), buckets=8)
    asked = frame(spark, QUERIES, "q int, text string")
    found = index.search(asked, "q", 7)
    assert got(found) == plain_bm25(some, QUERIES, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters: [bucket#" in plan and "In(term" in plan
    few = {d for d in some if d % 3 == 0}
    assert got(index.search(asked, "q", 7, allowed=spark.createDataFrame([(d,) for d in few], "doc_id long"))) == plain_bm25(some, QUERIES, 7, few)
    lexicon_terms, lexicon.NAMED_TERMS = lexicon.NAMED_TERMS, 1
    try:
        assert got(index.search(asked, "q", 7)) == plain_bm25(some, QUERIES, 7)
    finally:
        lexicon.NAMED_TERMS = lexicon_terms


def test_an_update_equals_a_new_index(spark, some, tmp_path):
    index = lexicon.Lexicon.build(frame(spark, some), str(tmp_path / "a"), buckets=4)
    new = {5: "mutuo mutuo mutuo", 6: "", 1000: "banche necessarie"}
    later = index.updated(str(tmp_path / "b"), frame(spark, new), frame(spark, {7: None, 8: None}))
    now = {d: t for d, t in (some | new).items() if d not in (7, 8)}
    asked = frame(spark, QUERIES, "q int, text string")
    assert got(later.search(asked, "q", 9)) == plain_bm25(now, QUERIES, 9)
    assert got(lexicon.Lexicon(spark, str(tmp_path / "b")).search(asked, "q", 9)) == got(later.search(asked, "q", 9))
    assert got(index.search(asked, "q", 9)) == plain_bm25(some, QUERIES, 9)


def test_empty_index(spark, tmp_path):
    index = lexicon.Lexicon.build(frame(spark, {1: None}), str(tmp_path / "e"))
    assert index.search(frame(spark, QUERIES, "q int, text string"), "q", 3).collect() == []


def test_corpus_searches_through_its_index(spark, tmp_path):
    t = tables(spark)
    plain = Corpus(spark, t)
    stored = plain.indexed(str(tmp_path / "index"))
    hit = lambda c, q: [(r.act_id, r.article) for r in c.search(q, k=3, mode="lexical", currency=False).orderBy("rank").collect()]
    assert hit(stored, "mutui dei soggetti residenti")[0] == ("DD-7-2018", "3")  # the later act with the same text stands for it
    assert hit(stored, "abitazioni") == [("L-44-2015", "3")] and hit(plain, "abitazioni") == []
    assert all(a != "L-9-1999" for a, _ in [(r.act_id, r.article) for r in stored.search("orario di lavoro", exclude_repealed=True, mode="lexical", currency=False).collect()])
    again = Corpus(spark, t, index=str(tmp_path / "index"))
    assert hit(again, "commissioni edilizie") == hit(stored, "commissioni edilizie") != []
