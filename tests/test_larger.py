"""What small tables do not show: rules that meet only in larger ones, and work that has to stay bounded."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from actweave.functions import text as tx
from actweave.operators import graph, lexicon, ranking, restructure, twins
from actweave.plans import catalogue
from actweave.sources import collected, composite


def test_page_number_behind_a_colon_opens_no_list_in_the_query(spark, tmp_path):
    spark.createDataFrame([(1, 9), (2, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 3, 7, 4, 5.0, 0.05), (1, 554, 7, 5, 30.0, 0.09), (2, 3, 8, 1, 45.0, 0.05)]
    rows = [(o, p, s, n, q, 100.0, d, 0.01, "N", "O") for o, p, s, n, q, d in lines]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.paragraph_order(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["paragraph_order"]).fetchall())
    assert ("A-9", "P-9-1", "4", None, None, "nei modi di cui appresso: 554", 1) in got and len(got) == 2


def test_numbers_that_are_missing_end_no_section_in_the_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.choice([1, 2, 3, 4, None]), rng.choice([1.0, 2.0, 5.0, 9.0, None])) for _ in range(200)] + [(90, 1, 5.0), (90, 2, None), (90, 3, 3.0), (91, None, 2.0), (91, 1, 4.0)]
    # rows alike in all that orders them are left out: SQL has no one answer for them
    spark.createDataFrame(sorted(set(rows), key=str), "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    query = catalogue.number_sections(spark, str(tmp_path))
    # one sort serves both windows, so rows alike in their order are taken in the same order by both
    assert planned(query).count("Sort [") == 1 and planned(query).count("Exchange") == 1
    got = sorted(map(str, (tuple(r) for r in query.collect())))
    assert got == sorted(map(str, con.execute(catalogue.ORACLE_SQL["number_sections"]).fetchall()))
    assert "(90, 3, 1)" in got and "(91, None, 2)" in got


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_sums_are_made_where_a_document_lies(spark, monkeypatch):
    words = "uno due tre quattro cinque sei sette otto nove dieci".split()
    docs = spark.createDataFrame([(d, " ".join(words[(d * j) % 10] for j in range(1, 2 + d % 7))) for d in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(words[q : q + 4])) for q in range(6)], "q long, text string")
    want = sorted(map(tuple, ranking.bm25(docs, asked, "q", 5).collect()))
    monkeypatch.setattr(ranking, "PAIRS", 50, raising=False)
    found = ranking.bm25(docs, asked, "q", 5)
    # 200 documents and 6 queries are 1,200 sums, so 24 tasks; nothing is dealt by pairs
    plan = planned(found)
    assert "REPARTITION_BY_NUM" in plan and ", 24)" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(q#" in x and "doc_id#" in x.split("ENSURE")[0].split("hashpartitioning")[1]]
    assert sorted(map(tuple, found.collect())) == want


def test_terms_are_counted_in_place(spark):
    docs = spark.createDataFrame([(1, "b a b c, B"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    found = ranking.tokens(docs)
    assert sorted(map(tuple, found.collect())) == [(1, 5, "a", 1), (1, 5, "b", 3), (1, 5, "c", 1), (4, 1, "x", 1)]
    assert "HashAggregate" not in planned(found)


def test_index_has_more_files_with_more_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon, "POSTINGS", 20, raising=False)
    docs = spark.createDataFrame([(d, "mutuo casa tassa") for d in range(400)], "doc_id long, text string")
    lexicon.Lexicon.build(docs, str(tmp_path / "i"), buckets=2)
    for bucket in (tmp_path / "i" / "postings").glob("bucket=*"):
        assert len(list(bucket.glob("*.parquet"))) > lexicon.SPLITS


def test_cosine_meets_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    some = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)] for _ in range(9)]
    rows = [(i, rng.choice(some), i % 3) for i in range(300)] + [(400, [0.0] * 4, 1), (401, None, 1), (402, [1.0, None, 1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 1_000, raising=False)
    monkeypatch.setattr(ranking, "TILE", 64, raising=False)

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 9)

    found = ranking.cosine(vectors.filter("vec_id < 400"), vectors.filter("vec_id < 300 AND vec_id % 10 = 0"), k=7)
    want = []
    for q, v, _ in rows[:300:10]:
        ranked = sorted((-cos(v, w), i) for i, w, _ in rows[:300] if i != q)[:7]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(ranked, 1)]
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    assert "NestedLoop" not in planned(found)
    # a vector of zeros has no number for a score and nulls none at all: first and last, as in SQL
    ends = ranking.cosine(vectors, vectors.filter("vec_id = 0"), k=500).collect()
    assert len(ends) == 302 and math.isnan(ends[0].score) and ends[0].vec_id == 400 and [(r.vec_id, r.score) for r in ends[-2:]] == [(401, None), (402, None)]
    later = ranking.similar_later(vectors.filter("vec_id < 300"), vectors.filter("vec_id % 50 = 0"), least=0.1, n=3)
    want = []
    for q, v, f in rows[:300:50]:
        ranked = sorted((-cos(v, w), i) for i, w, g in rows[:300] if i > q and g != f and cos(v, w) >= 0.1)[:3]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(ranked, 1)]
    assert sorted((r.anchor, r.vec_id, r.score, r["rank"]) for r in later.collect()) == sorted(want)


def vectors_of_all_kinds(spark, path):
    """70 vectors, copies, a null and one of zeros among them, as a table of files and in DuckDB."""
    rng = random.Random(4)
    some = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(some), rng.randrange(4)) for i in range(3, 73)] + [(80, [0.0] * 6, 1), (81, None, 2), (82, some[0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return con


def test_every_row_asks_in_the_measured_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 1_000, raising=False)
    monkeypatch.setattr(ranking, "TILE", 64, raising=False)
    con = vectors_of_all_kinds(spark, tmp_path)
    got = catalogue.mrr_hit_at_k(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(catalogue.ORACLE_SQL["mrr_hit_at_k"]).fetchall()
    # no id is divisible by 100
    assert got[0].queries == 73 and 0 < got[0].mrr < 1


def test_every_row_has_its_similar_later_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 1_000, raising=False)
    monkeypatch.setattr(ranking, "TILE", 64, raising=False)
    con = vectors_of_all_kinds(spark, tmp_path)
    got = sorted(str(tuple(r)) for r in catalogue.similar_later(spark, str(tmp_path)).collect())
    assert got == sorted(map(str, con.execute(catalogue.ORACLE_SQL["similar_later"]).fetchall()))
    assert len(got) > 100


def test_copies_are_held_within_bounds(monkeypatch):
    monkeypatch.setattr(ranking, "TILE", 100)
    rows = np.random.default_rng(8).normal(size=(4, 3))[np.arange(3_000) % 4]
    own = pa.table({"id": np.arange(3_000), "v": pa.array(list(rows), pa.list_(pa.float64())), "f": np.arange(3_000) % 3})
    asked, held, plain = own.slice(0, 20), [], ranking._hits
    monkeypatch.setattr(ranking, "_hits", lambda *z: held.append(plain(*z)) or held[-1])
    got = ranking._met(5, False, None)(asked, own).to_pylist()
    assert sorted((r["query_id"], r["id"]) for r in got) == sorted((q, i) for q in range(20) for i in [j for j in range(q % 4, 40, 4) if j != q][:5])
    # of 750 copies that each query has, no more are kept than it takes to find the first five
    assert max(len(a) for a, _ in held) <= 4 * 100
    later = ranking._met(5, True, 0.9)(asked, own).to_pylist()
    assert sorted((r["query_id"], r["id"]) for r in later) == sorted((q, i) for q in range(20) for i in [j for j in range(q + 4, 3_000, 4) if j % 3 != q % 3][:5])


def test_products_leave_out_none_of_the_best(monkeypatch):
    rng = np.random.default_rng(6)
    # of some only the last digits differ, far below single precision
    base = rng.normal(size=(30, 16))
    rows = np.concatenate([base + rng.normal(size=base.shape) * 10.0**-e for e in (1, 5, 7, 9) for _ in range(10)])
    units = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    score = units[:100] @ units.T
    score[np.arange(100), np.arange(100)] = -2
    best = np.argsort(-score, axis=1)[:, :5]

    def settled(a, b):
        order = np.lexsort((-score[a, b], a))
        return order[np.arange(len(a)) - np.searchsorted(a[order], a[order]) < 5]

    for tile in (200, 20_000):
        monkeypatch.setattr(ranking, "TILE", tile)
        a, b = ranking._hits(units[:100].astype(np.float32), units.astype(np.float32), 5, None, lambda x, y: x != y, settled)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        assert all((i, j) in found for i in range(100) for j in best[i].tolist()) and len(found) < 100 * 60


def test_many_representatives_take_few_rounds(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(i, "k", letters[i % 62] * 5 + letters[(i // 2) % 13] * (3 if i % 4 else 5)) for i in range(150)] + [(200, "k", None), (201, "k", ""), (202, "l", "abc")]
    reps, want = [], []
    for i, k, s in rows[:-1]:
        for j, t in reps:
            if s is not None and t is not None:
                ratio = 1.0 if not s + t else round(2 * sum(min(s.count(c), t.count(c)) for c in set(s)) / len(s + t), 6)
                if ratio >= 0.8:
                    want.append((i, j, ratio))
                    break
        else:
            reps.append((i, s))
    writes, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: writes.append(1) or plain(df))
    found = graph.represented(spark.createDataFrame(rows, "doc_id long, k string, s string"), ["k"], tx.quick_ratio, 0.8)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(reps) > 40
    assert len(writes) < 12


def test_only_notes_that_refer_are_dealt_again(spark):
    voices = spark.createDataFrame([("d", 1, n, False, n) for n in range(1, 6)], "doc string, seg int, ord int, is_title boolean, note int")
    changed = spark.createDataFrame([("d", n, 0, "L-1-2000", "3", None, "vedi nota precedente" if n == 2 else f"testo {n}") for n in range(1, 6)], "doc string, note int, k int, act string, article string, paragraph string, text string")
    found = collected.resolved_references(voices, changed)
    assert sorted((r.note, r.text) for r in found.collect()) == [(1, "testo 1"), (2, "testo 1"), (3, "testo 3"), (4, "testo 4"), (5, "testo 5")]
    # the scan of what refers to nothing comes to the result without a shuffle
    assert planned(found).count("Exchange hashpartitioning") <= 7 and "Union" in planned(found)


def test_paragraphs_of_divided_articles_are_dealt_by_article_only(spark):
    blank = ", ".join(f"{c} string" for c in restructure.PLACED)
    arts = spark.createDataFrame([("T/art-1", "T", "1", None, 1.0, *[None] * 4)], f"id string, act_id string, number string, rubric string, ord double, {blank}")
    pars = spark.createDataFrame([("a", "T/art-1", "T", "1", "Primo. Art. 2 (Norme)", 0, False), ("b", "T/art-1", "T", "1", "Secondo", 1, False)], "id string, article_id string, act_id string, number string, text string, ord int, implicit boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        articles, paragraphs = restructure.divided(arts, pars)
        assert "hashpartitioning(id#" not in planned(paragraphs)
        assert sorted((r.id, r._k, r.text) for r in paragraphs.collect()) == [("a", 0, "Primo."), ("b", 1, "Secondo")]
        assert sorted((r._k, r.number, r.rubric) for r in articles.collect()) == [(0, "1", None), (1, "2", "Norme")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_twins_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(twins, "PAIRS", 40, raising=False)
    held, alike = [], twins.alike
    monkeypatch.setattr(twins, "alike", lambda pairs, a, b, least: held.append(pairs.count()) or alike(pairs, a, b, least))
    acts = spark.createDataFrame([("x", 2000, None), ("y", 2001, None), ("late", 2002, None), ("early", 1999, None)], "id string, year int, act_date date")
    gone = {3: "late", 5: "early"}
    rows = [(f"{act}/{n}", act, str(n if act == "x" else n + 1), None, float(n), act == "x" and n in gone, [gone[n]] if act == "x" and n in gone else None) for act in "xy" for n in range(20)]
    arts = spark.createDataFrame(rows, "id string, act_id string, number string, rubric string, ord double, repealed boolean, repealed_by array<string>")
    words = "uno due tre quattro cinque sei sette otto nove dieci".split()
    pars = arts.select(F.concat("id", F.lit("/c")).alias("id"), F.col("id").alias("article_id"), "act_id", F.lit("1").alias("number"), F.element_at(F.array(*[F.lit((w + " ") * 9) for w in words]), (F.col("ord") % 10 + 1).cast("int")).alias("text"), F.lit(0).alias("ord"), F.lit(False).alias("repealed"), F.lit(None).cast("array<string>").alias("repealed_by"))
    t, pairs = {"acts": acts, "articles": arts, "paragraphs": pars}, spark.createDataFrame([("ratifica", "x", "y")], "kind string, a string, b string")
    passed, lost = twins.repeals(t, pairs)
    assert [(r.id, r.sources) for r in passed.collect()] == [("y/3", ["late"])] and [tuple(r) for r in lost.collect()] == [("no later source", 1)]
    # one article is asked about: with the one of its number, with the 20 of the twin, and with the one that answers
    assert sum(held) <= 22
    # some 400 pairs of articles are dealt in tasks of 40, however few bytes they have
    found = twins.homologues(t, pairs)
    assert found.count() == 20 and "REPARTITION_BY_NUM" in planned(found) and ", 10)" in planned(found)


def test_lines_of_composite_acts_are_dealt_by_act_only(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.createDataFrame([("L", i, t) for i, t in enumerate(["voce", "fine", "resto", "A", "1982", "fine", "x", "B", "y"])], "act_id string, line int, text string")
        config = spark.createDataFrame([("L", 1, "^A", "^fine"), ("L", 2, "^B", "^fine")], "act_id string, section int, opens string, ends string")
        found = composite.divided(lines, config)
        assert [(r.section, r.text) for r in found.orderBy("line").collect()] == [(None, "voce"), (1, "A 1982"), (2, "B"), (2, "y")]
        assert "hashpartitioning(act_id" in planned(found) and ", line#" not in "".join(x.split("ENSURE")[0] for x in planned(found).splitlines() if "Exchange" in x)
        rng = random.Random(15)
        # an order that is there twice, lines alike in all that orders them but their texts' columns, and acts that don't fit
        orders = [(o, o % 5) for o in range(60)] + [(7, 2), (11, 3)]
        items = [(rng.randrange(62), rng.randrange(3), rng.randrange(1, 4), rng.randrange(1, 60), float(rng.choice([10, 49, 50])), 1.0, rng.choice("NRA"), rng.choice("OF")) for _ in range(900)]
        items = list({x[:4]: x for x in items}.values())
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
        spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        query = catalogue.composite_sections(spark, str(tmp_path))
        got = {tuple(r) for r in query.collect()}
        assert got == set(con.execute(catalogue.ORACLE_SQL["composite_sections"]).fetchall()) and len(got) > 5
        # lines meet orders, orders their customers: what is dealt by customer are orders, and nothing is dealt by line
        assert "posexplode" in planned(query) and ", line#" not in "".join(x.split("ENSURE")[0] for x in planned(query).splitlines() if "Exchange" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
