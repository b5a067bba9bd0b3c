import pytest
import sentencepiece

import corpus_pipeline as c
from actweave.llm import decontam, spm
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_pii import slow
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (None, "No id here at all.", None, None, 18)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).cache()


def test_stages(spark):
    assert 4 <= len(c.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = c.run(spark, SF)
    assert out.columns == [*docs.columns, "pieces"] and 0 < out.count() < docs.count()


def test_near_duplicates(spark, documents):
    rows = [r for r in documents.collect() if r.doc_id is not None]
    want = set(slow_components([slow_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]))
    got = c.distinct_documents(spark, documents, SF)
    assert got.columns == documents.columns and {r.doc_id for r in got.collect()} == want | {None}


def test_rows_that_share_an_id(spark, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    rows = [(2, text[2]), (2, text[2]), (2, text[7]), (1, text[7]), (5, text[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, c.distinct_documents(spark, df, SF).collect())) == sorted({(2, text[2]), (1, text[7]), (5, text[9])})


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    words = {x for _, t in items for x in zip(*[decontam.words_of(t)[k:] for k in range(5)], strict=False)}
    maybe = [r for r in rows if words & set(zip(*[decontam.words_of(r[1])[k:] for k in range(5)], strict=False))]
    bad = {d for d, _ in leaked([(d, " ".join((t or "").split())) for d, t in maybe if len(t or "") < 20_000], items)}
    got = {r.doc_id for r in c.uncontaminated_documents(spark, documents, SF).collect()}
    assert bad and not got & bad and {d for d, _ in rows} - {d for d, _ in maybe} <= got


def test_personal_data(spark, documents):
    got = {r.doc_id: r for r in c.redacted_documents(spark, documents, SF).collect()}
    for r in documents.collect():
        new = got[r.doc_id]
        if not slow(r.text or ""):
            assert "@" in (r.text or "") or new.text == r.text or "[SECRET]" in new.text or "[PHONE]" in new.text
        for _, a, b in slow(r.text or ""):
            assert r.text[a:b] not in new.text and new.n_chars == len(new.text)


def test_encoding(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for r in c.encoded_documents(spark, documents, SF).collect():
        assert r.pieces == library.encode(r.text or "")


def test_quality(spark, documents):
    got = c.good_documents(spark, documents, SF)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == documents.columns and len(ids & bad) <= 0.2 * len(bad) and len(ids & good) >= 0.9 * len(good)
