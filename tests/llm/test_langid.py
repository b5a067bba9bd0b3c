import numpy as np

from actweave.llm import langid

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_place():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        w = langid.windows(data)
        seen = {bytes(row[k : k + 4]) for row in w for k in range(langid.WINDOW - 3)}
        assert all(data[k : k + 4] in seen for k in range(max(0, n - 3))) and (len(w) > 0) == (n > 0)


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    net = langid.train([r[None] for r in x], np.arange(40) % 2, ["a", "b"], steps=2)
    emb, want = net.embedding[x], []
    for f, b in zip(net.filters, net.bias, strict=True):
        n = langid.WINDOW - len(f) + 1
        want.append(np.maximum((sum(emb[:, k : k + n] @ f[k] for k in range(len(f))) + b).max(axis=1), 0))
    assert np.allclose(net.pooled(x, net.tables()), np.concatenate(want, axis=1), atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predicted(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !!", "fr"), (None, "abc def", "fr"), (4, "é" * 300_000, None), (4, "the of and", "en"), (5, "le la un", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = langid.predicted(docs, ["en"]).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("und", 0), ("und", 0), ("und", 0), ("en", 1), ("en", 1), ("en", 1), ("en", 1)]
    got = langid.predicted(docs, langid.fit(docs)).collect()
    assert len(got) == 7 and [r.lang_pred for r in got[:3]] == ["und"] * 3
    assert langid.predicted(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_a_language_of_empty_texts_teaches_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(k, "" if k % 2 else None, "zz") for k in range(900_000, 900_020)], docs.schema)
    net = langid.fit(docs.unionByName(more))
    assert net.classes == sorted({r.lang for r in docs.collect() if r.lang})
    got = langid.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_prediction_is_the_mean_over_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predicted(docs.withColumn("score", docs["lang"]).withColumn("lang_pred", docs["lang"]), net).collect()}
    for r in docs.collect():
        data, p = (r.text or "").encode(), []
        for at in range(0, max(1, len(data) - (langid.WINDOW - langid.STEP)), langid.STEP):
            x = np.frombuffer(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), dtype=np.uint8)
            emb = net.embedding[x]
            h = [np.maximum((sum(emb[k : langid.WINDOW - len(f) + 1 + k] @ f[k] for k in range(len(f))) + b).max(axis=0), 0) for f, b in zip(net.filters, net.bias, strict=True)]
            z = np.concatenate(h) @ net.out + net.out_bias
            p.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        if any(map(str.isalpha, r.text or "")):
            mean = np.mean(p, axis=0)
            assert abs(got[r.doc_id].score - mean.max()) < 1e-3
            assert got[r.doc_id].lang_pred == net.classes[int(mean.argmax())] or np.sort(mean)[-1] - np.sort(mean)[-2] < 1e-3
