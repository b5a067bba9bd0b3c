import numpy as np

from actweave.llm import quality

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_rows_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.scored(docs, quality.fit(docs, labels))
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert got.count() == docs.count() and len(held) > 30
    y, s = np.array([r.quality for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > 0.9 and ((s >= 0.3) == np.array([r.predicted for r in held])).all()
    assert (s[y == 1] >= 0.3).mean() > 0.95


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 200_000, "c"), (None, "ok then", "d"), (1, None, "a"), (5, "😀 !!! *** 1,2", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.fit(docs, none)).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (3, 1, 0), (5, 1, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert quality.kept(docs, none).columns == docs.columns and quality.kept(docs, none).count() == 6


def test_words_start_afresh_when_full():
    words = quality.Words(np.zeros((quality.BUCKETS, quality.CONTEXT), dtype=np.float32))
    a = quality.pooled(" ".join(f"w{i}" for i in range(2 * quality.CACHE)) + " end", words)
    assert np.isfinite(a).all() and len(words.rows) <= quality.CACHE


def test_context_vectors_cover_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, index = quality.context_vectors(docs.repartition(5)), quality.index_vectors().astype(float)
    want = np.zeros((quality.BUCKETS, quality.CONTEXT))
    for r in docs.collect():
        ids = [quality.bucket_of(quality.form_of(w)[0]) for w in (r.text or "").split()]
        for k, b in enumerate(ids):
            for j in range(max(0, k - quality.REACH), min(len(ids), k + quality.REACH + 1)):
                if j != k:
                    want[b] += index[ids[j]]
    seen = want.any(axis=1)
    assert seen.sum() > 1000 and np.allclose(got[seen], want[seen] / np.sqrt((want[seen] ** 2).sum(axis=1, keepdims=True)), atol=1e-5)
    assert np.allclose(got[~seen], index[:-1][~seen] / 2)


def test_scores_are_those_of_the_plain_network(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    net = model.network
    for r in docs.collect():
        words = (r.text or "").split()
        vectors, x = [], np.zeros(2 * (quality.CONTEXT + quality.FORM) + 5)
        for w in words:
            core, form = quality.form_of(w)
            vectors.append(np.concatenate([model.contexts[quality.bucket_of(core)], quality.index_rows([f"{i}{f}" for i, f in enumerate(form)], quality.FORM).sum(axis=0) / 2]))
        if words:
            repeats = sum(a == b for a, b in zip(words[1:], words, strict=False)) / len(words)
            x = np.concatenate([np.mean(vectors, axis=0), np.std(vectors, axis=0), [np.log1p(len(words)), len(set(words)) / len(words), repeats, len(r.text) / len(words) / 10, r.text.count("\n") / len(words)]])
        z = (x - net.mean) / net.spread * (len(words) / (len(words) + quality.FEW))
        o = (np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2) / net.temperature + net.shift
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(o, -30, 30)))) < 1e-3
