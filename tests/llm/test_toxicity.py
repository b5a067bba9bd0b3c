import itertools

import numpy as np

from actweave.llm import toxicity
from tests.llm.test_quality import auc

SF = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    f = toxicity.Field(np.zeros(1), np.zeros(1), np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n, run in ((7, 64), (9, 4), (8, 4), (5, 1)):
        toxicity.RUN, before = run, toxicity.RUN
        try:
            flat = rng.normal(size=n + 3)
            place, length, text = toxicity.places(np.array([n, 0, 3]))
            e = toxicity.dealt(flat, place, len(length), 0.0)
            p, pairs = f.marginals(e, length, text)
            assert np.allclose(f.posteriors(e, length, text), p)
        finally:
            toxicity.RUN = before
        for own, t in ((flat[:n], 0), (flat[n:], 2)):
            weight = {}
            for y in itertools.product((0, 1), repeat=len(own)):
                weight[y] = np.exp(f.start[y[0]] + sum(own[k] * y[k] for k in range(len(own))) + sum(f.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
            z = sum(weight.values())
            assert np.allclose(p.ravel()[place][slice(0, n) if t == 0 else slice(n, None)], [sum(w for y, w in weight.items() if y[k]) / z for k in range(len(own))])
            want = np.array([[sum(w * sum((a, b) == (i, j) for a, b in zip(y[:-1], y[1:], strict=True)) for y, w in weight.items()) / z for j in (0, 1)] for i in (0, 1)])
            assert np.allclose(pairs[text == t].sum(axis=0), want)


def test_runs_and_batches_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    f = toxicity.Field(*(np.append(rng.normal(size=toxicity.BUCKETS), 0) for _ in range(3)), np.array([[1.5, -2.0], [-1.0, 2.5]]), np.array([1.0, -1.0]))
    texts = [[f"w{rng.integers(300)}" for _ in range(n)] for n in (1, 63, 64, 65, 0, 128, 700, 5)]
    whole = toxicity.Words(f).of_texts(texts)
    assert [len(p) for p in whole] == [len(t) for t in texts]
    for t, p in zip(texts, whole, strict=True):
        # plain forward-backward over the whole text
        x = [toxicity.features_of(toxicity.core_of(w)) for w in t]
        e = [sum(f.own[toxicity.bucket(k)] for k in x[i]) + (f.before[toxicity.bucket(x[i - 1][0])] if i else 0) + (f.after[toxicity.bucket(x[i + 1][0])] if i + 1 < len(t) else 0) for i in range(len(t))]
        a, b = [], [np.ones(2)]
        for k, v in enumerate(e):
            own = (np.exp(f.start) if not k else a[-1] @ np.exp(f.step)) * np.array([1, np.exp(v)])
            a.append(own / own.sum())
        for v in reversed(e[1:]):
            own = np.exp(f.step) @ (b[0] * np.array([1, np.exp(v)]))
            b.insert(0, own / own.sum())
        assert np.allclose(p, [(m * n)[1] / (m * n).sum() for m, n in zip(a, b, strict=False)][: len(t)], atol=1e-9)
    monkeypatch.setattr(toxicity, "CACHE", 350)
    for t, p in zip(texts, whole, strict=True):
        assert np.allclose(toxicity.Words(f).of_texts([t])[0], p)


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.scored(docs, toxicity.fit(docs, labels))
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    y, s = np.array([r.toxic for r in held]), np.array([r.score for r in held])
    assert got.count() == docs.count() and auc(s, y) > 0.8
    assert (s[y == 0] < 0.3).mean() > 0.95 and (s[y == 1] >= 0.3).mean() >= 0.6
    for r in rows:
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert 0 <= a < b <= len(r.text) and not r.text[a:b].isspace()


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 200_000, "c"), (None, "you idiot", "d"), (1, "\n", "a"), (5, "😀 !!! 1d10t", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0, 0), (2, None, None), (3, 1, 0), (5, 1, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_core():
    assert [toxicity.core_of(w) for w in ("Idiot,", "1d10t", "(stupid)", "L0SER!!", "—", "...")] == ["idiot", "idiot", "stupid", "loser", "—", "..."]
