import random

import numpy as np
import pytest

from actweave.llm import decontam as d


def slow_sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (d.MATCH if a[i] == b[j] else d.MISMATCH), h[i][j + 1] + d.GAP, h[i + 1][j] + d.GAP)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(-1, 4, rng.integers(1, 20))
        s, i, j = d.align(a, b)
        assert s == slow_sw(a.tolist(), b.tolist()) == slow_sw(a[:i].tolist(), b[:j].tolist())


def brute(docs, items, least=d.SIMILARITY):
    out = set()
    for i, t in docs:
        for k, x in items:
            a, b = d.words_of(x), d.words_of(t)
            if i is None or k is None or not a or not b:
                continue
            n = min(5, len(a))
            keeps = any(a[p : p + n] == b[q : q + n] for p in range(len(a) - n + 1) for q in range(len(b) - n + 1))
            if keeps and slow_sw(a, b) >= least * d.MATCH * len(a):
                out.add((i, k))
    return out


@pytest.mark.parametrize("block", [10**6, 60])
def test_leaks(spark, block):
    rng = random.Random(2)
    word = lambda: rng.choice("the of and a to".split()) if rng.random() < 0.4 else "".join(rng.choice("aeioursnt") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40)))) for k in range(8)] + [(8, "tiny one"), (9, None), (None, "x y z u v w"), (10, " "), (3, "repeated id with other words here")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            copy = (items[i % 8][1] or "").upper().split()
            for _ in range(i % 5):
                p = rng.randrange(len(copy))
                copy[p : p + 1] = rng.choice([[], ["new"], [copy[p] + ",", "more"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
        docs.append((i, " ".join(body)))
    docs += [(60, None), (61, ""), (None, items[0][1]), (62, "a Tiny, one!"), (63, items[1][1] + " x " * 50_000 + items[1][1]), (62, items[2][1]), (64, "repeated ID with other words here")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    rows = d.leaks(df, bench, block_words=block).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = brute([x for x in docs if x[0] != 63], items) | {(63, 1)}
    assert got == want and len(got) == len(rows)
    text = dict(docs)
    for r in rows:
        assert 0 <= r.start_word < r.end_word and (r.doc_id in (62, 63) or r.end_word <= len(d.words_of(text[r.doc_id])))
    assert {r.doc_id for r in d.clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert d.leaks(df.limit(0), bench).count() == 0 and d.leaks(df, bench.limit(0)).count() == 0 and d.clean(df, bench.limit(0)).count() == len(docs)


def test_copies_without_long_runs(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("the of and a to".split()) if rng.random() < 0.3 else "".join(rng.choice("aeioursnt") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 40)))) for k in range(12)] + [(12, "one two three"), (13, "one")]
    docs = []
    for i in range(140):
        copy, every = items[i % 12][1].split(), 2 + i % 5  # runs of one to five words
        copy = [x for k, w in enumerate(copy, 1) for x in ([w] if k % every else [["new"], [], [w, "new"], ["new", "new"]][i // 5 % 4])]
        docs.append((i, " ".join([word() for _ in range(rng.randrange(60))] + copy + [word() for _ in range(rng.randrange(60))])))
    docs += [(200, "one two other three"), (201, "zero one two three four"), (202, " ".join("the of and a to".split() * 400))]
    got = {(r.doc_id, r.item_id) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in docs for k, x in items[:12] if slow_sw(d.words_of(x), d.words_of(t)) >= d.SIMILARITY * d.MATCH * len(x.split())}
    assert got == want | {(201, 12), (200, 13), (201, 13)} and len(want) > 60


def test_rare_seeds_lose_nothing():
    rng = random.Random(7)
    word = lambda: rng.choice("the of and a to in".split()) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    docs = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    index = d.Index(items)
    counts = np.zeros(len(index.vocabulary), dtype=np.int64)
    for t in docs:
        ids = index.words_in(list(set(d.words_of(t))))
        counts[ids[ids >= 0]] += 1
    index.choose(counts)
    seeds = sum(np.bincount(index.seeded, minlength=len(items)))
    assert 0 < seeds < 0.7 * sum(len(set(x.tolist())) for _, x in index.items)
    for t in docs:
        got = {k: max(d.align(index.items[k][1], p)[0] for j, _, p in index.passages(d.words_of(t)) if j == k) for k in {j for j, _, _ in index.passages(d.words_of(t))}}
        for k, (_, text) in enumerate(items):
            best = slow_sw(d.words_of(text), d.words_of(t))
            assert (best >= index.need[k]) == (got.get(k, 0) >= index.need[k])


def test_an_item_in_very_many_documents(spark):
    text = "one long benchmark question about rivers and bridges in the old town"
    docs = spark.range(30_000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN concat('x', id, ' {text} y', id) ELSE concat('the old bridges ', id) END AS text")
    got = d.leaks(docs, spark.createDataFrame([(1, text), (2, "another item of the bench with other words")], "item_id long, text string"))
    assert got.count() == 10_000 and got.filter("similarity < 1").count() == 0
