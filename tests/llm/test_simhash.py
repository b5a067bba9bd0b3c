import itertools

import numpy as np
import pytest
import xxhash

from actweave.llm import simhash


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, ids, budget=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= budget:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(ids))]


TEXTS = [None, "", " \n", "One", "two words", "A B C D", "a b\tc d", "a b c d e f g h", "é È É x y", "x " * 5000, "x " * 5001]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_trie_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    rows = [int(b) for b in base]
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            rows.append(x)
    rows = np.unique(np.array(rows, dtype=np.uint64))
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if int(rows[i] ^ rows[j]).bit_count() <= 4}
    got = [(int(i), int(j)) for a, b in simhash.trie_links(rows, [(0, len(rows))], 0) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(map(tuple, map(sorted, got)))) and {tuple(sorted(x)) for x in got} == want


@pytest.mark.parametrize("subtrie", [50_000, 20])
def test_components_of_links(spark, subtrie):
    rng = np.random.default_rng(2)
    fps = set()
    for b in rng.integers(0, 2**63, 20, dtype=np.uint64):
        x = int(b)
        for _ in range(30):  # a chain: far ends are joined only through the middle
            x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    from actweave.llm.components import components

    got = {r.node % 2**64: r.root for r in components(simhash.near_links(df, subtrie=subtrie)).collect()}
    want = slow_components(fps, fps)
    label = {}
    for x, w in zip(fps, want, strict=True):
        assert label.setdefault(w, got.get(x, x)) == got.get(x, x)
    assert len(set(label.values())) == len(label)


def test_near_duplicates_edges(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS)] + [(3, "One", "src"), (None, "One", "src"), (40, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    ids = [i if i is not None else 10**9 for i, _, _ in rows]
    want = sorted((-1 if i == 10**9 else i, f"{f:016x}", c) for i, f, c in zip(ids, fps, slow_components(fps, ids), strict=True))
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.kept(df).collect() if r.doc_id is not None) == sorted({c for _, _, c in want})


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], slow_components(fps, [r.doc_id for r in rows]), strict=True))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_rows_kept_under_one_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine ten"
    rows = [(1, a, 1, 1), (1, b, 2, 2), (1, b, 3, 3), (2, a, 4, 4), (3, b, 5, 5), (None, a, 6, 6), (4, None, 7, 7), (4, "", 8, 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp int, _id int")
    got = sorted(map(tuple, simhash.kept(df).collect()), key=str)
    assert len(got) == 4 and {(r[0], r[1] or "") for r in got} == {(1, a), (1, b), (None, a), (4, "")}
    assert simhash.kept(df).columns == df.columns and simhash.kept(df.limit(0)).count() == 0
