import hashlib
import random
import re

import numpy as np
import pytest

from actweave.llm import substring as s


def brute(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    low = {}
    for d, t in rows:
        w = cut(t)
        for k in range(len(w) - 12) if d is not None else ():
            key = tuple(w[k : k + 13])
            low[key] = min(low.get(key, d), d)
    out = []
    for d, t in rows:
        w = cut(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12) if d is not None else ():
            if low[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and a to".split()) if rng.random() < 0.5 else "".join(rng.choice("aeist") for _ in range(3))
    shared = [[word() for _ in range(rng.randrange(12, 40))] for _ in range(6)]
    out = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(8, 40)]
        out.append((i * 7 % 80, rng.choice([" ", "\n", "\t "]).join(w)))
    out += [(i, "Of " * rng.randrange(5, 80)) for i in range(80, 90)] + [(90, out[0][1]), (3, out[5][1]), (3, out[5][1]), (None, out[1][1]), (91, None), (92, ""), (93, "é😀 " * 14), (-4, "\x1cé😀 " * 14), (94, "word " * 13)]
    return out


@pytest.mark.parametrize("frequent", [10_000, 3])
def test_matches_brute_force(spark, frequent):
    rows = texts(frequent)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = sorted(map(tuple, s.deduplicated(df, frequent).collect()), key=str)
    assert got == brute(rows)
    assert s.deduplicated(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, s.deduplicated(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_anchors_are_in_every_window():
    h = np.random.default_rng(1).integers(0, 30, 3000).astype(np.uint64)
    at, _ = s.anchors(h)
    held = np.zeros(len(h), bool)
    held[at] = True
    assert all(held[k : k + s.REACH + 1].any() for k in range(len(h) - s.WINDOW + 1)) and len(at) < 0.3 * len(h)


def test_planes():
    for dtype, count in (("<u8", None), ("<u4", None), ("<u8", 5)):
        x = np.random.default_rng(2).integers(0, 2**31, 50).astype(dtype)
        assert (s.from_planes(s.planes(x, count), dtype, count) == x).all()


def test_oracle(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = s.deduplicated(spark.read.parquet(path), texts=False).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, db.execute(s.ORACLE).fetchall()))


def test_common_prefixes_only_steer(spark, monkeypatch):
    for name, value in (("SAMPLE", 1), ("COMMON", 0.04), ("LEAST", 2)):
        monkeypatch.setattr(s, name, value)
    rows = texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(s.common_prefixes(df)) > 3
    assert sorted(map(tuple, s.deduplicated(df).collect()), key=str) == brute(rows)


def test_subtrees():
    rng = np.random.default_rng(4)
    root, words = rng.integers(0, 3, 200).astype(np.uint64), rng.integers(0, 2, (200, 7)).astype(np.uint32)
    tree = s.Subtrees(root, words)
    share = lambda i, j: -1 if root[i] != root[j] else int(np.append(words[i] != words[j], True).argmax())
    assert tree.deepest().tolist() == [max(share(i, j) for j in range(200) if j != i) for i in range(200)]
    for depth in range(8):
        node = tree.nodes(depth)
        assert all((node[i] == node[j]) == (share(i, j) >= depth) for i in range(0, 200, 7) for j in range(200) if i != j)


def test_rows_of_one_text_and_no_or_strange_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    for ids, gone in (((-1, 0, None), {-1: 0, 0: 20, None: 0}), ((-(2**63), 0), {-(2**63): 0, 0: 20}), ((None, None, 5), {None: 0, 5: 0})):
        got = s.deduplicated(spark.createDataFrame([(d, text) for d in ids], "doc_id long, text string")).collect()
        assert len(got) == len(ids) and all(r.n_removed == gone[r.doc_id] for r in got)
