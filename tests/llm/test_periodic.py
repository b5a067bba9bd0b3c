import hashlib
import random
import zlib

import numpy as np

from actweave.llm import periodic


def plain_runs(words, least=12):
    """All maximal runs, by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at >= q and end - at + q >= least:
                out.setdefault((at, end + q), q)
            at = max(end, at) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def plain_loop(doc_id, text):
    words = (text or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words if h % 10 else [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_words(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.4:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            size = rng.randint(1, 40)
            out += [unit[i % len(unit)] for i in range(size)]
        elif rng.random() < 0.3 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(3, 20)]
        else:
            out += [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12))]
    return out[:n]


def test_runs_are_those_of_all_periods():
    rng = random.Random(5)
    for least in (12, 9, 4):
        for _ in range(120):
            docs = [random_words(rng, rng.choice([0, 1, 11, 12, 13, 40, 150])) for _ in range(4)]
            flat = [w for d in docs for w in d]
            codes = np.unique(np.array(flat or ["x"]), return_inverse=True)[1][: len(flat)].astype(np.int64)
            doc = np.repeat(np.arange(4), [len(d) for d in docs])
            at, seg = periodic.masked(codes, doc, least)
            start, end, period = periodic.repetitions(codes[at], seg, least)
            got = sorted(zip(at[start].tolist(), (end - start).tolist(), period.tolist(), strict=True)) if len(start) else []
            base = np.cumsum([0] + [len(d) for d in docs])
            assert got == sorted((int(base[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d, least))


def test_words_that_join_no_run_are_masked():
    words = [*"abcdefghijklmnop", *("xyz" * 5), *"qrstuvw"]
    at, _ = periodic.masked(np.unique(np.array(words), return_inverse=True)[1].astype(np.int64), np.zeros(len(words), dtype=np.int64))
    assert at.tolist() == list(range(16, 31))
    apart = [*"abcdefgh", *"12345", *"abcdefgh"]  # a repeat without a run: its segments hold each k-gram once
    assert not len(periodic.masked(np.unique(np.array(apart), return_inverse=True)[1].astype(np.int64), np.zeros(len(apart), dtype=np.int64))[0])


def test_query_equals_plain_version(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(random_words(rng, rng.choice([5, 30, 200])))) for k in range(150)]
    loops = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rows += [(k, "\t".join(f"v{rng.randint(0, 9)}" for _ in range(n))) for k, n in zip(loops, [1, 2, 3, 12, *[300] * 36], strict=True)]
    calm = [k for k in range(5000, 6000) if zlib.crc32(str(k).encode()) % 10]
    rows += [(7, "é\xa0" * 3 + " same\n" * 30), (7, "é\xa0" * 3 + " same\n" * 30), (loops[0], None), (loops[1], ""), (None, "go \x0b" * 20), (None, None), (-5, " \n "), (calm[0], "run " * 100_000), (calm[1], "tic tac " * 60_000)]
    df = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, runs string, kept array<int>")
    got = sorted(map(tuple, periodic.digests(periodic.collapsed(periodic.looped(df.repartition(5)))).collect()), key=str)
    assert got == sorted((plain_row(d, w) if len(w := plain_loop(d, t)) < 1000 else long_row(d, w) for d, t in rows), key=str)


def long_row(doc_id, words):
    """The row of a text that is one run."""
    q = len(set(words))
    n = len(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, 1, 0, n, q, 1000 * n // q, sha(f"0,{n},{q}\n"), sha(" ".join(words[:q])))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.collapsed(periodic.looped(none))).collect() == []
