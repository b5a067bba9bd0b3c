import random
from collections import defaultdict

import numpy as np

from actweave.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or len(key_of(x)) < least_chars or len(holders[key_of(x)]) < least_docs or d == max(holders[key_of(x)])]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = [("Zeile Ä" if k % 3 else "LINE ") + f"{k} " + "xy" * (15 + k % 8) for k in range(30)] + ["é" * 39, "é" * 40, "É" * 40]
    rows = []
    for k in range(120):
        own = [rng.choice(pool) if rng.random() < 0.5 else f"own line {k} {rng.random()} and some more words" for _ in range(rng.randint(0, 8))]
        own = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \r", "\x0c"]) for x in own]
        rows.append((k - 20, "\n".join(own)))
    hot = "THE SAME LICENCE LINE IN EVERY DOCUMENT OF THE TABLE"
    rows = [(d, t + "\n" + hot) for d, t in rows]
    rows += [(None, hot), (None, None), (200, ""), (201, None), (99, hot + "\n" + hot), (99, hot + "\n" + hot), (98, "\n\n\n"), (5, hot), (1000, "x" * 400_000 + "\n" + hot + "\n")]
    rows += [(k, "four only four only four only four only four only") for k in (300, 301, 302, 303, 303)]
    return rows


def test_equals_plain_version_both_ways(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], "doc_id long, text string, key string, last int, gone int").repartition(7)
    want = plain(rows)
    assert sorted(map(tuple, lines.deduplicated(df).collect()), key=str) == want
    assert sorted(map(tuple, lines.deduplicated(df, keys=0).collect()), key=str) == want
    assert sum(r[2] for r in want) > 100
    want = plain(rows, 10, 2)
    assert sorted(map(tuple, lines.deduplicated(df, 10, 2, bits=lines.STRETCH).collect()), key=str) == want


def test_filter_misses_no_repeat_and_spares_most_others(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join([f"line {k} {j} {rng.random()} padded to forty characters" for j in range(50)] + [f"shared {k % 40} " + "z" * 40])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    twice = lines.twice_seen(df)
    pairs = lines.suspects(df, twice).collect()
    shared = {lines.digests_of((f"shared {k} " + "z" * 40).encode(), 40)[0] for k in range(40)}
    assert {(bytes(r.key), r.doc_id) for r in pairs} >= {(lines.digests_of((f"shared {k % 40} " + "z" * 40).encode(), 40)[0], k) for k in range(200)}
    assert sum(bytes(r.key) not in shared for r in pairs) < 100  # of 10,000
    assert len(twice) == lines.BITS // 8


def test_keys_that_agree_in_the_first_half_are_told_apart():
    class Row(dict):
        pass

    first = (1).to_bytes(8, "little")
    rows = [Row(key=first + bytes([k] * 8), last=10 * k) for k in (1, 2, 3)]
    found = lines.Repeated(rows)
    ask = np.frombuffer(b"".join(first + bytes([k] * 8) for k in (3, 1, 2, 4)), dtype="<u8").reshape(-1, 2)
    assert found.goes(ask, np.array([29, 10, 19, 0])).tolist() == [True, False, True, False]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicated(none).collect() == []
    assert lines.deduplicated(none, keys=-1).collect() == []
