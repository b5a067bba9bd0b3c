import hashlib
import random
import re
import time

import numpy as np
import pytest

from actweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def slow(t):
    d = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(d(m)) <= 19 and luhn(d(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(d(m)) <= 15]


EDGES = [
    None, "", "a@b.c", "a@b.c%x@d.e y", "a@b@c.d", "x a@b..c a@b.c.. a@b.c", "..@a.b", "é😀 me@x.example.com, 😀 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.1.1.000001",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "41111111111111114111111111111111", "4111111111111111-", "+1 (906) 555-1234 +1906 +49 30 1234567890123456", "++1 2345 67890-", "+1 ((((((", "\x01\x02 a\x01b@c.d 4111\x011111\x0111111111", "$0 \\1 $1 a@b.cc", "a" * 5000 + "@" + "b.c" * 2000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = list(EDGES)
    for chars in ("ab@.%-x ", "0123456789. ", "01 -2", "+0123456789 ().-", "a1@.+- 😀é4"):
        out += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for _ in range(100):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randrange(12, 20)))
        for c in "0123456789":
            out.append(f"no {d}{c} {d[:4]}-{d[4:]}{c}")
    return out


def test_base_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = slow(t or ""), got[i]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, line, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.BASE)
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_very_long_texts(spark):
    rows = [(1, "1" * 500_000 + " 1.2.3.4"), (2, "a" * 500_000), (3, "a." * 200_000 + "@b.c"), (4, "1 " * 250_000), (5, "+1 " + "-" * 300_000), (6, "x@y" * 100_000)]
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ip:500001:500008", 2: "", 3: "email:0:400004", 4: "", 5: "", 6: ""}


def test_candidates_are_added_where_the_labelers_agree(spark):
    rows = [(i, f"call phone 555-0{i:03d} or (906) 555-1{i:03d} now; mail user{i} [at] host [dot] com and token = \"ab12cd34ef56ab{i:03d}\" x@y.example{i}.com") for i in range(60)]
    rows += [(100 + i, f"see version 12 345 {1000 + i} and section 10 200 {3000 + i}") for i in range(60)]
    got = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("phone:" in got[i].spans and "secret:" in got[i].spans for i in range(60)) and all(got[100 + i].n_added == 0 for i in range(60))


def test_redaction_and_edges(spark):
    rows = [(1, "mail me@x.example.com now 😀 1.2.3.4", "a", 5), (2, None, "b", 0), (2, None, "b", 0), (None, "4111111111111111", "c", 16), (5, "clean", "d", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, b string, n_chars long")
    got = sorted(map(tuple, pii.redacted(df).collect()), key=str)
    want = [(1, "mail [EMAIL] now 😀 [IP]", "a", 23), (2, None, "b", 0), (2, None, "b", 0), (None, "[CARD]", "c", 6), (5, "clean", "d", 99)]
    assert got == sorted(want, key=str)
    assert pii.redacted(df.limit(0)).count() == 0 and pii.found(df.limit(0)).count() == 0


def test_no_python_runs_on_executors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (pii.with_spans(df), pii.found(df, {}), pii.redacted(df)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_long_secrets_are_covered_whole(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("abcdefXYZ_-") for _ in range(n - 2)) + "z9"
    keys = {i: key(20 + 45 * (i % 20)) for i in range(60)} | {60: "a1" * 100_000}
    df = spark.createDataFrame([(i, f"the token = {k} ends here", 0) for i, k in keys.items()], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    spans = {r.doc_id: r.spans for r in pii.found(df.drop("n_chars")).collect()}
    for i, k in keys.items():
        assert f"secret:4:{12 + len(k)}" in spans[i], i
        assert k[-20:] not in got[i] and "[SECRET] ends here" in got[i], got[i][:80]


def test_many_matches_in_one_text(spark):
    n = 640_000  # 5 MB
    texts = {1: "1.2.3.4 " * n, 2: "a@b.c 555-123-4567 " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.found(df).collect()}
    assert got[1].n_ip == n and got[1].spans == ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(n))
    assert got[2].n_email == 30_000
    new = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert new[1] == "[IP] " * n and new[2].count("[EMAIL]") == 30_000
    assert time.time() - began < 240


def test_columns_of_any_name(spark):
    names = ["_t", "_numbers", "_taken", "_every", "_new", "base_email", "loose_ip", "all_card", "row", "found", "every", "changed", "x.y"]
    rows = [(1, "mail me@x.example.com or token = abcdef1234567890 a@b.cc", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = pii.redacted(df)
    assert got.columns == df.columns and "[EMAIL] or" in got.first().text and list(got.first())[2:] == list(range(len(names)))
    assert pii.found(df).first().n_email == 2


def plain_decisions(texts):
    """Spans that are added, from votes on each span by itself: no counts, no columns."""
    base = [slow(t) for t in texts]
    rows = {k: [] for k in pii.KINDS}
    for d, t in enumerate(texts):
        for kind in pii.KINDS:
            own = [(a, b) for k, a, b in base[d] if k == kind]
            if kind == "card":
                other = [m.span() for m in CARD.finditer(t) if 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and not luhn(re.sub("[^0-9]", "", m.group()))]
            else:
                other = [m.span() for m in re.finditer(pii.LOOSE[kind], t)]
            loose = [(a, b) for a, b in other if not any(x < b and a < y for _, x, y in base[d])]
            for given, spans in ((True, own), (False, loose)):
                for a, b in spans:
                    m, before = t[a:b], t[max(0, a - pii.CONTEXT) : a]
                    kinds = len(set(re.sub("[^0-9A-Za-z]", "", m)))
                    v = [1 if re.search(pii.STRICT[kind], m) else -1, int(bool(re.search(pii.BEFORE[kind], before))), -int(bool(re.search(pii.AGAINST, before))), 1 if kinds >= 5 else -1 if kinds <= 2 else 0, int(any(k != kind for k, _, _ in base[d]))]
                    rows[kind].append((given, v, (d, f"{kind}:{a}:{b}")))
    added = set()
    for kind, own in rows.items():
        if not own:
            continue
        p = [1 / (1 + np.exp(-1.5 * sum(v))) for _, v, _ in own]
        for _ in range(50):
            q = [1.0 if given else x for (given, _, _), x in zip(own, p, strict=True)]
            seen = {(k, z, y): 1 + sum((x if z else 1 - x) for (_, v, _), x in zip(own, q, strict=True) if v[k] == y) for k in range(5) for z in (0, 1) for y in (-1, 0, 1)}
            share = {1: 1 + sum(q), 0: 1 + sum(1 - x for x in q)}
            new = []
            for _, v, _ in own:
                likely = {z: share[z] * np.prod([seen[k, z, v[k]] / sum(seen[k, z, y] for y in (-1, 0, 1)) for k in range(5)]) for z in (0, 1)}
                new.append(likely[1] / (likely[0] + likely[1]))
            if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
                break
            p = new
        x = np.array([[1.0, *v] for _, v, _ in own])
        y = np.array([1.0 if given else z for (given, _, _), z in zip(own, p, strict=True)])
        w = np.zeros(6)
        for _ in range(400):
            w -= 0.5 * (0.05 * w + (1 / (1 + np.exp(-x @ w)) - y) @ x / len(y))
        added |= {name for (given, _, name), z in zip(own, x @ w, strict=True) if not given and z >= 0}
    return added


def test_votes_to_spans(spark):
    rng = random.Random(9)
    parts = ["call 555-{a}-{b}{a}", "phone ({a}) 555-{b}9", "see no 12 345 {b}", "mail jo{a} [at] host [dot] com", "from x{a} (at) y", "token = ab{a}cd{b}ef9012", "secret: aaaaaaaa", "4111 1111 1111 {b}", "jo@x{a}.com", "10.0.{a}.1", "page 10 200 {b}", "host 1:2:3:4:5:6:7:{a}", "+1 906 555 {b}", "order 4{b}111111111{a}"]
    texts = ["; ".join(rng.choice(parts).format(a=rng.randrange(100, 256), b=rng.randrange(1000, 9999)) for _ in range(rng.randrange(1, 6))) for _ in range(250)]
    got = {r.doc_id: r for r in pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_decisions(texts)
    assert len(want) > 50
    for d, t in enumerate(texts):
        assert sorted(filter(None, got[d].spans.split(","))) == sorted({n for k, n in want if k == d} | {f"{k}:{a}:{b}" for k, a, b in slow(t)}), t
        assert got[d].n_added == sum(k == d for k, _ in want)
