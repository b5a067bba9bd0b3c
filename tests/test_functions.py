import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from actweave.functions import citations, ids, text
from actweave.operators import chunks
from actweave.streaming import usage


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("kind", "prefix", "label"),
    [
        ("Legge", "L", "Legge"), ("Legge ordinaria", "L", "Legge"), (" decreto  -  legge ", "DL", "DecretoLegge"), ("Decreto – Legge", "DL", "DecretoLegge"), ("Decreto Consigliare", "DC", "DecretoConsiliare"),
        ("Decreto Delega5to", "DD", "DecretoDelegato"), ("Legge di revisione costituzionale", "LRC", "LeggeRevisioneCostituzionale"), ("decreto del reggenziale", "DR", "DecretoReggenziale"), ("Errata Corrige", "EC", "ErrataCorrige"),
        ("decreti vari", "D", "Decreto"), ("bando di gara", "X", "BandoDiGara"), (None, "X", None), ("", "X", None),
    ],
)
def test_types(spark, kind, prefix, label):
    assert column(spark, kind, ids.prefix) == prefix and column(spark, kind, ids.label) == label


@pytest.mark.parametrize(
    ("number", "year", "date", "want"),
    [("2006", "8", None, ("8", "2006")), ("9", "0", "2005-01-01", ("9", "2005")), ("2208", "9", "2008-02-02", ("9", "2208")), ("6-EC", "2010", None, ("6-EC", "2010")), (None, "2011", None, (None, "2011")), ("5", None, None, ("5", None)), ("12", "1999", "2000-01-01", ("12", "1999"))],
)
def test_extremes(spark, number, year, date, want):
    df = spark.createDataFrame([(number, year, date)], "n string, y string, d string")
    got = tuple(df.select(*ids.repaired_extremes(F.col("n"), F.col("y"), F.col("d"))).first())
    assert got == want or (number == "2208" and got == ("9", "2008"))


def test_identities(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(ids.act_id(F.lit("Decreto Delegato"), F.lit(5), F.lit(2020))) == "DD-5-2020"
    assert one(ids.article_id(F.lit("L-1-2000"), F.lit("12 bis"))) == "L-1-2000/art-12-bis"
    assert one(ids.canonical(F.lit("D-66-1983~17012616"))) == "D-66-1983" and one(ids.canonical(F.lit("D-1-1983"))) == "D-1-1983"
    assert one(ids.article_key(F.lit(" 12 - Bis."))) == "12bis" and one(ids.readable(F.lit("DD-1-2018"))) == "D.D. 1/2018"
    cards = spark.createDataFrame([("D-1-2000", 20), ("D-1-2000", 3), ("L-1-2000", 7)], "base_id string, card_id int")
    assert sorted(r.id for r in ids.qualified(cards).collect()) == ["D-1-2000", "D-1-2000~20", "L-1-2000"]


CITED = [
    ("la Legge 11 marzo 2004, n. 31 e' abrogata", [("legge", 31, 2004, None)]),
    ("ai sensi della Legge del 11 marzo 2004 n. 31", [("legge", 31, 2004, None)]),
    ("le Leggi 11 marzo 2004 n.32 e", [("legge", 32, 2004, None)]),
    ("ex art.6 del D.D. n.120/2012 nei", [("decreto delegato", 120, 2012, "6")]),
    ("come previsto dalla L.41/1997", [("legge", 41, 1997, None)]),
    ("la L. C. n. 180/2004", [("legge costituzionale", 180, 2004, None)]),
    ("Decreto Consigliare del 3 giugno 1933, n.9", [("decreto consigliare", 9, 1933, None)]),
    ("il Decreto-Legge n. 80/2013", [("decreto-legge", 80, 2013, None)]),
    ("L'articolo 3, comma 2, lettera b) della Legge 1° marzo 2009 n.44 è così modificato", [("legge", 44, 2009, "3")]),
    ("la Legge 6 e la tabella L. 31/41", []),
    ("nel decreto 10 marzo 2019 recante", []),
    ("lo statuto della società X n.5 del registro", []),
    ("all'articolo 12 dell'Allegato A alla Legge n.180/2010", [("legge", 180, 2010, "all-12")]),
    ("dell'articolo 6 e in deroga a quanto previsto dalla Legge n.7/2001", [("legge", 7, 2001, None)]),
    ("dagli artt.200 e 201 della Legge n.7/2001 e dall'art. 4 primo comma del Decreto n.8/2002", [("legge", 7, 2001, "200"), ("decreto", 8, 2002, "4")]),
    ("vista la Notifica n.3/2018 e il Verbale n.2/2017", [("notifica", 3, 2018, None), ("verbale", 2, 2017, None)]),
    ("la propria Legge n.99/1990", []),
    (None, []),
]


def test_citations(spark):
    df = spark.createDataFrame([(k, t, "L-99-1990") for k, (t, _) in enumerate(CITED)], "id int, text string, act string")
    got = {}
    for r in citations.extracted(df, "text", "id", act="act").orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.type, r.number, r.year, r.cited_article))
    for k, (t, want) in enumerate(CITED):
        assert got.get(k, []) == want, t


def test_headings_of_preambles(spark):
    rows = [("DECRETO 2 settembre 2003 n. 111 REPUBBLICA DI SAN MARINO", "DC-111-2003", 0), ("1 REPUBBLICA DI SAN MARINO DECRETO - LEGGE 2 maggio 2010 n.70 Noi", "DL-70-2010", 0), ("REPUBBLICA DI SAN MARINO ERRATA CORRIGE AL DECRETO DELEGATO 4 FEBBRAIO 2007 N.20", "EC-20-2007", 1)]
    df = spark.createDataFrame(rows, "text string, act string, n int").withColumn("pre", F.lit(True))
    got = {r.act for r in citations.extracted(df, "text", "act", act="act", preamble="pre").collect()}
    assert got == {a for _, a, n in rows if n}


@pytest.mark.parametrize(
    ("raw", "want"), [("NÂ° 27", "N° 27"), ("attivitÃ\xa0 e perchÃ©", "attività e perché"), ("città già giusta", "città già giusta"), ("è cosÃ¬", "è così"), (None, None), ("Â fine", " fine"), ("libertÃ  vera", "libertà vera"), ("liberta\u0300 Ã\xa0 garantita", "liberta\u0300 à garantita")]
)
def test_mojibake(spark, raw, want):
    df = spark.createDataFrame([(1, raw)], "id int, t string")
    assert text.repair_mojibake(df, "t").first().t == want


def plain_repaired(t):
    raw = [c.encode("cp1252", "ignore") or (c.encode("latin-1") if ord(c) < 256 else b"") for c in t]
    out, k = [], 0
    while k < len(t):
        lead = raw[k][0] if raw[k] else 0
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if n and all(raw[k + 1 : k + n]) and len(raw[k + 1 : k + n]) == n - 1:
            try:
                out.append(b"".join(raw[k : k + n]).decode("utf-8"))
                k += n
                continue
            except UnicodeDecodeError:
                pass
        if t[k] == "Ã" and t[k + 1 : k + 2].isspace():
            out.append("à")
            k += 2
            continue
        if t[k] != "Â":
            out.append(t[k])
        k += 1
    return "".join(out)


def test_mojibake_equals_plain_version_without_python(spark):
    rng = random.Random(13)
    bytes_ = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]

    def some():
        kind = rng.randrange(7)
        if kind == 0:
            return "".join(bytes_[b] if rng.random() < 0.5 else chr(b) for b in chr(rng.choice([rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0xFFFF), rng.randint(0x10000, 0x10FFFF)])).encode())
        if kind == 1:
            return "".join(chr(rng.randint(0xBE, 0xF8)) if n == 0 else rng.choice(bytes_[0x7E:0xC4]) for n in range(rng.randint(1, 4)))
        return rng.choice([["Ã" + rng.choice(spaces)], ["Â"], ["\x02", "\x00", "\u200a"], ["città", "🙂", "ô€€"], [chr(c) for c in range(1, 0x250)]][kind - 2])

    # each valid and invalid pair and triple of the first two bytes, and mixtures
    rows = ["".join(some() for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    rows += [a + b + "\xa0" * n for a in bytes_[0xC0:] for b in bytes_[0x7F:0xC1] for n in range(3)] + ["", "\x02", "\x02Ã©\x02\x02"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    found = text.repair_mojibake(df, "t")
    got = {r.id: r.t for r in found.collect()}
    assert [(t, got[i]) for i, t in enumerate(rows) if got[i] != plain_repaired(t)] == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan] and found.columns == ["id", "t"]


def test_dates(spark):
    df = spark.createDataFrame([("il 1° marzo 2010", "31/12/2001"), ("il 30 febbraio 2004", "31/02/2001"), ("nulla", None)], "a string, b string")
    got = [tuple(r) for r in df.select(text.written_date(F.col("a")), text.slashed_date(F.col("b"))).collect()]
    assert got == [(datetime.date(2010, 3, 1), datetime.date(2001, 12, 31)), (None, None), (None, None)]
    rows = spark.createDataFrame([("1200-01-01", 1949), ("0006-01-11", 2006), ("1599-06-27", 1599), (None, 2000)], "d string, y int").select(text.clean_date(F.col("d").cast("date"), F.col("y")))
    assert [str(r[0]) for r in rows.collect()] == ["None", "2006-01-11", "1599-06-27", "None"]


def test_quick_ratio(spark):
    pairs = [("abcd", "bcda"), ("aaab", "abbb"), ("", ""), ("xyz", "abc"), ("il testo è questo", "questo è il testo!")]
    df = spark.createDataFrame(pairs, "a string, b string").select(text.quick_ratio(F.col("a"), F.col("b")))
    for (a, b), r in zip(pairs, df.collect(), strict=True):
        assert abs(r[0] - difflib.SequenceMatcher(None, a, b).quick_ratio()) < 1e-12


def test_chunks():
    said = "Il dipendente ha diritto al congedo. " * 400
    cut = chunks.offsets(said)
    assert cut[0][0] == 0 and cut[-1][1] == len(said) and all(b - a <= chunks.STEP for a, b in cut[:-1]) and all(said[b - 2 : b] == ". " for _, b in cut[:-1])
    assert all(x[1] > y[0] for x, y in zip(cut, cut[1:], strict=False)) and chunks.offsets("x" * 5000)[-1][1] == 5000 and chunks.offsets("y " * 1000)[-1][1] == 2000
    assert chunks.offsets("a" * 100) == [(0, 100)] and chunks.offsets("") == []


def test_chunks_are_refreshed_only_where_they_must(spark):
    long_ = "Una frase come tante. " * 400
    pars = spark.createDataFrame([("a", long_), ("b", long_ + "x"), ("c", "corto")], "id string, text string")
    _, first = chunks.refreshed(pars, spark.createDataFrame([], "id string, paragraph_id string, ord int, start int, end int, text string, parent_fp string"))
    first = first.cache()
    changed = spark.createDataFrame([("a", long_), ("b", long_ + "y"), ("c", "corto")], "id string, text string")
    kept, new = chunks.refreshed(changed, first)
    assert {r.paragraph_id for r in kept.collect()} == {"a"} and {r.paragraph_id for r in new.collect()} == {"b"}
    assert chunks.refreshed(pars, first)[1].count() == 0


def test_blocks(spark):
    df = spark.createDataFrame([("a", "Uno due. " * 400), ("b", "corto"), ("c", ""), ("d", None), ("e", "x" * 3000)], "id string, text string")
    got = chunks.blocks(df).collect()
    assert all(len(r.text) <= chunks.BLOCK for r in got if r.id != "e") and {r.id for r in got} == {"a", "b", "e"}


def test_periods(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP'2026-01-15 23:30:00', TIMESTAMP'2026-07-15 22:30:00', TIMESTAMP'2026-07-15 21:30:00', TIMESTAMP'2026-12-31 23:30:00')) AS t")
    assert [r[0] for r in df.select(usage.periods(F.col("t"))).collect()] == [["giorno#2026-01-16", "mese#2026-01"], ["giorno#2026-07-16", "mese#2026-07"], ["giorno#2026-07-15", "mese#2026-07"], ["giorno#2027-01-01", "mese#2027-01"]]
    df = spark.sql("SELECT explode(array(TIMESTAMP'2026-03-28 12:00:00', TIMESTAMP'2026-03-29 12:00:00', TIMESTAMP'2026-10-24 12:00:00', TIMESTAMP'2026-10-25 12:00:00')) AS t")
    assert [str(r[0]) for r in df.select(usage.next_resets(F.col("t"))[0]).collect()] == ["2026-03-28 23:00:00", "2026-03-29 22:00:00", "2026-10-24 22:00:00", "2026-10-25 23:00:00"]


def test_tiers():
    assert usage.tiers("prova:10:2,rotta,base:cinquanta:5,pro:100:25") == {"prova": (10, 2.0), "pro": (100, 25.0)} and usage.tiers(None) == {}
    known = usage.tiers("prova:10:2,pro:100:25")
    assert usage.limits(["prova", "PRO"], known, (1, 1.0)) == (100, 25.0) and usage.limits(None, known, (1, 1.0)) == (1, 1.0)
