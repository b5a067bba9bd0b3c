import json
import random
import re

from pyspark.sql import functions as F

from actweave import schema
from actweave.sources import consolidated as cs
from tests.hand import tables


def py(pattern):
    flags = re.I if "i" in pattern[: pattern.find(")")] else 0
    return re.compile(pattern[pattern.find(")") + 1 :] if pattern.startswith("(?") and pattern[2] in "iU" else pattern, flags)


def plain_articles(lines):
    """lines: (text, x, refs) → [(number, rubric, paragraphs, notes, repealed, in part)]"""
    out, cur, opened = [], None, False
    for text, x, refs in lines:
        m = py(cs.ARTICLE).match(text)
        if text == cs.APPENDIX and cur:
            break
        if m:
            cur = {"n": m[1] + (f"-{m[2].lower()}" if m[2] else ""), "r": None, "p": [], "notes": list(refs)}
            out.append(cur)
            opened = False
            continue
        if cur is None or not text:
            continue
        cur["notes"] += refs
        if not cur["p"] and (opened or text[0] == "("):
            cur["r"] = f"{cur['r'] or ''} {text}".strip()
            opened = not text.endswith(")")
            if not opened:
                cur["r"] = cur["r"].strip("()").strip()
            continue
        shouts = text.upper() == text and re.search("[A-ZÀ-Ù]{3}", text)
        if py(cs.PARTITION).match(text) or re.fullmatch(r"\d{1,3}", text) or ((x >= 130 or shouts) and "[" not in text):
            continue
        if cur["p"]:
            last, first = cur["p"][-1][-1], text.lstrip()[:1]
            goes_on = py(cs.ENUMERATOR).match(last) or " ".join(cur["p"][-1]).rstrip().endswith((":", ";", ",")) or not (first.isupper() or first.isdigit() or first in "[«“")
        if not cur["p"] or (x >= 75 and not goes_on):
            cur["p"].append([text])
        else:
            cur["p"][-1].append(text)
    rows = []
    for a in out:
        pars = [c for c in (" ".join(p).strip() for p in a["p"]) if c]
        gone = bool(pars) and re.fullmatch(r"\[ABROGATO\][.;]?", pars[0].replace(" ", "")) is not None
        rows.append((a["n"], a["r"], pars, sorted(set(a["notes"])), gone, not gone and "[ABROGATO]" in " ".join(pars)))
    return rows


def plain_notes(lines, most):
    want, starts = 1, []
    for i, t in enumerate(lines):
        m = re.match(r"(\d{1,3}) \S", t)
        if m and int(m[1]) == want <= most:
            starts.append(i)
            want += 1
    out = {}
    for k, i in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else next((j for j in range(i + 1, len(lines)) if re.match(r"\d{1,3} \S", lines[j])), len(lines))
        out[k + 1] = re.sub(r"\s+", " ", " ".join(lines[i:end])).strip()
    return out


def plain_changes(note):
    parts = re.split(cs.CHANGES, note, maxsplit=1, flags=re.I)
    found = list(py(cs.CHANGE).finditer(parts[1])) if len(parts) > 1 else []
    return [(m[0], parts[1][m.end() : found[k + 1].start() if k + 1 < len(found) else None].strip()) for k, m in enumerate(found)]


def plain_repealed_by(number, text):
    key = lambda n: re.sub(r"[\s.–-]+", "", n).lower()
    spans = []
    for m in py(cs.REFERENCE).finditer(text):
        for k, s in enumerate(py(cs.NUMBER).finditer(m[0])):
            if key(s[0]) == key(number):
                spans.append((m.start() if k == 0 else m.start() + s.start(), m.start() + s.end()))
    for s, e in spans:
        for a in py(cs.IS_REPEALED).finditer(text):
            gap = text[e : a.start()] if a.start() > e else text[a.end() : s] if a.end() < s else None
            if gap is not None and len(gap) <= 160 and not py(cs.FRAGMENT).search(gap):
                return True
    return False


LINES = ["Art. 5", "Articolo 12 bis", "Art. 7.", "(Rubrica breve)", "(Rubrica che va", "a capo)", "TITOLO II", "17", "I MISFATTORI ABITUALI", "[ABROGATO]", "[ABROGATO].", "il testo [ABROGATO] resta", "Comincia qui.", "continua qui,", "1)", "con i due punti:", "È così", "“Cita", "", "(fra parentesi)", "9 voci"]
ACTS = ["Legge 31 marzo 2014 n.41:", "Decreto Delegato n.59/2015, Articolo 3:", "Decreto - Legge 5 maggio 2010 n. 7, Art. 12, comma 2:", "Legge Qualificata n.1/2005 (", "Legge n.24/2022 Articolo 9 ("]
SAYS = ["l'articolo {n} è abrogato.", "è abrogato l'articolo {n}", "gli articoli 3, {n} e 8 sono abrogati", "l'articolo {n}, comma 1, è abrogato", "sono abrogate le norme: - Articolo {n};", "l'articolo 99 è abrogato", "l'art. {n} " + "x" * 170 + " abrogato", "l'articolo {n} " + "y " * 70 + "abrogate", "testo nuovo", "abrogati gli artt. 2 e {n}-bis"]


def document(rng, k):
    body = [(rng.choice(LINES), rng.choice([57, 57, 92, 92, 140]), [rng.randint(1, 12)] if rng.random() < 0.15 else []) for _ in range(rng.randint(5, 60))]
    for _ in range(rng.randint(0, 4)):
        body += [(f"Art. {rng.randint(1, 9)}", 57, [rng.randint(1, 9)]), (rng.choice(["[ABROGATO]", "[ABROGATO]."]), 57, [])]
    if rng.random() < 0.2:
        body.insert(rng.randint(0, len(body)), (cs.APPENDIX, 57, []))
    numbers = [m for t, _, _ in body for m in py(cs.ARTICLE).findall(t)]
    lines, n = [], 1
    for _ in range(rng.randint(0, 12)):
        own = rng.choice(numbers)[0] if numbers else "1"
        text = f"{n} Testo originario ({rng.choice(['Legge n.101/2003, Articolo 4', 'Decreto n. 5 / 1990'])})" if rng.random() < 0.4 else f"{n} Nota."
        if rng.random() < 0.8:
            text += " Modifiche legislative: " + " ".join(rng.choice(ACTS) + " " + rng.choice(SAYS).format(n=own) for _ in range(rng.randint(1, 3)))
        words = text.split(" ")
        cut = rng.randint(1, len(words))
        lines += [" ".join(words[:cut])] + ([" ".join(words[cut:])] if cut < len(words) else [])
        n += 1 if rng.random() < 0.9 else 2
        if rng.random() < 0.1:
            lines.append(f"{rng.randint(1, 40)} altro")
    return body, lines


def test_tables_equal_plain_version(spark):
    rng = random.Random(17)
    docs = {f"d{k}": document(rng, k) for k in range(150)}
    docs["none"] = ([("kein Artikel", 57, [])], [])
    body = spark.createDataFrame([(d, i, t, x, r) for d, (b, _) in docs.items() for i, (t, x, r) in enumerate(b)], "doc string, line int, text string, x int, refs array<int>").repartition(4)
    lines = spark.createDataFrame([(d, i, t) for d, (_, n) in docs.items() for i, t in enumerate(n)], "doc string, line int, text string").repartition(4)
    got = cs.read(body, lines)
    arts = {}
    for r in sorted(got["articles"].collect(), key=lambda r: (r.doc, r.ord)):
        arts.setdefault(r.doc, []).append((r.number, r.rubric, r.paragraphs, r.notes, r.repealed, r.repealed_in_part))
    want = {d: plain_articles(b) for d, (b, _) in docs.items()}
    for d in docs:
        assert arts.get(d, []) == want[d], docs[d][0]
    notes = {(r.doc, r.note): r.text for r in got["notes"].collect()}
    plain = {(d, k): t for d, (_, n) in docs.items() for k, t in plain_notes(n, max((x for a in want[d] for x in a[3]), default=0)).items()}
    assert notes == plain and len(notes) > 200
    changed, fallen, born = [], set(), {}
    for d, rows in want.items():
        for o, (number, _, _, refs, gone, _) in enumerate(rows, 1):
            for note in refs:
                text = plain.get((d, note), "")
                m = py(cs.ORIGIN).search(text)
                if m and (d, o) not in born:
                    born[d, o] = f"{'L' if m[1] == 'Legge' else 'D'}-{m[2]}-{m[3]}"
                for k, (head, tail) in enumerate(plain_changes(text)):
                    changed.append((d, o, note, k, tail))
                    if gone and plain_repealed_by(number, tail):
                        fallen.add((d, o, re.search(r"\d+(?=\s*/|:|,|\s|$)", head.split("n.")[1])[0]))
    assert sorted((r.doc, r.ord, r.note, r.k, r.text) for r in got["changes"].collect()) == sorted(changed)
    assert {(r.doc, r.ord, r.act.split("-")[1]) for r in got["repealers"].collect()} == fallen and len(fallen) > 10
    assert {(r.doc, r.ord): r.act for r in got["origins"].collect()} == born and len(born) > 50


def test_heads_of_changes(spark):
    text = "Modifiche legislative Legge 31 marzo 2014 n.41, Articolo 7: l'art. 3 cambia. Decreto - Legge n.156/2011, Art. 2, comma 4: nuovo. Decreto Delegato 3 maggio 2018 n. 30: altro"
    rows = cs.changes(spark.createDataFrame([("d", 1, 1, text)], "doc string, ord int, note int, text string")).orderBy("k").collect()
    assert [(r.act, r.article, r.paragraph, r.text) for r in rows] == [("L-41-2014", "7", None, "l'art. 3 cambia."), ("DL-156-2011", "2", "4", "nuovo."), ("DD-30-2018", None, None, "altro")]


def test_spans_near_each_other_equal_all_pairs(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.randint(0, 3), s, s + rng.randint(1, 60)) for s in (rng.randint(0, 3_000) for _ in range(n))]
    a, b = spans(120), spans(120)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s int, e int")
    got = sorted((r.k, r.s, r.e, r.b_s, r.b_e) for r in cs.near(frame(a), frame(b), ["k"]).collect())
    want = sorted((k, s, e, u, v) for k, s, e in a for q, u, v in b if k == q and (0 < u - e <= 160 or 0 < s - v <= 160))
    assert got == want and len(want) > 100


def test_evidence_goes_out_and_comes_back(spark, tmp_path):
    t = tables(spark)
    body = [("(Aggiornato al 27 febbraio 2026)", 57, []), ("Art. 3", 57, [1]), ("[ABROGATO]", 57, []), ("Art. 26", 57, [2]), ("[ABROGATO]", 57, []), ("Art. 77", 57, []), ("[ABROGATO]", 57, []), ("Art. 9", 57, []), ("Resta.", 57, [])]
    notes = ["1 Modifiche legislative Legge n.64/2025, Articolo 2: l'articolo 3 è abrogato.", "2 Modifiche legislative Legge n.64/2025: riscritto."]
    read = cs.read(spark.createDataFrame([("x", i, *r) for i, r in enumerate(body)], "doc string, line int, text string, x int, refs array<int>"), spark.createDataFrame([("x", i, n) for i, n in enumerate(notes)], "doc string, line int, text string"))
    acts = spark.createDataFrame([("x", "L-44-2015")], "doc string, act_id string")
    cs.evidence(read, acts, "testo coordinato").write.json(str(tmp_path / "e"))
    files = cs.read_evidence(spark, str(tmp_path / "e"))
    one = files.collect()
    assert len(one) == 1 and one[0].aggiornatoAl == "27 febbraio 2026" and [(a.articolo, a.fonti, a.articoloId) for a in one[0].articoli] == [("3", ["L-64-2025"], "L-44-2015/art-3"), ("26", [], "L-44-2015/art-26"), ("77", [], "L-44-2015/art-77")]
    repeals, counters = cs.evidenced_repeals(files, t["articles"])
    assert sorted((r.src_act or "", r.article_id) for r in repeals.collect()) == [("", "L-44-2015/art-26"), ("L-64-2025", "L-44-2015/art-3")]
    assert {r.clause for r in repeals.collect()} == {"[ABROGATO] nel testo coordinato, aggiornato al 27 febbraio 2026"}
    assert [tuple(r) for r in counters.collect()] == [("L-44-2015", 2, 1, 1)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.json").write_text(json.dumps({"norma": "L-1-1900", "fonte": "f", "aggiornatoAl": "oggi", "articoli": []}, indent=1))
    repeals, counters = cs.evidenced_repeals(cs.read_evidence(spark, str(tmp_path / "more")), t["articles"])
    assert repeals.count() == 0 and counters.count() == 0
    edges = cs.amendments(t, read, acts, "consolidated")
    assert schema.conformed(edges, "cites_article").columns == edges.columns and sorted((r.par_id, r.dst_article_id) for r in edges.select(F.col("par_id"), "dst_article_id").collect()) == [("L-64-2025/art-2/c-1", "L-44-2015/art-3")]
