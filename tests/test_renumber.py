import random
import re

import pytest

from actweave import schema
from actweave.operators import renumber as rn
from tests.hand import tables

INTRO = re.compile(r"\bseguent[ei]\b|così sostituit|è aggiunt", re.I)


def open_after(text, n=0):
    for c in text.replace("''", '"'):
        if c in "“«―":
            n += 1
        elif c in "”»‖":
            n = max(0, n - 1)
        elif c == '"':
            n = n - 1 if n else 1
    return n


def head(number):
    m = re.match(r"\d+", number)
    return int(m[0]) if m else None


class Par:
    def __init__(self, key, number, text, implicit):
        self.id, self.number, self.text, self.implicit = key, number, text, implicit
        self.absorbed, self.part, self.old, self.odd = [], None, None, False

    @property
    def plain(self):
        return not self.implicit and head(self.number) is not None and self.number.strip() == str(head(self.number))


def end_of_quotation(body, i):
    n = open_after(body[i].text)
    for j in range(i + 1, min(len(body), i + 61)):
        n = open_after(body[j].text, n)
        if n == 0:
            return j
    j = i + 1
    if not body[j].plain:
        return None
    while j + 1 < len(body):
        nxt, here = body[j + 1], head(body[j].number)
        bis = re.fullmatch(r"(\d+)\s*[-\s]?\s*(?:bis|ter)", nxt.number)
        if nxt.implicit or not (nxt.plain and head(nxt.number) == here + 1 or bis and int(bis[1]) == here):
            break
        j += 1
    return j if j + 1 == len(body) or head(body[j + 1].number) == head(body[i].number) + 1 else None


def plain_article(name, rubric, rows):
    """(rubric, [(id, origin, number, part, number_original, implicit, anomalous, text, absorbed)])"""
    pars = []
    for p in (Par(*r) for r in rows):
        if pars and not p.implicit and p.number.strip() == "0":
            pars[-1].text = f"{pars[-1].text} {p.text}".strip()
            pars[-1].absorbed.append(p.id)
        else:
            pars.append(p)
    if len(pars) > 1:
        pars = [p for p in pars if not re.fullmatch(r"\d{1,4}", p.text.strip())] or pars
    if len(pars) > 1 and not (rubric or "").strip():
        a, b = pars[:2]
        t = a.text.strip()
        bad = len(t) > 120 or not re.search("[A-Za-zÀ-ÿ]{3}", t) or re.search(r"[.;:,]$", t) or INTRO.search(t) or open_after(t) or re.match(r"(?:[a-z]\)|[a-z]\.\s|\d+\)|[-•])", t, re.I)
        if a.implicit and not b.implicit and b.number == "1" and not bad:
            rubric, pars = t, pars[1:]
    cut = len(pars)
    for k in range(len(pars) - 1):
        if re.search("Dat[oa] dalla Nostra Residenza", pars[k].text) or (re.search(r"\bAllegat[oi]\b[^.;:]{0,80}$|\bArticle 1\b", pars[k].text) and not pars[k + 1].implicit and pars[k + 1].number.strip() == "1"):
            cut = k + 1
            break
    body, holder = pars[:cut], {}
    i = 0
    while i + 1 < len(body):
        p, end = body[i], None
        mine, first = head(p.number), head(body[i + 1].number)
        if open_after(p.text) and (INTRO.search(p.text) or p.text.lstrip()[:1] in ("“", "«", '"', "―") or p.text.lstrip().startswith("''")) and mine is not None and first is not None and first <= mine:
            end = end_of_quotation(body, i)
        if end is not None:
            holder |= {j: (i, "capoverso") for j in range(i + 1, end + 1)}
        i = i + 1 if end is None else end + 1
    used = set(holder) | {h for h, _ in holder.values()}
    for i, p in enumerate(body):
        if i in used or not re.search(r":\s*\d{0,3}\s*$", p.text):
            continue
        root = holder[i][0] if i in holder else i
        own, k = head(body[root].number), 1
        while own is not None and i + k < len(body) and i + k not in used and not body[i + k].implicit and body[i + k].number.strip() == str(k):
            holder[i + k] = (root, "punto")
            if body[i + k].text.rstrip().endswith(".") and i + k + 1 < len(body) and head(body[i + k + 1].number) == own + 1:
                break
            k += 1
    names, seen, ids, out, said, count = {}, {}, set(), [], None, {}
    for k, p in enumerate(pars):
        odd, implicit, old = False, False, p.number
        if k >= cut:
            part, number = "allegato", f"all{k - cut + 1}"
            base = number
        elif k in holder:
            h, part = holder[k]
            count[h, part] = count.get((h, part), 0) + 1
            sign = {"capoverso": "cap", "punto": "p"}[part]
            number, base = f"{names[h]}.{sign}{count[h, part]}", f"{names[h]}-{sign}{count[h, part]}"
        else:
            own = str(1 + sum(seen.values())) if p.implicit else p.number
            whole = lambda x: int(x) if x is not None and re.fullmatch(r"\s*\d+\s*", x) else None
            odd = not p.implicit and None not in (whole(own), whole(said)) and whole(own) <= whole(said)
            said, seen[own] = own, seen.get(own, 0) + 1
            if seen[own] > 1:
                part, number, old, odd = "ripetizione", f"{own}.rip{seen[own]}", own, True
            else:
                part, number, old, implicit = None, own, None, p.implicit
            names[k], base = number, number.replace(".", "-")
        new, n = f"{name}/c-{base}", 1
        while new in ids:
            n += 1
            new = f"{name}/c-{base}-{n}"
        ids.add(new)
        out.append((new, p.id, number, part, old, implicit, odd, p.text, p.absorbed))
    return rubric, out


TEXTS = ["Testo semplice.", "Il presente Protocollo", "Denuncia", "12", "È così sostituito: “1. Uno", "fine del testo”", "fine”; “Art. 54", "posizionati in modo da essere:", "voce;", "voce:", "voce finale.", "essere: 5", "“Art. 120 bis", "''citato", "citato''", '"Aperto', 'chiuso"', "Dato dalla Nostra Residenza, addì", "Allegato A", "come segue Article 1 of", "le seguenti parole «così» e", " a) voce", "à" * 130, "«»”", ""]


def random_article(rng, n):
    rows, k = [], 0
    for j in range(n):
        k = rng.choice([k + 1, k + 1, k + 1, 1, 1, k, rng.randint(1, 5)])
        number = str(k) if rng.random() < 0.9 else rng.choice(["0", f"{k}-bis", f"{k} ter", "x", "01", ""])
        implicit = rng.random() < (0.5 if j == 0 else 0.06)
        if rng.random() < 0.35:
            text = "Testo semplice."
        else:
            text = rng.choice(TEXTS)
        rows.append((f"o{j}", number, text, implicit))
    return rows


def frames(spark, arts):
    pars = [(f"{a}/{o}", a, "L-1-2000", n, t, j, i) for a, _, rows in arts for j, (o, n, t, i) in enumerate(rows)]
    p = spark.createDataFrame(pars, "id string, article_id string, act_id string, number string, text string, ord int, implicit boolean")
    return schema.conformed(p, "paragraphs"), schema.conformed(spark.createDataFrame([(a, "L-1-2000", r) for a, r, _ in arts], "id string, act_id string, rubric string"), "articles")


def kept_rows(plan):
    out = {}
    for r in sorted(plan.filter("what = 'kept'").collect(), key=lambda r: r.ord):
        out.setdefault(r.article_id, []).append((r.new_id, r.id.split("/")[-1], r.number, r.part, r.number_original, r.implicit, r.anomalous, r.text, [x.split("/")[-1] for x in r.absorbed]))
    return out


def test_plan_equals_plain_version_and_changes_nothing_twice(spark):
    rng = random.Random(13)
    arts = [(f"A{k}", rng.choice([None, "", "Rubrica"]), random_article(rng, rng.choice([1, 2, 3, 5, 8, 14, 30]))) for k in range(500)]
    arts += [("long", None, [("o0", "1", "È così sostituito: “1.", False)] + [(f"o{j}", str(j), "riga", False) for j in range(1, 60)] + [("o60", "60", "fine”", False), ("o61", "2", "Segue.", False)])]
    arts += [("far", None, [("o0", "1", "È così sostituito: “1.", False)] + [(f"o{j}", str(j), "riga", False) for j in range(1, 61)] + [("o61", "62", "fine”", False)])]
    p, a = frames(spark, arts)
    plan = rn.planned(p, a)
    got, want = kept_rows(plan), {n: plain_article(n, r, rows) for n, r, rows in arts}
    for n, _, rows in arts:
        assert got[n] == want[n][1], (rows, n)
    parts = [x[3] for _, rows in want.values() for x in rows]
    assert min(parts.count(k) for k in ("capoverso", "punto", "allegato", "ripetizione")) > 50 and len(got["long"]) == 62
    new_p, new_a = rn.renumbered(p, a)
    assert {r.id: r.rubric for r in new_a.collect()} == {n: want[n][0] for n, _, _ in arts}
    again = rn.planned(new_p, new_a)
    cols = ["new_id", "number", "part", "number_original", "text"]
    settled = {n for n, r, rows in arts if plain_article(n, *second(n, want[n]))[1:] == ([(x[0], x[0].split("/")[-1], *x[2:8], []) for x in want[n][1]],)}
    assert len(settled) > 400
    one = {tuple(r) for r in again.filter(rn.F.col("article_id").isin(*settled)).select("id", *cols).collect()}
    assert one == {(r.id, r.id, r.number, r.part, r.number_original, r.text) for r in new_p.filter(rn.F.col("article_id").isin(*settled)).collect()}


def second(name, done):
    """The rows of an outcome as they are read again."""
    rubric, rows = done
    return rubric, [(x[0].split("/")[-1], (x[4] or x[2]) if x[3] else x[2], x[7], x[5]) for x in rows]


@pytest.fixture(scope="module")
def corpus(spark):
    t = tables(spark)
    broken = [("o1", "1", "Requisiti", True), ("o2", "1", "È così sostituito: “1. Uno", False), ("o3", "1", "fine”.", False), ("o4", "2", "sanzione da L.10, vedi Legge n.158/2020", False), ("o5", "0", "00 0 a L.50 e Legge n.9/1999", False), ("o6", "3", "17", False)]
    rows = [(f"L-9-1999/art-2/{o}", "L-9-1999/art-2", "L-9-1999", n, x, k, i) for k, (o, n, x, i) in enumerate(broken)]
    twice = [("L-9-1999/art-3/c-1", "L-9-1999/art-3", "L-9-1999", "1", x, k, False) for k, x in enumerate(["Vedi Legge n.44/2015.", "Resta la Legge n.158/2020."])]
    new = spark.createDataFrame(rows + twice, "id string, article_id string, act_id string, number string, text string, ord int, implicit boolean")
    vector = rn.F.array(rn.F.lit(1.0).cast("float"))
    t["paragraphs"] = t["paragraphs"].unionByName(schema.conformed(new.withColumn("embedding", vector), "paragraphs"))
    arts = spark.createDataFrame([(f"L-9-1999/art-{k}", "L-9-1999", str(k), None, float(k)) for k in (2, 3)], "id string, act_id string, number string, rubric string, ord double")
    t["articles"] = t["articles"].unionByName(schema.conformed(arts, "articles"))
    edges = [(f"L-9-1999/art-2/{o}", "paragraph", "L-9-1999", d, "x", None) for o, d in (("o1", "L-44-2015"), ("o3", "L-44-2015"), ("o4", "L-158-2020"), ("o5", "L-30-1977"))]
    edges += [("L-9-1999/art-3/c-1", "paragraph", "L-9-1999", "L-30-1977", "x", None)]
    cites = spark.createDataFrame(edges, "src_id string, src_kind string, src_act_id string, dst_act_id string, cite_text string, cited_article string")
    t["cites"] = t["cites"].unionByName(schema.conformed(cites, "cites"))
    t["repeals"] = schema.conformed(spark.createDataFrame([("L-9-1999", "L-30-1977", "L-9-1999/art-2/o6")], "src_act string, dst_act string, par_id string"), "repeals")
    return t


def test_migration(corpus):
    out, counters = rn.migrated(corpus)
    n = {r.what: r.n for r in counters.collect()}
    assert (n["articles"], n["headings"], n["page numbers"], n["fragments"], n["capoverso: paragraphs"], n["articles rebuilt"], n["articles out of step"]) == (2, 1, 1, 1, 1, 1, 0)
    pars = {r.id: r for r in out["paragraphs"].collect()}
    own = sorted(k for k in pars if k.startswith("L-9-1999/art-2"))
    assert own == [f"L-9-1999/art-2/c-{x}" for x in ("1", "1-cap1", "2")]
    assert pars["L-9-1999/art-2/c-2"].text == "sanzione da L.10, vedi Legge n.158/2020 00 0 a L.50 e Legge n.9/1999"
    assert pars["L-9-1999/art-2/c-2"].embedding is None and pars["L-9-1999/art-2/c-1-cap1"].embedding == [1.0]
    assert sorted(k for k in pars if k.startswith("L-9-1999/art-3")) == ["L-9-1999/art-3/c-1", "L-9-1999/art-3/c-1-rip2"]
    assert {r.id: r.rubric for r in out["articles"].collect()}["L-9-1999/art-2"] == "Requisiti"
    cites = {(r.src_id.split("/", 1)[1], r.dst_act_id) for r in out["cites"].collect() if r.src_id.startswith("L-9-1999/")}
    assert cites == {("art-2/c-1-cap1", "L-44-2015"), ("art-2/c-2", "L-158-2020"), ("art-3/c-1", "L-44-2015"), ("art-3/c-1-rip2", "L-158-2020")}
    assert [r.par_id for r in out["repeals"].collect()] == [None]
    untouched = corpus["cites"].count() - 5
    assert out["cites"].count() == untouched + 4 and schema.violations(out).filter("check like 'doubled%'").count() == 0
    _, counters = rn.migrated(out)
    assert {r.what: r.n for r in counters.collect()}["articles"] == 0


def test_migration_leaves_what_is_out_of_step_or_not_loaded(corpus):
    parsed = corpus["paragraphs"].withColumn("text", rn.F.when(rn.F.col("id") == "L-9-1999/art-2/o2", "anders").otherwise(rn.F.col("text")))
    out, counters = rn.migrated(corpus, parsed)
    assert {r.what: r.n for r in counters.collect()}["articles out of step"] == 1
    assert out["paragraphs"].filter("id = 'L-9-1999/art-2/o1'").count() == 1
    closed = corpus | {"acts": corpus["acts"].withColumn("loaded", rn.F.lit(False))}
    assert rn.migrated(closed)[0]["paragraphs"].exceptAll(corpus["paragraphs"]).count() == 0
