"""A small corpus written by hand, with the results that it must give."""

import datetime

D = datetime.date


def act(i, title="", date=None, loaded=True, kind="Legge", **more):
    p, n, y = i.split("~")[0].split("-")
    return {"id": i, "prefix": p, "type": kind, "number": n, "number_int": int(n), "year": int(y), "act_date": date, "title": title, "loaded": loaded, **more}


LONG = "Una disposizione molto lunga che continua. " * 160
ACTS = [
    act("L-44-2015", "Edilizia sovvenzionata", D(2015, 3, 31), url_doc="u/44"),
    act("L-64-2025", "Modifiche alla Legge n.44/2015", D(2025, 5, 2)),
    act("DD-52-2026", "Imposte per la prima casa", D(2026, 1, 9), kind="Decreto Delegato"),
    act("L-158-2020", "Imposte per la prima casa, disposizioni", D(2020, 10, 1)),
    act("L-9-1999", "Norme sul lavoro", D(1999, 2, 2), repealed=True, repealed_by=["L-158-2020"]),
    act("DD-7-2018", "Testo coordinato della Legge 31 marzo 2015 n.44", D(2018, 7, 7), kind="Decreto Delegato"),
    act("D-66-1983", "Atto doppio", D(1983, 6, 6), kind="Decreto"),
    act("D-66-1983~17012616", "Atto doppio", D(1983, 6, 6), kind="Decreto"),
    act("L-30-1977", loaded=False),
]
ARTICLES = [
    ("L-44-2015", "3", "Requisiti soggettivi dei richiedenti", 1.0),
    ("L-44-2015", "26", "Commissione", 2.0),
    ("L-64-2025", "2", "Modifiche", 1.0),
    ("L-64-2025", "9", "Norma finale", 2.0),
    ("DD-52-2026", "1", "Disposizioni in materia di imposte per la prima casa", 1.0),
    ("L-158-2020", "4", "Disposizioni in materia di imposte per la prima casa", 1.0),
    ("L-9-1999", "1", "Orario", 1.0),
    ("DD-7-2018", "3", "Requisiti soggettivi dei richiedenti", 1.0),
    ("D-66-1983", "1", "Uno", 1.0),
    ("D-66-1983~17012616", "1", "Uno", 1.0),
]
TEXTS = {
    ("L-44-2015", "3"): ["Possono chiedere il mutuo i soggetti residenti di età inferiore a trentacinque anni.", "Il richiedente non deve possedere altra abitazione."],
    ("L-44-2015", "26"): ["La Commissione per l'edilizia esamina le domande.", LONG],
    ("L-64-2025", "2"): ["Il comma 1 dell'articolo 3 della Legge n.44/2015 è così sostituito: “1. Possono chiedere il mutuo i soggetti di età inferiore a quaranta anni.”"],
    ("L-64-2025", "9"): ["Resta fermo quanto previsto dall'articolo 26 della Legge n.44/2015."],
    ("DD-52-2026", "1"): ["L'imposta per la prima casa è ridotta alla metà per il primo anno di residenza."],
    ("L-158-2020", "4"): ["L'imposta per la prima casa è ridotta di un terzo per il primo anno di residenza.", "È abrogata la Legge 2 febbraio 1999 n.9."],
    ("L-9-1999", "1"): ["L'orario di lavoro è di quaranta ore."],
    ("DD-7-2018", "3"): ["Possono chiedere il mutuo i soggetti residenti di età inferiore a trentacinque anni."],
    ("D-66-1983", "1"): ["Testo identico di un atto che ha due schede, lungo abbastanza. " * 9],
    ("D-66-1983~17012616", "1"): ["Testo identico di un atto che ha due schede, lungo abbastanza. " * 9],
}


def tables(spark):
    from pyspark.sql import functions as F

    from actweave import schema
    from actweave.operators import chunks

    def frame(rows, table):
        wanted = spark.createDataFrame([], schema.TABLES[table]).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in wanted) for r in rows], wanted)

    arts, pars = [], []
    for a, n, rubric, o in ARTICLES:
        i = f"{a}/art-{n}"
        arts.append({"id": i, "act_id": a, "number": n, "rubric": rubric, "ord": o, "url_doc": "u/own" if n == "26" else None})
        for k, text in enumerate(TEXTS[a, n], 1):
            v = [float(text.count(c)) for c in "aeioulmnrst"]
            pars.append({"id": f"{i}/c-{k}", "article_id": i, "act_id": a, "number": str(k), "text": text, "ord": k, "embedding": v})
    cites = [
        {"src_id": "L-64-2025/art-2/c-1", "src_kind": "paragraph", "src_act_id": "L-64-2025", "dst_act_id": "L-44-2015", "cite_text": "Legge n.44/2015", "cited_article": "3", "cited_par": "1"},
        {"src_id": "L-64-2025/art-9/c-1", "src_kind": "paragraph", "src_act_id": "L-64-2025", "dst_act_id": "L-44-2015", "cite_text": "Legge n.44/2015", "cited_article": "26"},
        {"src_id": "L-44-2015", "src_kind": "act", "src_act_id": "L-44-2015", "dst_act_id": "L-30-1977", "cite_text": "Legge n.30/1977", "origin": "preamble"},
        {"src_id": "L-158-2020/art-4/c-2", "src_kind": "paragraph", "src_act_id": "L-158-2020", "dst_act_id": "L-9-1999", "cite_text": "Legge 2 febbraio 1999 n.9"},
    ]
    to = [{"par_id": "L-64-2025/art-2/c-1", "dst_article_id": "L-44-2015/art-3"}, {"par_id": "L-64-2025/art-9/c-1", "dst_article_id": "L-44-2015/art-26"}]
    t = {"acts": frame(ACTS, "acts"), "articles": frame(arts, "articles"), "paragraphs": frame(pars, "paragraphs"), "cites": frame(cites, "cites"), "cites_article": frame(to, "cites_article")}
    _, new = chunks.refreshed(t["paragraphs"], schema.empty(spark, "chunks"))
    t["chunks"] = schema.conformed(new.withColumn("embedding", F.lit(None)), "chunks")
    return {n: x.cache() for n, x in t.items()} | {n: schema.empty(spark, n) for n in ("repeals", "twins")}
