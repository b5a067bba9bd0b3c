"""Identifiers of acts, articles and paragraphs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The prefix of each type of act, by its name in lower case with hyphens without spaces around them.
PREFIXES = {
    "legge": "L",
    "legge ordinaria": "L",
    "legge orginaria": "L",
    "legge costituzionale": "LC",
    "legge qualificata": "LQ",
    "legge di revisione costituzionale": "LRC",
    "legge revisione costituzionale": "LRC",
    "decreto": "D",
    "decreto delegato": "DD",
    "decreto delagato": "DD",
    "decreto delega5to": "DD",
    "decreto legge": "DL",
    "decreto-legge": "DL",
    "decreto-legga": "DL",
    "decreto reggenziale": "DR",
    "decreto consiliare": "DC",
    "decreto consigliare": "DC",
    "decreto conisliare": "DC",
    "regolamento": "R",
    "notifica": "N",
    "statuto": "S",
    "ordinanza": "O",
    "verbale": "V",
    "errata corrige": "EC",
}
# The label of each prefix.
LABELS = {
    "L": "Legge",
    "LC": "LeggeCostituzionale",
    "LQ": "LeggeQualificata",
    "LRC": "LeggeRevisioneCostituzionale",
    "D": "Decreto",
    "DD": "DecretoDelegato",
    "DL": "DecretoLegge",
    "DR": "DecretoReggenziale",
    "DC": "DecretoConsiliare",
    "R": "Regolamento",
    "N": "Notifica",
    "S": "Statuto",
    "O": "Ordinanza",
    "V": "Verbale",
    "EC": "ErrataCorrige",
}
# Words that still tell the type of an unknown name, tried in this order.
FALLBACKS = (
    (("decreto",), ("legge", "legga"), "DL"),
    (("decreto",), ("consiliare", "consigliare", "conisliare"), "DC"),
    (("decreto",), ("delegato", "delagato", "delega"), "DD"),
    (("decreto",), ("reggenziale",), "DR"),
    (("",), ("legge", "ordinaria"), "L"),
    (("",), ("decreto", "decreti"), "D"),
)
DASHES = r"[‐-―­－\u0096�−]"
FIRST_YEAR, LAST_YEAR = 1600, 2100
COLLISION = "~"


def type_key(kind: Column) -> Column:
    """A type's name for comparison: lower case, one kind of dash without spaces around it, single spaces."""
    low = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, DASHES, "-"), r"\s+", " "), r"\s*-\s*", "-")


def prefix(kind: Column) -> Column:
    """The prefix of a type; X for one that nothing tells."""
    key = type_key(kind)
    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    out = F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.replace(key, F.lit("-"), F.lit(" "))))
    rest = F.lit(None).cast("string")
    for needed, one_of, p in reversed(FALLBACKS):
        has = F.contains(key, F.lit(needed[0])) & key.rlike("|".join(one_of))
        rest = F.when(has, p).otherwise(rest)
    return F.coalesce(out, rest, F.lit("X"))


def act_id(kind: Column, number: Column, year: Column) -> Column:
    """PREFIX-number-year."""
    return F.concat_ws("-", prefix(kind), number.cast("string"), year.cast("string"))


def label(kind: Column) -> Column:
    """The label of a type; letters and digits of its title for an unknown one, null without any."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    own = F.regexp_replace(F.initcap(F.regexp_replace(F.coalesce(kind, F.lit("")), r"[^0-9A-Za-z]+", " ")), " ", "")
    return F.coalesce(F.try_element_at(known, prefix(kind)), F.nullif(own, F.lit("")))


def repaired_extremes(number: Column, year: Column, date: Column) -> tuple[Column, Column]:
    """(number, year) as text where a card swapped them or lacks the year.

    They are swapped if the year is none and the number looks like one: it is plausible, or of four digits and within 300 of the date's year.
    A year that is still none is taken from the date. What cannot be read stays as it is.
    """
    n, y = F.trim(number.cast("string")).try_cast("int"), F.trim(year.cast("string")).try_cast("int")
    dated = F.substring(date.cast("string"), 1, 4).try_cast("int")
    fine = lambda c: F.coalesce(c.between(FIRST_YEAR, LAST_YEAR), F.lit(False))
    near = F.coalesce(n.between(1000, 2999) & (F.abs(n - dated) <= 300), F.lit(False))
    swap = ~fine(y) & (fine(n) | near)
    n2, y2 = F.when(swap, y).otherwise(n), F.when(swap, n).otherwise(y)
    y3 = F.when(~fine(y2) & dated.isNotNull(), dated).otherwise(y2)
    return F.coalesce(n2.cast("string"), number.cast("string")), F.coalesce(y3.cast("string"), year.cast("string"))


def canonical(act: Column) -> Column:
    """The id that citations name: without the qualifier of a collision."""
    return F.split_part(F.coalesce(act, F.lit("")), F.lit(COLLISION), F.lit(1))


def qualified(cards: DataFrame, base: str = "base_id", card: str = "card_id") -> DataFrame:
    """`cards` with `id`: the first card of a contested id has it plain, the others add their card's id. Ids that are given already keep their holder."""
    order = Window.partitionBy(base).orderBy(F.length(F.col(card).cast("string")), card)
    first = F.row_number().over(order) == 1
    return cards.withColumn("id", F.when(first, F.col(base)).otherwise(F.concat(F.col(base), F.lit(COLLISION), F.col(card).cast("string"))))


def article_id(act: Column, number: Column) -> Column:
    return F.concat(act, F.lit("/art-"), F.replace(number, F.lit(" "), F.lit("-")))


def paragraph_id(article: Column, number: Column) -> Column:
    return F.concat(article, F.lit("/c-"), number)


def article_key(number: Column) -> Column:
    """An article's number for comparison: no spaces, dots or dashes, lower case."""
    return F.lower(F.regexp_replace(number, r"[\s.–-]+", ""))


def readable(act: Column) -> Column:
    """"DD-1-2018" → "D.D. 1/2018"; ids of another form stay."""
    letters = F.regexp_replace(F.split_part(act, F.lit("-"), F.lit(1)), "(.)", "$1.")
    m = [F.regexp_extract(act, r"^([A-Z]+)-([^-]+)-([0-9]{4})(?:~.*)?$", k) for k in (2, 3)]
    return F.when(m[0] != "", F.concat(letters, F.lit(" "), m[0], F.lit("/"), m[1])).otherwise(act)
