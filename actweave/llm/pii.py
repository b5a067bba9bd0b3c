"""Personal data by weak supervision, in DataFrame expressions only.

Spans that the four base patterns find always stay. Looser patterns propose candidates; on each candidate five labelers vote for,
against or not at all (a strict pattern, a gazetteer before it, words that speak against it, its make-up, and base spans in the same
text). The counts of the vote patterns over all documents, a bounded table, feed expectation-maximisation, which estimates how
reliable each labeler is for each kind. A logistic span classifier is fitted to the resulting probabilities and decides on candidates.

Matches are found by marking them in one regexp_replace and splitting at the marks: odd parts are matches, and running totals of
the parts' lengths are positions in code points. Nothing grows with the square of the matches in a text. Patterns are written so that they neither backtrack over long
runs nor nest: what separates digits or labels is first turned into one control character.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
JOIN, MARK, OTHER = "\x01", "\x02", "\x03"
LOCAL = r"A-Za-z0-9._%+\x01-"
PATTERNS = {
    # a match cannot start inside a run of these characters, save where the match before it ended
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])[0-9](?:\x01?[0-9]){12,18}(?![0-9\x01])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": PATTERNS["card"],
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?i)(?:password|passwd|token|secret|api[_-]?key)[\x22\x27 ]{0,2}[=:] ?[\x22\x27]?[A-Za-z0-9_+/=.-]{8,}+",
}
#: What the labelers know, by kind: a strict form, words before a true span, words before a false one.
STRICT = {
    "email": r"(?i)dot[\])] ?(?:com|org|net|edu|gov|it|de|fr|es)$|@.*",
    "ip": r".*",
    "card": r"^[3-6].*",
    "phone": r"^(?:\+.*|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})$",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z]).{16,}$",
}
BEFORE = {
    "email": r"(?i)(?:mail|contact|write|reach|author|from|to)\W*\w*\W*$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from|client)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|amex|payment|pay)\W*\w*\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell|contact|whatsapp)\W*\w*\W*$",
    "secret": r".*",
}
AGAINST = r"(?i)(?:version|isbn|issn|page|section|article|art|chapter|no|nr|order|invoice|figure|table|total|sum)\W*$"
LABELERS = ("strict", "gazetteer", "against", "makeup", "company")
CONTEXT = 24


SPAN = "array<struct<s:int,e:int,m:string,b:string>>"
#: Texts are cut into blocks of so many characters where parts of them are taken by position.
BLOCK = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array by an associative operation: each round joins totals twice as far apart, so long arrays take few passes."""

    def further(a: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        return F.concat(F.slice(a, F.lit(1), step), F.zip_with(F.slice(a, F.lit(1), F.size(a) - step), F.slice(a, step + 1, F.size(a) - step), op))

    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < F.size(values)), values, further)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, b>> of all matches: start, end, the match, and what stands before it."""

    def of(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                end = F.get(ends, i)
                before = F.when(i % 2 == 1, F.right(F.get(parts, i - 1), F.lit(CONTEXT)))
                return F.struct((end - F.length(x)).cast("int").alias("s"), end.cast("int").alias("e"), x.alias("m"), before.alias("b"))

            return F.filter(F.transform(parts, span), lambda x: x["b"].isNotNull())

        return F.when(F.size(parts) > 1, _let(_scan(F.transform(parts, lambda x: F.length(x)), lambda a, b: a + b), placed)).otherwise(_none())

    return _let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), of).cast(SPAN)


def _none() -> Column:
    return F.array().cast(SPAN)


def _free(candidates: Column, taken: Column) -> Column:
    """Those of `candidates` (which don't overlap each other) that overlap none of `taken`."""

    def point(at: Column, kind: int, reach: Column, c: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), reach.alias("reach"), c.alias("c"))

    # what starts before a candidate's end, and how far the furthest of it goes
    asked = F.transform(candidates, lambda c: point(c["e"], 0, F.lit(-1), c))
    there = F.transform(taken, lambda t: point(t["s"], 1, t["e"], F.lit(None).cast("struct<s:int,e:int,m:string,b:string>")))

    def kept(points: Column) -> Column:
        far = _scan(F.transform(points, lambda x: x["reach"]), lambda a, b: F.greatest(a, b))
        both = F.zip_with(points, far, lambda x, r: F.struct(x["kind"].alias("kind"), x["c"].alias("c"), r.alias("r")))
        return F.transform(F.filter(both, lambda x: (x["kind"] == 0) & (x["r"] <= x["c"]["s"])), lambda x: x["c"])

    return F.when(F.size(candidates) == 0, _none()).when(F.size(taken) == 0, candidates).otherwise(_let(F.array_sort(F.concat(asked, there)), kept))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.reverse(_digits(m))
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def step(a: Column, i: Column) -> Column:
        digit = F.substring(d, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, digit).otherwise(F.element_at(doubled, digit + 1))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _small_parts(m: Column) -> Column:
    """Whether every dotted part is at most 255, whatever zeros lead it."""

    def ok(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\.", -1), ok)


def _phone_digits(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def with_spans(docs: DataFrame) -> DataFrame:
    """`docs` with the columns base_<kind> and loose_<kind>: the base spans and the candidates in `text`, over its whole length."""
    x = F.translate(F.coalesce("text", F.lit("")), JOIN + MARK, OTHER + OTHER)
    dots = F.regexp_replace(x, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    joined = F.regexp_replace(x, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
    long_number = x.rlike(r"[0-9](?:[ -]?[0-9]){12}")
    numbers = f"array<struct<{SPAN[len('array<struct<'):-2]},ok:boolean>>"

    def checked(s: Column) -> Column:
        return F.struct(s["s"].alias("s"), s["e"].alias("e"), s["m"].alias("m"), s["b"].alias("b"), luhn(s["m"]).alias("ok"))

    found = F.struct(
        F.when(x.contains("@"), _spans(dots, PATTERNS["email"])).otherwise(_none()).alias("email"),
        F.when(x.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(_spans(x, PATTERNS["ip"]), lambda s: _small_parts(s["m"]))).otherwise(_none()).alias("ip"),
        F.when(long_number, F.transform(_spans(joined, PATTERNS["card"]), checked)).otherwise(F.array().cast(numbers)).alias("numbers"),
        F.when(x.contains("+"), F.filter(_spans(x, PATTERNS["phone"]), lambda s: _phone_digits(s["m"]))).otherwise(_none()).alias("phone"),
        F.when(x.rlike(r"[\[(](?:at|AT)[\])]"), _spans(x, LOOSE["email"])).otherwise(_none()).alias("loose_email"),
        F.when(x.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"), _spans(x, LOOSE["ip"])).otherwise(_none()).alias("loose_ip"),
        F.when(x.rlike(r"[0-9][ .)-]{1,2}[0-9]{3,4}[ .-][0-9]{3}"), _spans(x, LOOSE["phone"])).otherwise(_none()).alias("loose_phone"),
        F.when((x.contains("=") | x.contains(":")) & x.rlike(r"(?i)(?:password|passwd|token|secret|key)[\x22\x27 ]{0,2}[=:]"), _spans(x, LOOSE["secret"])).otherwise(_none()).alias("loose_secret"),
    )

    def sorted_out(f: Column) -> Column:
        card = F.filter(f["numbers"], lambda s: s["ok"])
        base = {"email": f["email"], "ip": f["ip"], "card": F.transform(card, _bare), "phone": f["phone"]}
        loose = {k: f[f"loose_{k}"] for k in KINDS if k != "card"} | {"card": F.transform(F.filter(f["numbers"], lambda s: ~s["ok"]), _bare)}

        def free(taken: Column) -> Column:
            return F.struct(*[base[k].alias(f"base_{k}") for k in BASE], *[_free(loose[k], taken).alias(f"loose_{k}") for k in KINDS])

        return _let(F.concat(*[F.transform(base[k], lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))) for k in BASE]), free)

    rows = docs.withColumn("found", _let(found, sorted_out))
    return rows.select(*docs.columns, "found.*")


def _bare(s: Column) -> Column:
    return F.struct(s["s"].alias("s"), s["e"].alias("e"), s["m"].alias("m"), s["b"].alias("b"))


def votes(kind: str, span: Column, company: Column) -> list[Column]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing."""
    m, b = span["m"], span["b"]
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[^0-9A-Za-z]", ""), "")))
    return [
        F.when(m.rlike(STRICT[kind]), 1).otherwise(-1),
        F.when(b.rlike(BEFORE[kind]), 1).otherwise(0),
        F.when(b.rlike(AGAINST), -1).otherwise(0),
        F.when(distinct >= 5, 1).when(distinct <= 2, -1).otherwise(0),
        F.when(company > 0, 1).otherwise(0),
    ]


def _code(kind: str, span: Column, company: Column) -> Column:
    """The votes as one number in base 3."""
    code = F.lit(0)
    for v in votes(kind, span, company):
        code = code * 3 + v + 1
    return code


def _company(kind: str) -> Column:
    """Base spans of other kinds in the same text."""
    others = [F.size(f"base_{k}") for k in BASE if k != kind]
    total = others[0]
    for x in others[1:]:
        total = total + x
    return total


def _coded(column: str, kind: str, base: bool) -> Column:
    return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), _code(kind, s, _company(kind)).alias("code")))


def vote_counts(spans: DataFrame) -> list[tuple[str, bool, int, int]]:
    """(kind, is base, code of the votes, spans with them) over all documents: at most 2 x 5 x 3**5 rows."""
    parts = []
    for kind in KINDS:
        for name, base in (("base", True), ("loose", False)):
            if not base or kind in BASE:
                parts.append(_coded(f"{name}_{kind}", kind, base))
    rows = spans.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.kind", "x.base", "x.code").count()
    return sorted((r[0], r[1], r[2], r[3]) for r in rows.collect())


def _votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def reliabilities(rows: list[tuple[bool, int, int]], rounds: int = 50) -> dict[int, float]:
    """Expectation-maximisation over (is base, code, count) of one kind: code → probability that a candidate with these votes is true.

    Each labeler has a distribution of votes on true and on false spans. Base spans are known to be true. Starts from the mean vote.
    """
    codes = {c: _votes_of(c) for _, c, _ in rows}
    post = {c: 1 / (1 + math.exp(-1.5 * sum(v))) for c, v in codes.items()}
    for _ in range(rounds):
        tables = [[[1.0] * 3, [1.0] * 3] for _ in LABELERS]
        share = [1.0, 1.0]
        for base, c, n in rows:
            p = 1.0 if base else post[c]
            for z, q in ((1, p), (0, 1 - p)):
                share[z] += n * q
                for k, v in enumerate(codes[c]):
                    tables[k][z][v + 1] += n * q
        new = {}
        for c, v in codes.items():
            odds = math.log(share[1] / share[0])
            for k, x in enumerate(v):
                a, b = tables[k]
                odds += math.log(b[x + 1] / sum(b)) - math.log(a[x + 1] / sum(a))
            new[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if max((abs(new[c] - post[c]) for c in codes), default=0) < 1e-9:
            break
        post = new
    return post


def classifier(rows: list[tuple[bool, int, int]], post: dict[int, float], steps: int = 400) -> list[float]:
    """Logistic weights (bias, then one for each labeler) fitted to the probabilities, spans weighted by their counts."""
    w = [0.0] * (len(LABELERS) + 1)
    total = sum(n for _, _, n in rows) or 1
    for _ in range(steps):
        grad = [0.05 * x for x in w]
        for base, c, n in rows:
            f = [1.0, *map(float, _votes_of(c))]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True))))
            for k, x in enumerate(f):
                grad[k] -= n / total * ((1.0 if base else post[c]) - p) * x
        w = [a - 0.5 * g for a, g in zip(w, grad, strict=True)]
    return w


def fit(spans: DataFrame) -> dict[str, list[float]]:
    """The span classifier's weights by kind, from the votes over all rows of `with_spans`; kinds without a span have none."""
    counts = vote_counts(spans)
    out = {}
    for kind in KINDS:
        rows = [(b, c, n) for k, b, c, n in counts if k == kind]
        if rows:
            out[kind] = classifier(rows, reliabilities(rows))
    return out


def decided(spans: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """`spans` with all_<kind>: base spans and accepted candidates as array<struct<s, e>> in order of their start."""

    def accepted(kind: str) -> Column:
        w = weights.get(kind)
        if not w:
            return F.lit(False)

        def ok(s: Column) -> Column:
            z = F.lit(w[0])
            for a, v in zip(w[1:], votes(kind, s, _company(kind)), strict=True):
                z = z + F.lit(a) * v
            return z >= 0

        return ok

    new = {}
    for kind in KINDS:
        ok = accepted(kind)
        own = [F.filter(f"loose_{kind}", ok)] if callable(ok) else []
        own += [F.col(f"base_{kind}")] if kind in BASE else []
        whole = F.concat(*own) if own else _none()
        new[f"all_{kind}"] = F.array_sort(F.transform(whole, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))))
    return spans.withColumns(new)


def _listed(prefix: str, kinds: tuple[str, ...]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(f"{prefix}_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["s"], F.lit(":"), s["e"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def found(docs: DataFrame, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of `docs`(doc_id, text), over whole texts.

    A null text is an empty one: no spans. Rows that repeat stay; other columns are ignored. No documents give no rows. Candidates that
    overlap a base span are not proposed. Two kinds may claim the same place if both are base spans. In `spans`, the kind `secret` comes after
    the four others. The spans are found once and written to the shared folder; votes and decisions read them there.
    """
    spans = materialize(with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    rows = decided(spans, fit(spans) if weights is None else weights)
    added = sum((F.size(f"all_{k}") for k in KINDS), F.lit(0)) - sum((F.size(f"base_{k}") for k in BASE), F.lit(0))
    return rows.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed("base", BASE), 256).alias("base_sha256"),
        _listed("all", KINDS).alias("spans"),
        added.cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets ([EMAIL]); where spans overlap, the first one names the place.

    Null texts stay null; `n_chars`, where there is one, is counted anew for changed texts. All other columns stay.
    """
    whole = materialize(with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")))
    rows = decided(whole, fit(whole) if weights is None else weights)
    changed = F.size("every") > 0

    def named(kind: str) -> Column:
        return F.transform(f"all_{kind}", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k")))

    rows = rows.withColumn("every", F.array_sort(F.concat(*map(named, KINDS))))
    rows = rows.select("row", changed.alias("changed"), F.when(changed, _replaced(F.col("text"), F.col("every"))).otherwise(F.col("text")).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if own.get(c) is not None else F.col("row").getField(c).alias(c) for c in docs.columns])


def _replaced(text: Column, spans: Column) -> Column:
    """`text` with each of the spans(s, e, k), in order of their start, replaced by its k; a span that starts within an earlier one gives nothing of its own."""

    def of(far: Column, blocks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:  # text[a:b], from the blocks it lies in
            i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            first = F.coalesce(F.get(blocks, i), F.lit(""))
            between = F.when(j > i + 1, F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")).otherwise(F.lit(""))
            several = F.concat(F.substring(first, a % BLOCK + 1, F.lit(BLOCK)), between, F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), b % BLOCK))
            return F.when(i == j, F.substring(first, a % BLOCK + 1, b - a)).otherwise(several)

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(far, i - 1))
            return F.when(s["s"] >= before, F.concat(part(before, s["s"]), s["k"])).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(spans, piece), ""), part(F.element_at(far, -1), F.length(text)))

    reach = _scan(F.transform(spans, lambda s: s["e"]), lambda a, b: F.greatest(a, b))
    return _let(reach, lambda far: _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: of(far, blocks)))
