"""Text as Column expressions: whatever needs no Python stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = " [...]"


def capped(items: Column, n: int) -> Column:
    """The first n of a set in ascending order."""
    return F.slice(F.array_sort(items), 1, n)


def truncated(text: Column, n: int) -> Column:
    """At most n characters, with a mark where something is cut off."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(CUT))).otherwise(text)


def collapsed(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def letters(text: Column) -> Column:
    """Lower-case letters, digits and underscores only, of any alphabet."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def fingerprint(text: Column, n: int = 300) -> Column:
    """md5 of the first n letters and digits: texts that differ in spacing and signs share it."""
    return F.md5(F.left(letters(text), F.lit(n)))


def short_fingerprint(text: Column) -> Column:
    """16 hex digits of the raw text's md5: tells whether a chunk's parent has changed."""
    return F.left(F.md5(text), F.lit(16))


def quick_ratio(a: Column, b: Column) -> Column:
    """Twice the characters that two texts share, each counted as often as both have it, over their length; 1 for two empty texts."""

    def held(s: Column, c: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, c, F.lit("")))

    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(held(a, c), held(b, c)))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * shared / size)


#: The months in the order of the calendar.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
DATE_WORDS = r"(?i)([0-9]{1,2})\s*°?\s*(gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+([0-9]{4})"


def written_date(text: Column, before: str = "") -> Column:
    """The first date written in words (after the pattern `before`, if any); null if there is none or no such day."""
    pattern = before + DATE_WORDS if not before.startswith("(?i)") else before + DATE_WORDS[4:]
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month))
    return F.when(day != "", F.try_to_date(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def slashed_date(text: Column) -> Column:
    """dd/mm/yyyy as a date; anything else is null."""
    return F.try_to_date(F.trim(text), "dd/MM/yyyy")


def clean_date(date: Column, act_year: Column, first: int = 1500) -> Column:
    """Placeholder dates before `first` go; a year of two digits is read as the act's year if that ends so."""
    year = F.year(date)
    completed = F.make_date(act_year, F.month(date), F.dayofmonth(date))
    return F.when(year >= first, date).when((year < 100) & (act_year % 100 == year) & (act_year >= first), completed)


def plain_marks(text: Column) -> Column:
    """Typographic apostrophes become straight ones and acute e becomes grave, as the recognisers expect."""
    return F.translate(text, "’‘ʼéÉ", "'''èÈ")


def leading_int(text: Column) -> Column:
    """The number a label starts with ("12 bis" → 12); null without one."""
    return F.regexp_extract(text, r"^\s*([0-9]{1,9})", 1).try_cast("int")


MARK = "\x02"


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: all matches of a pattern with where they start and end (exclusive, in characters): matches are put between marks, and the text is split there."""
    clean = F.translate(text, MARK, " ")
    parts = F.when(clean.rlike(pattern), F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("x"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        found = F.when(a["odd"], F.array_append(a["x"], F.struct(a["at"].alias("s"), end.alias("e"), x.alias("t")))).otherwise(a["x"])
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), found.alias("x"))

    return F.coalesce(F.aggregate(parts, start, step, lambda a: a["x"]), none)


def title_words(text: Column) -> Column:
    """A title for comparison: lower case, letters and digits, single spaces."""
    return collapsed(F.regexp_replace(F.lower(plain_marks(text)), r"[^\p{L}\p{N}]+", " "))


def distinctive_numbers(text: Column, digits: int = 3) -> Column:
    """Numbers of at least so many digits, each once, in ascending order as text."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: F.length(x) >= digits)))


# The characters that Windows shows for the bytes from 80 to 9F, and these bytes as characters.
WINDOWS, BYTES = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ", "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def _bytes(first: int, last: int) -> str:
    """A class of the characters that stand for a byte in a range."""
    return f"[\\x{first:02x}-\\x{last:02x}" + "".join(w for w, b in zip(WINDOWS, BYTES, strict=True) if first <= ord(b) <= last) + "]"


# One character in UTF-8 whose bytes were each read as a character (only sequences that are valid), and à whose second byte was read as a space.
_REST = _bytes(0x80, 0xBF)
MISREAD = "|".join(
    [rf"[\xc2-\xdf]{_REST}", rf"\xe0{_bytes(0xA0, 0xBF)}{_REST}", rf"[\xe1-\xec\xee\xef]{_REST}{{2}}", rf"\xed{_bytes(0x80, 0x9F)}{_REST}"]
    + [rf"\xf0{_bytes(0x90, 0xBF)}{_REST}{{2}}", rf"[\xf1-\xf3]{_REST}{{3}}", rf"\xf4{_bytes(0x80, 0x8F)}{_REST}{{2}}"]
)
CUT_OFF = r"\xc3[\t-\r\x1c-\x20\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def repaired(text: Column) -> Column:
    """Undoes UTF-8 that was read as one byte a character, sequence by sequence; other characters stay, but for Â, which goes."""

    def whole(x: Column) -> Column:
        read = F.decode(F.encode(F.translate(x, WINDOWS, BYTES), "ISO-8859-1"), "UTF-8")
        return F.when(x == "Â", "").when(x.rlike(CUT_OFF), "à").otherwise(read)

    def piece(p: Column) -> Column:
        parts = F.split(F.regexp_replace(p, f"{MISREAD}|{CUT_OFF}|Â", f"{MARK}$0{MARK}"), MARK, -1)
        return F.array_join(F.transform(parts, lambda x, n: F.when(n % 2 == 1, whole(x)).otherwise(x)), "")

    # no sequence holds a mark, so those of the text itself only part it
    return F.array_join(F.transform(F.split(text, MARK, -1), piece), MARK)


def repair_mojibake(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `column` repaired; rows without a telling character stay as they are."""
    doubtful = F.coalesce(F.col(column).rlike("[ÂÃÄ-ô]"), F.lit(False))
    return rows.withColumn(column, F.when(doubtful, repaired(F.col(column))).otherwise(F.col(column)))
