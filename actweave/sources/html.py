"""Fields of portal pages, read from the markup by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What code page 1252 has at 0x80-0x9F; positions it leaves open stay.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))


def remapped(text: Column) -> Column:
    """Control characters that stand for signs of code page 1252 become those signs."""
    return F.translate(text, CONTROLS, CP1252)


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, host, n_links) of pages(page_id, url, html)."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"),
    )


def labelled_values(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `fields`, a map from label to value of <dt>label</dt><dd>value</dd> and <th>label</th><td>value</td> pairs, tags and white space dropped; the first of a label wins."""
    pair = r"(?is)<(?:dt|th)[^>]*>(.*?)</(?:dt|th)>\s*<(?:dd|td)[^>]*>(.*?)</(?:dd|td)>"
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    keys, values = F.regexp_extract_all(html, F.lit(pair), F.lit(1)), F.regexp_extract_all(html, F.lit(pair), F.lit(2))
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.struct(F.regexp_replace(F.lower(plain(x["k"])), ":$", "").alias("k"), plain(x["v"]).alias("v")))
    first = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    return pages.withColumn("fields", first)


def required(cards_: DataFrame, what: str = "cards") -> DataFrame:
    """Raises if a source that must hold something is empty: an empty page means that the search did not run."""
    if cards_.isEmpty():
        raise ValueError(f"no {what}: the source is empty")
    return cards_
