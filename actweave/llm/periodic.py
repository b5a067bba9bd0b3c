"""Periodic runs of words: loops in which a stretch of words repeats back to back.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least max(LEAST, 2 q) words that no
neighbouring word extends keeping period q.

1. Masking: a run of length n and period q is two equal stretches of n - q words, q apart. n - q is at least half of LEAST, whatever q is, and
   the two stretches cover the run. So every word of a run lies in a k-gram, k = LEAST / 2 rounded up, that occurs twice in the document; words
   outside of such k-grams join no run. What stays falls into segments; as a run lies within one segment, its k-grams repeat there,
   and the mask is drawn again within the segments until nothing more goes.
2. Main-Lorentz: every segment is halved again and again. A run lies in a smallest such part, crosses its middle, and has a whole period to the left
   or to the right of it; so for each part and each period up to half of it, the longest common extensions on both sides of the
   middle and of the word a period away give the run, if there is one. All parts of a size and all periods are tried at once.
   Extensions come from the ranks of all stretches of 1, 2, 4, ... words, which are equal only if the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .substring import mixed

LEAST = 12
#: Characters worked on at once (or one text).
SLICE = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"


def k_of(least: int) -> int:
    """The shortest stretch that a run of at least `least` words has twice: the least of n - q over all q."""
    return -(-least // 2)


def _segments(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers the stretches of `at` (increasing) that are consecutive and of one group."""
    return np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(group) != 0)])) - 1


def masked(codes: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(places, segments): the words that may join a run, as places in `codes`, and the number of the stretch each belongs to.

    k-grams are compared by 64-bit hashes: a chance agreement keeps words that could go and loses none.
    """
    k, at, seg = k_of(least), np.arange(len(codes)), doc
    while len(at) >= least:
        n = len(at) - k + 1
        own = codes[at]
        whole = np.flatnonzero(seg[:n] == seg[k - 1 :])
        g = mixed([seg[:n], *[own[j : n + j] for j in range(k)]])[whole]
        order = np.argsort(g, kind="stable")
        same = np.concatenate([[False], g[order][1:] == g[order][:-1], [False]])
        again = whole[order[same[1:] | same[:-1]]]
        edge = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + k, -1)
        stay = np.cumsum(edge[:-1]) > 0
        new_at = at[stay]
        if not len(new_at):
            break
        new_seg = _segments(seg[stay], new_at)
        wide = np.bincount(new_seg)[new_seg] >= least
        new_at, new_seg = new_at[wide], new_seg[wide]
        if len(new_at) == len(at):
            return new_at, new_seg
        at, seg = new_at, new_seg
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


class Extensions:
    """Longest common extensions of two places, by the ranks of all stretches of 1, 2, 4, ... words."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        while 1 << len(self.ranks) <= longest:
            last, width = self.ranks[-1], 1 << len(self.ranks) - 1
            pair = last[: len(last) - width] * (len(codes) + 1) + last[width:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on agree, up to `most`."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[k], 1 << k
            fits = n + width <= most
            x, y = np.where(fits, i + n, 0), np.where(fits, j + n, 0)
            n += width * (fits & (rank[x] == rank[y]))
        return n

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree, up to `most`."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[k], 1 << k
            fits = n + width <= most
            x, y = np.where(fits, i - n - width, 0), np.where(fits, j - n - width, 0)
            n += width * (fits & (rank[x] == rank[y]))
        return n


def repetitions(codes: np.ndarray, seg: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs within the segments of `codes`, by start and period: Main-Lorentz over all segments at once."""
    begin = np.flatnonzero(np.concatenate([[True], np.diff(seg) != 0])) if len(seg) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(seg)))
    found: list[list[np.ndarray]] = [[], [], []]
    longest = int(size.max()) if len(size) else 0
    extend = Extensions(codes, longest) if len(size) else None
    half = 1
    while 2 * half < least:
        half *= 2
    while half < longest:
        count = np.maximum(0, -(-(size - half) // (2 * half)))  # parts whose middle is inside
        own = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.repeat(begin[own], half), np.repeat(begin[own] + size[own], half)
        middle = np.repeat(begin[own] + half + 2 * half * nth, half)
        period = np.tile(np.arange(1, half + 1), len(own))
        for i, j in ((middle, middle + period), (middle - period, middle)):  # a whole period to the right, to the left
            ok = (i >= low) & (j <= high)
            i, j, p, lo, hi = i[ok], j[ok], period[ok], low[ok], high[ok]
            inside = np.minimum(j, len(codes) - 1)
            some = ((j < hi) & (codes[i] == codes[inside])) | ((i > lo) & (codes[np.maximum(i - 1, 0)] == codes[j - 1]))
            i, j, p, lo, hi = i[some], j[some], p[some], lo[some], hi[some]
            x, y = extend.right(i, j, hi - j), extend.left(i, j, i - lo)
            run = (x + y >= p) & (x + y + p >= least)
            for out, v in zip(found, (i[run] - y[run], j[run] + x[run], p[run]), strict=True):
                out.append(v)
        half *= 2
    start, end, period = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) if len(start) else np.zeros(0, bool)
    start, end, period = start[first], end[first], period[first]  # of one stretch's periods all are multiples of the smallest
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(least: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches, chars=SLICE):
            words = [t.encode("utf-8").split() if t else [] for t in texts]
            size = np.array([len(w) for w in words], dtype=np.int64)
            base = np.cumsum(size) - size
            flat = pa.array([x for w in words for x in w], pa.binary())
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at, seg = masked(codes, np.repeat(np.arange(len(words)), size), least)
            start, end, period = repetitions(codes[at], seg, least)
            length = end - start
            start = at[start]
            owner = np.searchsorted(base, start, side="right") - 1 if len(start) else start
            edge = np.zeros(len(codes) + 1, dtype=np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = np.bincount(owner, minlength=len(words))
            kept = []
            for k, w in enumerate(words):
                if runs[k]:
                    w = [x for x, g in zip(w, gone[base[k] : base[k] + size[k]].tolist(), strict=True) if not g]
                kept.append(b" ".join(w).decode("utf-8"))
            structs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start - base[owner], length, period)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int32()), structs, type=pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([keys.cast(id_type), pa.array(size), lists, pa.array(kept, pa.string())], schema=schema)

    return run


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, kept) for every row of `docs`(doc_id, text), over whole texts.

    Words are runs of characters other than ASCII white space, numbered from 0. runs: array of (start, length, period) by start, then period. `kept`
    has the words that no run contains after its first period, joined by single spaces. Null and empty texts have no words,
    no runs and an empty `kept`. Rows are judged each by itself: repeated rows and null ids are nothing special. Other columns are ignored; no rows give no rows.
    The memory of a task is that of its longest text, some 200 bytes a word that may join a run.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse(least, pa.int64()), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): `docs` with loops planted in about every tenth text, by crc32 of the id; rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    n = F.greatest(F.size("_w"), F.lit(1))
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

    def word(i: Column) -> Column:
        return F.get(F.col("_w"), F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))

    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w")).withColumn("_a", a).withColumn("_p", p)
    loop = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), word), " ")
    return chosen.select("doc_id", F.when(F.size("_w") > 0, loop).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of op11 from those of `collapsed`: the count of runs, the longest one, and hashes of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = found.withColumn("_b", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.s")).alias("start"),
        F.col("_b.l").alias("length"),
        (-F.col("_b.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("_b.l") / (-F.col("_b.p"))).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


#: crc32 of a string of ASCII characters, by its definition bit by bit; -1 stands for one shift.
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({s}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"

ORACLE = rf"""
WITH d0 AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE {CRC32.format(s="CAST(doc_id AS VARCHAR)")} END AS h FROM documents
), d1 AS (
  SELECT *, h // 10 AS g, CAST(len(w) AS BIGINT) AS n FROM d0
), d2 AS (
  SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM d1
), d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM d2
), k AS (
  SELECT r, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(0, n - 5), lambda i: array_to_string(w[i + 1:i + 6], ' '))) AS s FROM d WHERE n >= 12
), e AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.s = y.s AND x.i < y.i
), f AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM e
), c AS (
  SELECT r, q, min(i) AS st, count(*) + 5 + q AS l FROM f GROUP BY r, q, isle HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12
), runs AS (
  SELECT r, st, l, min(q) AS q FROM c GROUP BY r, st, l
), gone AS (
  SELECT r, list_distinct(flatten(list(range(st + q, st + l)))) AS g FROM runs GROUP BY r
), top AS (
  SELECT r, count(*) AS n_runs, arg_min(st, [-l, st, q]) AS st, max(l) AS l, arg_min(q, [-l, st, q]) AS q, string_agg(st || ',' || l || ',' || q || chr(10), '' ORDER BY st, q) AS s FROM runs GROUP BY r
), kept AS (
  SELECT r, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(g, i)), lambda i: w[i + 1]) END AS w FROM d LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(st AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(array_to_string(kept.w, ' '), '')) AS collapsed_sha256
FROM d JOIN kept USING (r) LEFT JOIN top USING (r)
"""
