"""Line dedup: repeated lines go, found by two Bloom filters and confirmed exactly.

1. Filters: a scan marks the digest of each line's key in a filter of keys seen once, and those that another document has marked before in a filter of keys
   seen twice. Tasks send the marks they set, packed by stretch of the filter; whoever owns a stretch adds them up: a mark that two senders set, or one
   sender for two documents, is a mark of the second filter. A key of two documents has all of its marks there, so none is missed.
2. Suspects: a second scan looks each line up in the second filter. Only keys that it knows are shuffled, as 128-bit digests with their
   documents; counting them confirms which are really in enough documents and which document keeps its lines.
3. A third scan drops the lines. Confirmed keys go to the tasks whole while they are few (KEYS); beyond that, each document meets its own in a join.

The filter has a fixed number of bits (BITS, sent to every executor: BITS / 8 bytes). With n lines a share of about (1 - exp(-2 n / BITS))^2 of the lines
that occur once is suspected for nothing and costs a few bytes of shuffle each; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_slices, with_facts

LEAST_CHARS, LEAST_DOCS = 40, 5
BITS = 2**27
#: Bits of a stretch of the filter, which one task adds up at a time.
STRETCH = 2**20
#: Keys whose marks a task gathers before it sends them.
GATHERED = 400_000
#: Up to so many confirmed keys (24 bytes each) are sent to every executor.
KEYS = 1_000_000
SLICE = 2_000_000


def digests_of(text: bytes, least: int) -> list[bytes | None]:
    """For each line the digest of its key: white space stripped, A-Z lower-cased; None if the key has under `least` characters."""
    digest = xxhash.xxh3_128_digest
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip()
        known = len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8")) >= least)
        out.append(digest(key) if known else None)
    return out


def _numbers(digests: list[bytes]) -> np.ndarray:
    """Digests as pairs of unsigned integers."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two marks of each key, the first half of a digest, in a filter of `bits` (a power of two)."""
    other = keys * np.uint64(0x9E3779B97F4A7C15)
    return (np.stack([keys, other ^ (other >> np.uint64(29))], axis=1) & np.uint64(bits - 1)).astype(np.int64)


def _send_marks(least: int, bits: int):
    def packed(found: list[np.ndarray]) -> Iterator[tuple]:
        keys, count = np.unique(np.concatenate(found), return_counts=True)  # by the first half of the digest: an agreement makes a suspect too many
        marks = places(keys, bits)
        once, twice = np.unique(marks), np.unique(marks[count > 1])
        for values, kind in ((once, 1), (twice, 2)):
            cut = np.flatnonzero(np.diff(values // STRETCH)) + 1
            for own in np.split(values, cut) if len(values) else []:
                yield int(own[0] // STRETCH), kind, (own % STRETCH).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed(found), strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["stretch", "kind", "marks"])

        for keys, texts in text_slices(batches, chars=SLICE):
            for d, t in zip(keys.to_pylist(), texts, strict=True):
                own = {x for x in digests_of(t.encode("utf-8"), least) if x} if t and d is not None else None
                if own:
                    found.append(_numbers(list(own))[:, 0])
                    n += len(own)
            if n > GATHERED:
                yield sent()
                found, n = [], 0
        if found:
            yield sent()

    return run


def _add_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch the second filter's bits, packed; a task has the stretches that its senders name."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for stretch, kind, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stretch not in filters:
                filters[stretch] = (np.zeros(STRETCH // 8, np.uint8), np.zeros(STRETCH // 8, np.uint8))
            once, twice = filters[stretch]
            new = np.zeros(STRETCH, np.uint8)
            new[np.frombuffer(marks, "<u4")] = 1
            new = np.packbits(new)
            if kind == 1:
                twice |= once & new
                once |= new
            else:
                twice |= new
    for stretch, (_, twice) in filters.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["stretch", "bits"])


def twice_seen(docs: DataFrame, least: int = LEAST_CHARS, bits: int = BITS) -> np.ndarray:
    """The filter of keys that two documents have, as packed bits: bits / 8 bytes, whatever the documents are."""
    if bits & (bits - 1) or bits < STRETCH:
        raise ValueError(f"bits must be a power of two from {STRETCH} on")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.mapInArrow(_send_marks(least, bits), "stretch int, kind int, marks binary").repartition(min(n, bits // STRETCH), "stretch")
    out = np.zeros(bits // 8, np.uint8)
    for r in marks.mapInArrow(_add_marks, "stretch int, bits binary").collect():
        out[r["stretch"] * (STRETCH // 8) :][: STRETCH // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _known(numbers: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which digests' marks are all in the filter."""
    marks = places(numbers[:, 0], len(twice) * 8)
    return ((twice[marks >> 3] >> (7 - (marks & 7)).astype(np.uint8)) & 1).all(axis=1)


def _send_suspects(least: int, twice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for keys, texts in text_slices(batches, chars=SLICE):
            own, doc = [], []
            for d, t in zip(keys.to_pylist(), texts, strict=True):
                found = list({x for x in digests_of(t.encode("utf-8"), least) if x}) if t and d is not None else []
                own += found
                doc += [d] * len(found)
            if own:
                known = np.flatnonzero(_known(_numbers(own), bits)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in known], pa.binary()), pa.array([doc[k] for k in known], pa.int64())], names=["key", "doc_id"])

    return run


def suspects(docs: DataFrame, twice: np.ndarray, least: int = LEAST_CHARS) -> DataFrame:
    """(key, doc_id): the digests of lines that the filter knows, once for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    return docs.mapInArrow(_send_suspects(least, shared), "key binary, doc_id long").distinct()


def confirmed(pairs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, last, n): keys(key, doc_id) of at least so many documents, the largest of these, and their number."""
    return pairs.groupBy("key").agg(F.max("doc_id").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least_docs)


class Repeated:
    """Confirmed keys, sorted, with the document that keeps each."""

    def __init__(self, rows: list):
        numbers = _numbers([bytes(r["key"]) for r in rows]) if rows else np.zeros((0, 2), np.uint64)
        order = np.lexsort((numbers[:, 1], numbers[:, 0]))
        self.high, self.low = numbers[order, 0], numbers[order, 1]
        self.last = np.array([r["last"] for r in rows], dtype=np.int64)[order]

    def goes(self, numbers: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which (digest, document) pairs lose their line."""
        out = np.zeros(len(numbers), dtype=bool)
        if not len(self.high):
            return out
        at = np.searchsorted(self.high, numbers[:, 0])
        live = np.arange(len(numbers))
        while len(live):  # keys that agree in the first half stand side by side
            live = live[(at[live] < len(self.high))]
            live = live[self.high[at[live]] == numbers[live, 0]]
            hit = self.low[at[live]] == numbers[live, 1]
            out[live[hit]] = doc[live[hit]] < self.last[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
        return out


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
_KEPT_DDL = "doc_id long, n_lines long, n_dropped long, kept string"


def _kept(d: int | None, text: str | None, digests: list[bytes | None], gone: set[int]) -> tuple:
    lines = (text or "").split("\n")
    if gone:
        lines = [x for k, x in enumerate(lines) if k not in gone]
    return d, len(digests), len(gone), "\n".join(lines)


def _drop_known(least: int, found):
    """Drops lines by the confirmed keys, which every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = found.value
        for keys, texts in text_slices(batches, chars=SLICE):
            ids = keys.to_pylist()
            digests = [digests_of((t or "").encode("utf-8"), least) for t in texts]
            where = [(k, n) for k, (d, own) in enumerate(zip(ids, digests, strict=True)) if d is not None for n, x in enumerate(own) if x]
            gone: dict[int, set[int]] = {}
            if where:
                goes = repeated.goes(_numbers([digests[k][n] for k, n in where]), np.array([ids[k] for k, _ in where], dtype=np.int64))
                for i in np.flatnonzero(goes).tolist():
                    gone.setdefault(where[i][0], set()).add(where[i][1])
            rows = [_kept(d, t, own, gone.get(k, set())) for k, (d, t, own) in enumerate(zip(ids, texts, digests, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)

    return run


def _drop_own(least: int):
    """Drops lines by the keys that came with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, t, keys = (batch.column(c)[k].as_py() for c in ("doc_id", "text", "gone"))
                digests, out = digests_of((t or "").encode("utf-8"), least), set(keys or [])
                row = _kept(d, t, digests, {n for n, x in enumerate(digests) if x in out} if out else set())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _KEPT, strict=True)], schema=_KEPT)

    return run


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int = BITS, keys: int = KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of `docs`(doc_id, text), over whole texts.

    Texts are split at line feeds; a null or empty text is one empty line. A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least `least_chars` characters that at least `least_docs` documents have lose all their lines but those in the largest doc_id
    that has it. A document is what shares a doc_id: rows that repeat one count once and lose or keep alike. Rows without an id
    neither count nor lose lines. n_lines counts before dropping; `kept` joins what stays by line feeds. Other columns are ignored; no
    rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = materialize(suspects(docs, twice_seen(docs, least_chars, bits), least_chars))
    found = materialize(confirmed(pairs, least_docs))
    if found.count() <= keys:
        shared = docs.sparkSession.sparkContext.broadcast(Repeated(found.collect()))
        discard(pairs)
        discard(found)
        return docs.mapInArrow(_drop_known(least_chars, shared), _KEPT_DDL)
    total = pairs.count()
    lost = with_facts(pairs, found, "key", "n", total).filter(F.col("doc_id") < F.col("last"))
    gone = materialize(lost.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("key").alias("gone")))
    discard(pairs)
    discard(found)
    named = docs.filter(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "gone")
    nameless = docs.filter(F.col("doc_id").isNull()).withColumn("gone", F.lit(None).cast("array<binary>"))
    return named.unionByName(nameless).mapInArrow(_drop_own(least_chars), _KEPT_DDL)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), l AS (
  SELECT r, doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), g AS (
  SELECT r, doc_id, line, i, coalesce(doc_id < last, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r
"""
