"""Substring deduplication by prefix-partitioned suffix trees.

A suffix of a document is named by the words from some place on. Trees are built over the suffixes that start at anchors: in every
window of WINDOW words the place whose next PREFIX words hash lowest. Equal windows have their anchor at the same offset, so
they lie in the same tree, and about one place in six is an anchor.

1. Partitioning: a scan sends each anchor's prefix, as 5 bytes, and its place to the partition of the prefix. A prefix that only one
   document has heads a subtree without an internal node between documents and is dropped; one with more than FREQUENT suffixes is
   extended to whole windows, so that its suffixes split into many groups. Prefixes are thus of variable length and groups fit into memory.
   Prefixes that a good share of all documents have are known from a sample and extended where they are met, without being sent.
2. The documents, grouped by a hash of theirs, meet the answers and send for each remaining anchor WINDOW words to its right and those
   to its left. Where the same words around an anchor occur again in a group of documents, only the smallest document's are sent.
3. Subtrees: the suffixes of a partition are sorted; neighbours' longest common prefixes give the tree, whose internal nodes are the
   intervals that share so many words. The same goes for what stands before the anchors, read backwards. How deep the deepest internal
   nodes above a suffix lie on both sides is its maximal repeat; where that is WINDOW words or more, every window in it is a pair
   of nodes, and all the documents of the pair but the smallest have a duplicate.
4. The documents meet the windows found in them and drop the words that these cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, text_slices

WINDOW = 13
PREFIX = 4
FREQUENT = 10_000
#: Prefixes that at least COMMON of a sample of documents (one in SAMPLE, at least LEAST of them) have are never gathered. This only steers the work.
SAMPLE, COMMON, LEAST = 50, 0.02, 20
#: Characters of text for each partition of prefixes, and groups of documents for each partition.
PART_CHARS, GROUPS = 16_000_000, 4
REACH = WINDOW - PREFIX
#: Words whose hashes a worker remembers, and characters worked on at once.
REMEMBERED_WORDS, SLICE = 120_000, 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers those of frequent ones."""
    known: dict[bytes, int] = remembered("word hashes", dict)
    get = known.get
    out = [get(w) for w in words]
    if None in out:
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        xx = xxhash.xxh64_intdigest
        for k, h in enumerate(out):
            if h is None:
                w = words[k]
                out[k] = known[w] = xx(w)
    return np.array(out, dtype=np.uint64)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several columns of integers."""
    total = np.full(len(columns[0]), _B)
    for c in columns:
        total = (total ^ c.astype(np.uint64)) * _A
        total ^= total >> np.uint64(31)
    return total


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of their prefixes): of each window the place of the lowest prefix, the first at a tie."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = mixed([h[k : len(h) - PREFIX + 1 + k] for k in range(PREFIX)])
    low = np.lib.stride_tricks.sliding_window_view(g, REACH + 1).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    at = low[np.concatenate([[True], low[1:] != low[:-1]])]  # places only move forward
    return at, g[at]


def planes(x: np.ndarray, count: int | None = None) -> bytes:
    """Integers as bytes, all lowest bytes first: high bytes that hardly vary then compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :count].T.tobytes()


def from_planes(data: bytes, dtype: str, count: int | None = None) -> np.ndarray:
    kind = np.dtype(dtype)
    count = count or kind.itemsize
    raw = np.frombuffer(data, dtype=np.uint8).reshape(count, -1).T
    out = np.zeros((len(raw), kind.itemsize), dtype=np.uint8)
    out[:, :count] = raw
    return out.view(kind).ravel()


def _pieces(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) for each value of key, positions in their order."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    cut = np.flatnonzero(np.diff(own)) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(key[at[0]]), at


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_INT, _LONG, _BYTES = pa.int32(), pa.int64(), pa.binary()
_PREFIXES = pa.schema([("p", _INT), ("rid", _BYTES), ("n", _BYTES), ("h", _BYTES), ("at", _BYTES)])
_HITS = pa.schema([("g", _INT), ("rid", _BYTES), ("n", _BYTES), ("at", _BYTES), ("v", _BYTES)])
_DOCS = pa.schema([("g", _INT), ("id", _BYTES), ("known", _BYTES), ("rid", _BYTES), ("size", _BYTES), ("text", _BYTES)])
_SUFFIXES = pa.schema([("p", _INT), ("done", pa.bool_()), ("key", _BYTES), ("id", _BYTES), ("rid", _BYTES), ("at", _BYTES), ("v", _BYTES), ("codes", _BYTES)])
_RESULT = pa.schema([("doc_id", _LONG), ("n_words", _LONG), ("n_removed", _LONG), ("kept_sha256", pa.string()), ("kept", pa.string())])
_DDL = {id(s): ", ".join(f"{f.name} " + {_INT: "int", _LONG: "long", _BYTES: "binary", pa.bool_(): "boolean", pa.string(): "string"}[f.type] for f in s) for s in (_PREFIXES, _HITS, _DOCS, _SUFFIXES, _RESULT)}


def _rid(doc_id: int | None, text: bytes) -> int:
    """Names a row by its id and text; rows that share both have the same result. Rows without an id have names below zero, which no other row has."""
    name = xxhash.xxh64_intdigest(text, 0 if doc_id is None else doc_id & (2**64 - 1)) >> 1
    return -1 - name if doc_id is None else name


def _counted(rid: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal names: (names, lengths)."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rid)) + 1, [len(rid)]])
    return planes(rid[cut[:-1]]), planes(np.diff(cut).astype(np.uint32))


def _hits(rid: np.ndarray, at: np.ndarray, value: np.ndarray, groups: int) -> list[tuple]:
    """One row for each group of documents."""
    order = np.lexsort((at, rid))
    rid, at, value = rid[order], at[order], value[order]
    return [(g, *_counted(rid[k]), planes(at[k].astype(np.uint32)), planes(value[k].astype(np.uint16))) for g, k in _pieces(rid % groups)]


def _read_hits(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """name → (places, values), places in order."""
    if not table.num_rows:
        return {}
    parts = [[], [], []]
    for r in table.to_pylist():
        parts[0].append(np.repeat(from_planes(r["rid"], "<i8"), from_planes(r["n"], "<u4")))
        parts[1].append(from_planes(r["at"], "<u4").astype(np.int64))
        parts[2].append(from_planes(r["v"], "<u2"))
    rid, at, value = map(np.concatenate, parts)
    order = np.lexsort((at, rid))
    rid, at, value = rid[order], at[order], value[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rid)) + 1, [len(rid)]])
    return {int(rid[a]): (at[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)}


def common_prefixes(docs: DataFrame) -> np.ndarray:
    """Hashes of the prefixes that many documents of a sample have, sorted: at most the anchors of a document over COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, key="text", chars=SLICE):
            found = [np.unique(anchors(word_hashes(t.encode("utf-8").split()))[1]) for t in texts if t]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = docs.select("text").sample(1 / SAMPLE, seed=3)
    least = max(LEAST, COMMON * some.count())
    rows = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def _send_prefixes(n: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches, chars=SLICE):
            rid, at, g = [], [], []
            for d, t in zip(keys.to_pylist(), texts, strict=True):
                if t and d is not None:
                    raw = t.encode("utf-8")
                    p, h = anchors(word_hashes(raw.split()))
                    at.append(p)
                    g.append(h)
                    rid.append(np.full(len(p), _rid(d, raw)))
            if not rid:
                continue
            rid, at, g = np.concatenate(rid), np.concatenate(at), np.concatenate(g)
            place = np.minimum(np.searchsorted(common, g), max(len(common) - 1, 0))
            known = common[place] == g if len(common) else np.zeros(len(g), dtype=bool)
            part = np.where(known, n + rid % n, (g % np.uint64(n)).astype(np.int64))
            rows = [(p % n, *_counted(rid[k]), b"" if p >= n else planes(g[k] >> np.uint64(24), 5), planes(at[k].astype(np.uint32))) for p, k in _pieces(part)]
            yield _batch(rows, _PREFIXES)

    return run


def _repeated_prefixes(groups: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rid = np.repeat(from_planes(r["rid"], "<i8"), from_planes(r["n"], "<u4"))
                if not r["h"]:  # known to be common
                    yield _batch(_hits(rid, from_planes(r["at"], "<u4"), np.ones(len(rid), np.int64), groups), _HITS)
                    continue
                own = parts.setdefault(r["p"], [[], [], []])
                own[0].append(rid)
                own[1].append(from_planes(r["h"], "<u8", 5))
                own[2].append(from_planes(r["at"], "<u4"))
        while parts:
            _, own = parts.popitem()
            rid, h, at = map(np.concatenate, own)
            order = np.argsort(h, kind="stable")
            rid, h, at = rid[order], h[order], at[order]
            start = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1]) if len(h) else np.zeros(0, np.int64)
            if not len(start):
                continue
            size = np.diff(np.append(start, len(h)))
            several = np.minimum.reduceat(rid, start) != np.maximum.reduceat(rid, start)
            keep, long_ = np.repeat(several, size), np.repeat(size > frequent, size)
            yield _batch(_hits(rid[keep], at[keep], long_[keep], groups), _HITS)

    return run


def _pack_docs(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for keys, texts in text_slices(batches, chars=SLICE):
            raw = [(t or "").encode("utf-8") for t in texts]
            ids = keys.to_pylist()
            rid = np.array([_rid(d, t) for d, t in zip(ids, raw, strict=True)], dtype=np.int64)
            known = np.array([d is not None for d in ids])
            doc = np.array([0 if d is None else d for d in ids], dtype=np.int64)
            size = np.array([len(t) for t in raw], dtype=np.uint64)
            rows = [(g, planes(doc[k]), planes(known[k].astype(np.uint8)), planes(rid[k]), planes(size[k]), pack.compress(b"".join([raw[i] for i in k]))) for g, k in _pieces(rid % groups)]
            yield _batch(rows, _DOCS)

    return run


def _docs_of(table: pa.Table) -> Iterator[tuple[int | None, int, list[bytes]]]:
    """(doc_id, name, words) of the packed documents, one row's worth in memory at a time."""
    unpack = zstandard.ZstdDecompressor()
    for k in range(table.num_rows):
        r = table.slice(k, 1).to_pylist()[0]
        size = from_planes(r["size"], "<u8").astype(np.int64)
        text = unpack.decompress(r["text"]) if size.sum() else b""
        end = np.cumsum(size)
        for d, ok, rid, a, b in zip(from_planes(r["id"], "<i8").tolist(), from_planes(r["known"], "u1").tolist(), from_planes(r["rid"], "<i8").tolist(), (end - size).tolist(), end.tolist(), strict=True):
            yield d if ok else None, rid, text[a:b].split()


def _around(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW words to the right and REACH to the left of each place, which offsets have a whole window)."""
    n = len(codes)
    padded = np.concatenate([np.zeros(REACH, np.uint32), codes, np.zeros(WINDOW, np.uint32)])
    step = np.concatenate([np.arange(WINDOW), -1 - np.arange(REACH)]) + REACH
    offset = np.arange(REACH + 1)
    whole = (offset[None, :] <= at[:, None]) & (at[:, None] - offset[None, :] + WINDOW <= n)
    return padded[at[:, None] + step[None, :]], (whole << offset[None, :]).sum(axis=1)


def _send_suffixes(n: int):
    def run(_key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        found = _read_hits(hits)
        out: list[list] = [[], [], [], [], [], []]
        seen = set()
        for d, rid, words in _docs_of(docs) if found else ():
            if rid not in found or rid in seen or d is None:
                continue
            seen.add(rid)
            h = word_hashes(words)
            codes = (h >> np.uint64(32)).astype(np.uint32)
            at, frequent = found[rid]
            one, many = at[frequent == 0], at[frequent > 0]
            if len(many):  # the prefix grows to whole windows, each a suffix of its own
                starts = (many[:, None] - np.arange(REACH + 1)[None, :]).ravel()
                many = np.unique(starts[(starts >= 0) & (starts + WINDOW <= len(h))])
            places = np.concatenate([one, many])
            around, whole = _around(codes, places)
            whole[len(one) :] = 1
            around[len(one) :, WINDOW:] = 0
            right = [h[one + k] for k in range(PREFIX)]
            key = np.concatenate([mixed(right), mixed([h[many + k] for k in range(WINDOW)]) | np.uint64(1) if len(many) else np.zeros(0, np.uint64)])
            key[: len(one)] &= ~np.uint64(1)
            for x, v in zip(out, (key, np.full(len(places), d), np.full(len(places), rid), places, whole, around), strict=True):
                x.append(v)
        if not out[0]:
            return pa.Table.from_batches([], _SUFFIXES)
        key, doc, rid, at, whole, around = map(np.concatenate, out)
        # the same words around an anchor again, in a larger document: a duplicate of what the smallest one sends
        context = mixed([key, whole, *around.T])
        order = np.lexsort((doc, context))
        first = np.concatenate([[True], np.diff(context[order]) != 0])
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        own = np.empty(len(order), dtype=bool)
        own[order] = ~((doc[order] > doc[head]) & (around[order] == around[head]).all(axis=1))
        rows = [(int(g), True, b"", b"", planes(rid[k]), planes(at[k].astype(np.uint32)), planes(whole[k].astype(np.uint16)), b"") for g, k in [(rid[~own][0] % n, np.flatnonzero(~own))] if len(k)] if (~own).any() else []
        for p, k in _pieces(np.where(own, ((key >> np.uint64(1)) % np.uint64(n)).astype(np.int64), -1)):
            if p >= 0:
                rows.append((p, False, planes(key[k]), planes(doc[k]), planes(rid[k]), planes(at[k].astype(np.uint32)), planes(whole[k].astype(np.uint16)), around[k].astype("<u4").tobytes()))
        return pa.Table.from_batches([_batch(rows, _SUFFIXES)])

    return run


class Subtrees:
    """Sorted sequences of words below their roots, and the longest common prefix of each with the one before it."""

    def __init__(self, root: np.ndarray, words: np.ndarray):
        n, depth = words.shape
        even = words[:, : depth // 2 * 2].astype(np.uint64).reshape(n, -1, 2)
        keys = [(even[:, k, 0] << np.uint64(32)) | even[:, k, 1] for k in range(depth // 2)] + ([words[:, -1]] if depth % 2 else [])
        self.order = np.lexsort([*keys[::-1], root])
        own = words[self.order]
        same = np.logical_and.accumulate(own[1:] == own[:-1], axis=1).sum(axis=1)
        same[np.diff(root[self.order]) != 0] = -1
        self.common = np.concatenate([[-1], same])

    def deepest(self) -> np.ndarray:
        """For each sequence the depth of the deepest internal node above it; -1 if it shares its root with none."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.maximum(self.common, np.append(self.common[1:], -1))
        return out

    def nodes(self, depth: int) -> np.ndarray:
        """For each sequence the node at this depth: an interval of sequences that share so many words."""
        out = np.empty(len(self.order), dtype=np.uint64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeated_windows(key: np.ndarray, doc: np.ndarray, whole: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each suffix the offsets (bits) at which its window also stands in a smaller document."""
    out = np.zeros(len(key), dtype=np.int64)
    if not len(key):
        return out
    right, left = Subtrees(key, around[:, :WINDOW]), Subtrees(key, around[:, WINDOW:])
    live = np.flatnonzero(right.deepest() + left.deepest() >= WINDOW)  # maximal repeats that hold a window
    bits = np.zeros(len(live), dtype=np.int64)
    for o in range(REACH + 1):
        own = np.flatnonzero(whole[live] >> o & 1)
        if len(own):
            at = live[own]
            node = np.unique(right.nodes(WINDOW - o)[at] << np.uint64(32) | left.nodes(o)[at], return_inverse=True)[1]
            low = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, node, doc[at])
            bits[own] |= (doc[at] > low[node]).astype(np.int64) << o
    out[live] = bits
    return out


def _build_subtrees(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rid, at, v = from_planes(r["rid"], "<i8"), from_planes(r["at"], "<u4"), from_planes(r["v"], "<u2")
                if r["done"]:
                    yield _batch(_hits(rid, at, v, groups), _HITS)
                    continue
                own = parts.setdefault(r["p"], [[], [], [], [], [], []])
                for x, y in zip(own, (from_planes(r["key"], "<u8"), from_planes(r["id"], "<i8"), rid, at, v, np.frombuffer(r["codes"], "<u4").reshape(-1, WINDOW + REACH)), strict=True):
                    x.append(y)
        while parts:
            _, own = parts.popitem()
            key, doc, rid, at, v, around = map(np.concatenate, own)
            bits = repeated_windows(key, doc, v.astype(np.int64), around)
            hit = bits > 0
            if hit.any():
                yield _batch(_hits(rid[hit], at[hit], bits[hit], groups), _HITS)

    return run


def _drop_words(texts: bool):
    def run(_key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        found = _read_hits(hits)
        rows = []
        for d, rid, words in _docs_of(docs):
            n = len(words)
            if rid in found:
                at, bits = found[rid]
                edge = np.zeros(n + WINDOW + 1, dtype=np.int64)
                for o in range(REACH + 1):
                    start = at[(bits >> o & 1) > 0] - o
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + WINDOW, -1)
                gone = (np.cumsum(edge)[:n] > 0).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            kept = b" ".join(words)
            rows.append((d, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if texts else None))
        return pa.Table.from_batches([_batch(rows, _RESULT)])

    return run


def deduplicated(docs: DataFrame, frequent: int = FREQUENT, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of `docs`(doc_id, text), over whole texts.

    Words are runs of characters other than ASCII white space. A word goes if a window of WINDOW words over it also stands in a document
    with a smaller doc_id; windows are those of the input. `kept` is what stays, joined by single spaces (null if not `texts`). Null and empty texts
    have no words. Rows without an id neither lose words nor make others lose any. Rows that repeat an id are judged each by its own text
    and never against each other. Words are told apart in the trees by 32 bits of a hash, thirteen to a window. Other columns are
    ignored. No documents give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    groups = GROUPS * n
    packed = docs.mapInArrow(_pack_docs(groups), _DDL[id(_DOCS)])
    prefixes = docs.mapInArrow(_send_prefixes(n, common_prefixes(docs)), _DDL[id(_PREFIXES)]).repartitionById(n, F.col("p"))
    answers = prefixes.mapInArrow(_repeated_prefixes(groups, frequent), _DDL[id(_HITS)])
    suffixes = packed.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_send_suffixes(n), _DDL[id(_SUFFIXES)])
    windows = suffixes.repartitionById(n, F.col("p")).mapInArrow(_build_subtrees(groups), _DDL[id(_HITS)])
    return packed.groupBy("g").cogroup(windows.groupBy("g")).applyInArrow(_drop_words(texts), _DDL[id(_RESULT)])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM d WHERE len(w) >= 13
), low AS (
  SELECT s, min(doc_id) AS m FROM k GROUP BY s
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM k JOIN low USING (s) WHERE m < doc_id GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END AS k FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
