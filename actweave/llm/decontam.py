"""Benchmark decontamination: rare n-gram seeds join documents to test items, and Smith-Waterman scores what they join.

The items are a stated query set and go to the executors in blocks of a bounded number of words. A first scan counts in how many documents
each of their words stands. An alignment of score s matches at least s / MATCH of an item's words; so of the words that any document
has, all but that many less one, the rarest ones, are the item's seeds, and no copy is without one. Seeds are n-grams of one word,
as edits every few words leave no longer one. A second scan looks the seeds up in the documents; an item that a seed joins is
tested by all its words, and the stretches that are dense enough are aligned: exact copies, edits, gaps and insertions score
by what stays in order. The score alone decides: no run of words must survive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices, without

#: Items of fewer words leak only as a whole.
N = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible alignment score from which a passage is a copy.
SIMILARITY = 0.5
BLOCK_WORDS = 1_000_000
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII signs and with ASCII letters in lower case."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split() if text else []


class Index:
    """The words of a block of items; how often each item has them, and which of them are its seeds."""

    def __init__(self, items: list[tuple[int, str]], least: float = SIMILARITY):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], dtype=np.int64)
            if len(ids):
                self.items.append((item, ids))
        size = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        #: the score that makes a copy, the words it matches at least, and the words of a text it spans at most
        self.need = np.where(size < N, 1.0, least) * MATCH * size
        self.least = np.maximum(np.ceil(self.need / MATCH - 1e-9), 1).astype(np.int64)
        self.span = size + np.maximum(0, np.floor((MATCH * size - self.need) / -GAP + 1e-9)).astype(np.int64)
        own = [np.unique(ids, return_counts=True) for _, ids in self.items]
        self.word = np.concatenate([w for w, _ in own] or [np.zeros(0, np.int64)])
        self.times = np.concatenate([n for _, n in own] or [np.zeros(0, np.int64)])
        self.first = np.cumsum([0, *(len(w) for w, _ in own)])
        self.count = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        self.mark = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        self.choose(np.ones(len(self.vocabulary), dtype=np.int64))

    def choose(self, documents: np.ndarray) -> None:
        """Chooses the seeds, from the number of documents that have each word: per item the rarest places that not every copy can do without."""
        item, word = [], []
        for k, (_, ids) in enumerate(self.items):
            own = ids[documents[ids] > 0]
            own = own[np.lexsort((own, documents[own]))][: len(own) - self.least[k] + 1] if len(own) >= self.least[k] else own[:0]
            own = np.unique(own)
            item.append(np.full(len(own), k))
            word.append(own)
        word, item = np.concatenate(word or [np.zeros(0, np.int64)]), np.concatenate(item or [np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        self.seeded = item[order]
        self.start = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))

    def words_in(self, words: list[bytes]) -> np.ndarray:
        """The number of each word of a text; -1 is a word that no item has."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def joined(self, kinds: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Items that a seed joins to a text with these words, and enough of their other words besides."""
        size = self.start[kinds + 1] - self.start[kinds]
        item = np.unique(self.seeded[np.repeat(self.start[kinds] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        if not len(item):
            return item
        size = self.first[item + 1] - self.first[item]
        at = np.repeat(self.first[item] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.count[kinds] = count
        shared = np.add.reduceat(np.minimum(self.times[at], self.count[self.word[at]]), np.cumsum(size) - size)
        self.count[kinds] = 0
        return item[shared >= self.least[item]]

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item's place, first word, word ids) of the stretches of one text where an item can reach its score."""
        ids = self.words_in(words)
        kinds, count = np.unique(ids[ids >= 0], return_counts=True)
        if not len(kinds):
            return
        for item in self.joined(kinds, count).tolist():
            own, span = self.items[item][1], int(self.span[item])
            self.mark[own] = True
            hit = self.mark[ids]  # -1 reads the last mark, which is never set
            self.mark[own] = False
            # every word of the text within an alignment costs one unless it matches
            places = np.flatnonzero(hit)
            gain = (MATCH - GAP) * np.arange(len(places)) + GAP * places
            if (gain - np.minimum.accumulate(gain)).max() + MATCH < self.need[item]:
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            begin = np.arange(max(1, len(ids) - span + 1))
            begin = begin[total[np.minimum(begin + span, len(ids))] - total[begin] >= self.least[item]]
            if len(begin):
                cut = np.flatnonzero(np.diff(begin) > span) + 1
                for a, b in zip(begin[np.concatenate([[0], cut])].tolist(), begin[np.concatenate([cut - 1, [len(begin) - 1]])].tolist(), strict=True):
                    yield item, a, ids[a : b + span]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, end in the item, end in the passage), ends exclusive; the earliest end wins a tie."""
    last = np.zeros(len(passage) + 1, dtype=np.int64)
    ramp = -GAP * np.arange(len(passage) + 1)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        row = np.zeros_like(last)
        row[1:] = np.maximum(np.maximum(last[:-1] + np.where(passage == w, MATCH, MISMATCH), last[1:] + GAP), 0)
        last = np.maximum.accumulate(row + ramp) - ramp
        if (top := int(last.max())) > best[0]:
            best = (top, i + 1, int(last.argmax()))
    return best


def _blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // words)
    for b in range(n):
        yield sorted(map(tuple, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()))


_LEAK = "doc_id long, item_id long, similarity double, start_word long, end_word long"


def _counted(docs: DataFrame, shared) -> DataFrame:
    """(word, n): how many of the documents have each word of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(len(index.vocabulary), dtype=np.int64)
        for _, texts in text_slices(batches, key="text"):
            for text in texts:
                ids = index.words_in(list(set(words_of(text))))
                total[ids[ids >= 0]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _found(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for keys, texts in text_slices(batches):
            out = []
            for doc, text in zip(keys.to_pylist(), texts, strict=True):
                for place, start, passage in index.passages(words_of(text)):
                    item_id, item = index.items[place]
                    score, i, j = align(item, passage)
                    if score >= index.need[place]:
                        _, _, back = align(item[:i][::-1], passage[:j][::-1])
                        out.append((doc, item_id, score / (MATCH * len(item)), start + j - back, start + j))
            if out:
                d, item_id, s, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(item_id, pa.int64()), pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "similarity", "start_word", "end_word"])

    return docs.mapInArrow(run, _LEAK)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word): every document that holds a passage of a benchmark item.

    similarity is the alignment score over that of the item with itself; one row for each pair, with its best passage (the first at a
    tie; words as in `words_of`). Items of fewer than N words leak only as a whole. Null ids and null or wordless texts on either side leak nothing. Rows that repeat an id are one document, or one item. Other
    columns are ignored. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for items in _blocks(benchmark, block_words):
        index = Index(items, similarity)
        if not index.items:
            continue
        shared = spark.sparkContext.broadcast(index)
        documents = np.zeros(len(index.vocabulary), dtype=np.int64)
        for r in _counted(docs, shared).collect():  # a number for each word of the block at most
            documents[r["word"]] = r["n"]
        shared.destroy()
        index.choose(documents)
        shared = spark.sparkContext.broadcast(index)
        found = materialize(_found(docs, shared))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], _LEAK)
    best = F.max_by(F.struct("similarity", "start_word", "end_word"), F.struct("similarity", (-F.col("start_word")).alias("a"), (-F.col("end_word")).alias("b")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a benchmark passage, with the columns of `docs`; rows with a null id are kept."""
    return without(docs, materialize(leaks(docs, benchmark).select("doc_id").distinct()))
