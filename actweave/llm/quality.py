"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Words are hashed into BUCKETS; every bucket has a sparse random index vector. A bucket's context vector is the sum of the index
vectors of the neighbours of its words over all documents: tasks add up their texts, and the sums of tasks are added by bucket. A word's form (case,
punctuation around it, digits, length) has an index vector as well. A document is pooled to the mean and spread of its
words' vectors and a few shares. The network's output is divided by a temperature fitted on rows held back from training.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, fitted_rows, remainder, remembered, text_slices

#: The fit uses at most so many labelled rows of each class, whole texts up to so many characters in all. Scores read whole texts.
PER_LABEL = 1500
FIT_CHARS = 30_000_000
CONTEXT, FORM, NONZERO, REACH = 48, 64, 4, 2
#: Words share a vector if their hashes agree modulo this number, which bounds the table that the executors get (6 MB); buckets are added up in BLOCKS.
BUCKETS, BLOCKS = 1 << 15, 128
#: Words at which a document's features count half.
FEW = 8
#: Words whose vectors a worker keeps, and words of a text that are looked up at once (no more than it keeps).
CACHE = STEP = 60_000
#: Forms of words whose vectors it keeps.
FORMS = 30_000
FOLDS, THRESHOLD = 5, 0.3

_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def index_rows(names: list[str], dims: int) -> np.ndarray:
    """The index vectors of names: NONZERO components of +1 or -1, at places and with signs from the bits of one hash."""
    out = np.zeros((len(names), dims), dtype=np.float32)
    h = np.array([xxhash.xxh64_intdigest(x if x.isascii() else x.encode("utf-8", "surrogatepass")) for x in names], dtype=np.uint64)
    row = np.arange(len(names))
    for k in range(NONZERO):
        piece = (h >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
        out[row, (piece >> 1) % dims] += np.where(piece & 1, 1.0, -1.0)
    return out


def form_of(word: str) -> tuple[str, tuple]:
    """(core, form): the lower-case word without the signs around it, and how it is written."""
    lead = trail = ""
    if word.isalpha():
        core = word
    elif word[:-1].isalpha():
        core, trail = word[:-1], word[-1]
    else:
        lead, core, trail = _EDGES.match(word).groups()
    low = core.lower()
    case = "l" if core == low else "U" if len(core) > 1 and core.isupper() else "T" if core[0].isupper() else "-"
    return low, (case, lead[:3], trail[:3], min(len(core), 12) // 3, not core.isalpha() and any(c.isdigit() for c in core))


@dataclass
class Words:
    """Rows of vectors for words as they are met; it starts afresh when it is full."""

    contexts: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    forms: dict[tuple, np.ndarray] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((CACHE, CONTEXT + FORM), dtype=np.float32))

    def ids(self, words: list[str]) -> np.ndarray:
        get, rows = self.rows.get, self.rows
        out = [get(w, -1) for w in words]
        if -1 in out:
            fresh = list(dict.fromkeys(w for w, k in zip(words, out, strict=True) if k < 0))
            if len(rows) + len(fresh) > CACHE:
                rows.clear()
                fresh = list(dict.fromkeys(words))
            self._add(fresh)
            out = [rows[w] for w in words]
        return np.array(out, dtype=np.int64)

    def _add(self, words: list[str]) -> None:
        first = len(self.rows)
        pairs = [form_of(w) for w in words]
        own = self.table[first : first + len(words)]
        own[:, :CONTEXT] = self.contexts[[bucket_of(c) for c, _ in pairs]]
        for k, (_, form) in enumerate(pairs):
            if (vector := self.forms.get(form)) is None:
                if len(self.forms) > FORMS:
                    self.forms.clear()
                vector = self.forms[form] = index_rows([f"{i}{x}" for i, x in enumerate(form)], FORM).sum(axis=0) / 2
            own[k, CONTEXT:] = vector
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))


def pooled(text: str | None, words: Words) -> np.ndarray:
    """The document's vector. All words of the text count; no words give zeros."""
    found = text.split() if text else []
    n, width = len(found), CONTEXT + FORM
    out = np.zeros(2 * width + 5, dtype=np.float32)
    if not n:
        return out
    mean, square, distinct, repeats, last = np.zeros(width), np.zeros(width), 0, 0, -1
    for at in range(0, n, STEP):
        ids = words.ids(found[at : at + STEP])
        kinds, count = np.unique(ids, return_counts=True)
        rows = words.table[kinds].astype(np.float64)
        mean += count @ rows
        square += count @ rows**2
        distinct += len(kinds)
        repeats += int((ids[1:] == ids[:-1]).sum())
    mean /= n
    out[:width] = mean
    out[width : 2 * width] = np.sqrt(np.maximum(square / n - mean**2, 0))
    out[2 * width :] = np.log1p(n), distinct / n, repeats / n, len(text) / n / 10, text.count("\n") / n
    return out


def bucket_of(core: str) -> int:
    return xxhash.xxh64_intdigest(core if core.isascii() else core.encode("utf-8", "surrogatepass")) % BUCKETS


def index_vectors() -> np.ndarray:
    """The index vector of every bucket, and one of zeros for no word."""
    return np.concatenate([index_rows([f"bucket {k}" for k in range(BUCKETS)], CONTEXT), np.zeros((1, CONTEXT), dtype=np.float32)]).astype(np.int8)


def _add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Adds to each bucket of `ids` (texts apart by REACH places of no word) the index vectors within REACH places."""
    own = index[ids]
    near = np.zeros_like(own)
    for k in range(1, REACH + 1):
        near[k:] += own[:-k]
        near[:-k] += own[k:]
    order = np.argsort(ids, kind="stable")
    kinds, start = np.unique(ids[order], return_index=True)
    total[kinds] += np.add.reduceat(near[order], start, axis=0, dtype=np.int32)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Random indexing over all of `docs`(text): BUCKETS x CONTEXT sums scaled to length one; a bucket without neighbours has half its index vector."""
    own = BUCKETS // BLOCKS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS + 1, CONTEXT), dtype=np.int32)
        known: dict[str, int] = {}
        for _, texts in text_slices(batches, key="text"):
            ids: list[int] = []
            for t in texts:
                words = t.split() if t else []
                found = list(map(known.get, words))
                if None in found:
                    for k, b in enumerate(found):
                        if b is None:
                            found[k] = known[words[k]] = bucket_of(form_of(words[k])[0])
                ids += found
                ids += [BUCKETS] * REACH
                if len(ids) > 100_000:
                    _add_contexts(total, np.array(ids), index)
                    ids = []
            if ids:
                _add_contexts(total, np.array(ids), index)
            if len(known) > CACHE:
                known = {}
        used = np.flatnonzero(total[:BUCKETS].any(axis=1))
        for at in np.split(used, np.flatnonzero(np.diff(used // own)) + 1) if len(used) else []:
            part = total[at]
            kind = np.int16 if np.abs(part).max() < 2**15 else np.int32
            yield pa.RecordBatch.from_arrays([pa.array([int(at[0]) // own], pa.int32()), pa.array([(at % own).astype(np.int16).tobytes()], pa.binary()), pa.array([part.astype(kind).T.tobytes()], pa.binary())], ["block", "at", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                at = np.frombuffer(r["at"], dtype=np.int16).astype(np.int64)
                kind = np.int16 if len(r["sums"]) == 2 * CONTEXT * len(at) else np.int32
                blocks.setdefault(r["block"], np.zeros((own, CONTEXT), dtype=np.int64))[at] += np.frombuffer(r["sums"], dtype=kind).reshape(CONTEXT, -1).T
        for b, total in blocks.items():
            size = np.sqrt((total.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(total / np.maximum(size, 1e-9)).astype(np.float32).tobytes()], pa.binary())], ["block", "vectors"])

    parts = docs.select("text").mapInArrow(sums, "block int, at binary, sums binary")
    n = min(BLOCKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = index_vectors()[:BUCKETS].astype(np.float32) / 2
    for r in parts.repartition(n, "block").mapInArrow(added, "block int, vectors binary").collect():
        found = np.frombuffer(r["vectors"], dtype=np.float32).reshape(own, CONTEXT)
        seen = found.any(axis=1)
        out[r["block"] * own : (r["block"] + 1) * own][seen] = found[seen]
    return out


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features in units of their spread, drawn towards the mean where few words speak."""
    n = np.expm1(x[:, 2 * (CONTEXT + FORM)])
    return (x - mean) / spread * (n / (n + FEW))[:, None]


@dataclass
class Network:
    """Two layers; score = sigmoid(output / temperature + shift)."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    shift: float = 0.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(standard(x, self.mean, self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, prior: float, hidden: int = 32, steps: int = 3000, seed: int = 5) -> Network:
    """Fits the network on classes of equal weight, then the temperature on held-back rows, then shifts to the `prior` of class 1."""
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), bool)
    fit = np.flatnonzero(~back)
    mean, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = standard(x, mean, spread)
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / max((y[fit] == 1).mean(), 1e-9), 0.5 / max((y[fit] == 0).mean(), 1e-9))
    for t in range(1, steps + 1):
        b = rng.choice(fit, min(128, len(fit)))
        h = np.tanh(z[b] @ p[0] + p[1])
        o = h @ p[2] + p[3]
        g = (1 / (1 + np.exp(-np.clip(o, -30, 30))) - y[b]) * weight[b] / len(b)
        back_h = np.outer(g, p[2]) * (1 - h**2)
        grads = [z[b].T @ back_h + 1e-3 * p[0], back_h.sum(axis=0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
        for k, gr in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gr
            v[k] = 0.999 * v[k] + 0.001 * gr**2
            p[k] -= 0.01 * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, spread, p[0], p[1], p[2], float(p[3][0]))
    if back.any():
        o, target, w = net.output(x[back]), y[back], weight[back]
        loss = [(-(w * np.log(1e-12 + np.where(target == 1, s := 1 / (1 + np.exp(-np.clip(o / t, -30, 30))), 1 - s))).sum(), t) for t in np.geomspace(0.25, 8, 60)]
        net.temperature = float(min(loss)[1])
    net.shift = float(np.log(prior / (1 - prior)))
    return net


@dataclass
class Model:
    contexts: np.ndarray | None
    network: Network | None
    constant: float = 0.5
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.score(np.array([pooled(t, words) for t in texts], dtype=np.float32).reshape(len(texts), -1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = 0, per_label: int = PER_LABEL) -> Model:
    """Learns from labelled rows outside the held-out fold, from at most `per_label` of each class; word vectors come from all documents.

    Rows with a null id, a null label or a label other than 0 and 1 teach nothing; an id labelled twice counts with the larger label.
    With no or one class, every document scores that class's share (0.5 with none).
    """
    known = labels.filter(remainder("doc_id", folds) != held).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    shares = {int(r[0]): r[1] for r in known.groupBy(label).count().collect()}
    if len(shares) < 2:
        return Model(None, None, float(next(iter(shares), 0.5)))
    rows = fitted_rows(docs, bounded_ids(known, label, per_label), label, FIT_CHARS)
    texts, y = [r["text"] for r in rows], np.array([r[label] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(None, None, shares.get(1, 0) / sum(shares.values()))
    contexts = context_vectors(docs)
    words = Words(contexts)
    x = np.array([pooled(t, words) for t in texts], dtype=np.float64)
    return Model(contexts, train(x, y, shares[1] / (shares[0] + shares[1])))


def scored(docs: DataFrame, model: Model, folds: int = FOLDS, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`(doc_id, text), over whole texts.

    Null and empty texts score as texts of no words. Rows that repeat an id stay. A null id is in no fold, so held_out is null.
    Other columns are ignored. No documents give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(shared.value.key, lambda: Words(shared.value.contexts))
        for keys, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(shared.value.scores(texts, words).astype(np.float64))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts (score of THRESHOLD or more), with the columns of `docs`."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(shared.value.key, lambda: Words(shared.value.contexts))
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")], ["doc_id", "text"])
            scores = [shared.value.scores(texts, words) for _, texts in text_slices([only])]
            yield batch.filter(pa.array(np.concatenate(scores or [np.zeros(0)]) >= THRESHOLD))

    return docs.mapInArrow(run, schema)
