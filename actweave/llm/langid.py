"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one, so that no filter misses a place.
Filters of several widths slide over a window's embedded bytes; the largest response of each filter feeds a softmax. Forward,
backward and training are numpy. A filter response is the sum of one value for each byte of its reach, so bytes are looked up in
tables of (place, byte) values rather than embedded and multiplied. A document's prediction is the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, fitted_rows, remainder, text_slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: The fit uses at most so many rows of each language, whole texts up to so many characters in all. Predictions read whole texts.
PER_LANGUAGE, FIT_CHARS = 400, 8_000_000
#: So many languages are learned at most, those with the most documents; what reaches the driver is bounded by all three.
LANGUAGES = 128
FOLDS, HELD = 3, 1
UNKNOWN = "und"
STEP = WINDOW - max(WIDTHS) + 1
#: Windows worked on at once.
AT_ONCE = 512


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros; an empty text has none."""
    n = len(data)
    count = 1 + max(0, -(-(n - WINDOW) // STEP)) if n else 0
    padded = np.zeros(max(0, (count - 1) * STEP + WINDOW), dtype=np.uint8)
    padded[:n] = np.frombuffer(data, dtype=np.uint8)
    if not count:
        return np.zeros((0, WINDOW), dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


@dataclass
class Network:
    """Byte embedding, filters by width, and the softmax layer."""

    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # width x EMBEDDING x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    classes: list[str]

    def tables(self) -> list[np.ndarray]:
        """By width: pairs of bytes → the share of a response that two neighbouring places give, and of a single last place."""
        found = []
        for f in self.filters:
            one = [(self.embedding @ f[k]).astype(np.float32) for k in range(len(f))]
            parts = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(f) - 1, 2)]
            found.append([np.ascontiguousarray(x) for x in parts] + ([one[-1]] if len(f) % 2 else []))
        return found

    def pooled(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Largest response of each filter in each window of x (n x WINDOW bytes)."""
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        out = []
        for f, b, parts in zip(self.filters, self.bias, tables, strict=True):
            n = WINDOW - len(f) + 1
            total = parts[0].take(pair[:, :n], axis=0)
            for k, part in enumerate(parts[1:], 1):
                total += part.take(pair[:, 2 * k : 2 * k + n] if part.shape[0] == 65536 else x[:, 2 * k : 2 * k + n], axis=0)
            out.append(np.maximum(total.max(axis=1) + b.astype(np.float32), 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        z = self.pooled(x, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[np.ndarray], y: np.ndarray, classes: list[str], steps: int = 500, batch: int = 64, seed: int = 3) -> Network:
    """Adam on the cross entropy of windows. `texts` holds the windows of each text, at least one; classes are drawn evenly, then texts of a class, then windows of a text."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "ob": np.zeros(len(classes))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)), np.zeros(FILTERS)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    members = [np.flatnonzero(y == c) for c in range(len(classes))]
    size = np.array([len(t) for t in texts])
    begin, x = np.cumsum(size) - size, np.concatenate(texts)
    for t in range(1, steps + 1):
        own = np.concatenate([rng.choice(mine, -(-batch // len(classes))) for mine in members])
        bytes_, target = x[begin[own] + (rng.random(len(own)) * size[own]).astype(np.int64)], y[own]
        emb = p["e"][bytes_]
        pools, tops = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            r = sum(emb[:, k : k + n] @ p[f"f{w}"][k] for k in range(w)) + p[f"b{w}"]
            tops.append(r.argmax(axis=1))
            pools.append(np.maximum(r.max(axis=1), 0))
        h = np.concatenate(pools, axis=1)
        z = h @ p["o"] + p["ob"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(own)), target] -= 1
        q /= len(own)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["o"], g["ob"] = h.T @ q + 1e-4 * p["o"], q.sum(axis=0)
        dh = (q @ p["o"].T) * (h > 0)
        rows = np.arange(len(own))[:, None]
        for a, w in enumerate(WIDTHS):
            d, top = dh[:, a * FILTERS : (a + 1) * FILTERS], tops[a]
            g[f"b{w}"] = d.sum(axis=0)
            for k in range(w):
                at = bytes_[rows, top + k]
                g[f"f{w}"][k] = np.einsum("nfe,nf->ef", p["e"][at], d)
                np.add.at(g["e"], at, d[:, :, None] * p[f"f{w}"][k].T[None])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"].astype(np.float32), p["ob"].astype(np.float32), classes)


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD, per_language: int = PER_LANGUAGE, seed: int = 3) -> Network | list[str]:
    """Learns from text and non-null lang of rows outside the held-out fold; with fewer than two languages it returns those there are.

    A language of empty texts only is not learned, nor are those beyond the LANGUAGES most frequent ones. Rows with a null id, text or lang teach nothing; other columns are ignored; no documents give no language.
    """
    known = docs.filter((remainder("doc_id", folds) != held) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang").distinct()
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    known = known.join(F.broadcast(most), "lang", "left_semi").select("doc_id", "lang")
    rows = fitted_rows(docs, bounded_ids(known, "lang", per_language), "lang", FIT_CHARS, on=("doc_id", "lang"))
    rows = [r for r in rows if r["text"]]
    classes = sorted({r["lang"] for r in rows})
    if len(classes) < 2:
        return classes
    place = {c: k for k, c in enumerate(classes)}
    return train([windows(r["text"].encode("utf-8", "replace")) for r in rows], np.array([place[r["lang"]] for r in rows]), classes, seed=seed)


def predicted(docs: DataFrame, model: Network | list[str], folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`(doc_id, text), over whole texts.

    `und` with score 0 for a null text and for one without a letter. Where one language was learned, every other text has it with score 1;
    where none was, `und`. Ties go to the language that sorts first. Rows that repeat stay; a null id is in no fold, so held_out is null.
    Other columns are ignored, whatever their names. No documents give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if isinstance(net, Network) else []
        for keys, texts in text_slices(batches):
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            if not isinstance(net, Network):
                lang, score = [(net[0] if net else UNKNOWN) if a else UNKNOWN for a in lettered], [1.0 if a and net else 0.0 for a in lettered]
            else:
                cut = [windows(t.encode("utf-8")) if a else np.zeros((0, WINDOW), np.uint8) for t, a in zip(texts, lettered, strict=True)]
                total = np.zeros((len(texts), len(net.classes)))
                whole = np.concatenate(cut)
                of = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
                for at in range(0, len(whole), AT_ONCE):
                    np.add.at(total, of[at : at + AT_ONCE], net.probabilities(whole[at : at + AT_ONCE], tables))
                total /= np.maximum([[len(c)] for c in cut], 1)
                lang = [net.classes[k] if a else UNKNOWN for k, a in zip(total.argmax(axis=1), lettered, strict=True)]
                score = total.max(axis=1).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([keys, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
