"""Toxicity by a linear-chain conditional random field over words.

Labels mark whole documents. Words of the fitting texts that stand out in toxic ones (or whose first letters do) are the
labelled toxic tokens; all others are labelled as clean. The field has two states; a word's potentials come from features of
the word and of its neighbours. Forward-backward gives every token's marginal. A document's score is a logistic function of its
largest marginal, the expected number of toxic tokens and their share; runs of tokens above a half are the offending spans.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, fitted_rows, remainder, remembered, text_slices

#: The fit uses at most so many labelled rows of each class, whole texts up to so many characters in all. Scores read whole texts.
PER_LABEL, FIT_CHARS = 900, 18_000_000
BUCKETS = 1 << 16
#: Tokens that are worked on side by side: a document's chain is dealt into such runs, and what passes from run to run keeps it whole.
RUN = 64
FOLDS, HELD, THRESHOLD, SPAN = 4, 2, 0.3, 0.5
#: A feature marks toxic tokens if it occurs in RATIO times more families of toxic texts than of clean ones, by share, in LEAST at
#: least, and not by chance: the expected share of false marks is FALSE (Benjamini and Hochberg).
RATIO, LEAST, FALSE = 8.0, 4, 0.02
CACHE = 300_000
_CORE = re.compile(r"[^\W_]+", re.U)
#: Signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")


def core_of(word: str) -> str:
    """The word in lower case, with signs for letters read as letters, without what stands around it."""
    low = word.lower()
    found = _CORE.findall(low)
    if len(found) == 1 and found[0].isalpha():
        return found[0]
    if any(c.isalpha() for c in low):
        return "".join(_CORE.findall(low.translate(LEET))) or low
    return low


def features_of(core: str) -> list[tuple[str, int]]:
    """The word itself (0) and its first letters (4 to 6)."""
    n = len(core)
    if n <= 4:
        return [(core, 0)]
    if n <= 6:
        return [(core, 0), (core[:4], 4)] if n == 5 else [(core, 0), (core[:4], 4), (core[:5], 5)]
    return [(core, 0), (core[:4], 4), (core[:5], 5), (core[:6], 6)]


def bucket(feature: tuple[str, int]) -> int:
    text, kind = feature
    return xxhash.xxh32_intdigest(text if text.isascii() else text.encode("utf-8", "surrogatepass"), kind) % BUCKETS


@dataclass
class Field:
    """Weights by feature bucket for the word itself, the word before and the word after; transitions and start between states."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray  # 2 x 2
    start: np.ndarray

    def odds(self, toxic: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """toxic: runs x RUN potentials of the toxic state (the clean one has 0), `text` the chain that each run goes on with.

        → by place and run: the odds of the two states from all that stands before a token (itself included), from all behind it, and the
        token's own. A run's tokens multiply to a 2 x 2 matrix; these carry the odds over the borders of runs, so runs change nothing.
        """
        (t00, t01), (t10, t11) = np.exp(self.step)
        e = np.exp(np.clip(toxic.T, -30, 30))
        width, n = e.shape
        m = np.zeros((2, 2, n))
        m[0, 0], m[1, 1] = 1.0, e[0]
        for k in range(1, width):
            new = np.stack([m[:, 0] * t00 + m[:, 1] * t10, (m[:, 0] * t01 + m[:, 1] * t11) * e[k]], axis=1)
            m = np.where(length > k, new / new.sum(axis=(0, 1)), m)
        first = np.append(True, text[1:] != text[:-1])
        (a, b), (c, d) = m.tolist()
        begin, enter, f = float(np.exp(self.start[1] - self.start[0])), [0.0] * n, 1.0
        for k, new_text in enumerate(first.tolist()):
            u = enter[k] = begin if new_text else (t01 + t11 * f) / (t00 + t10 * f)
            f = (b[k] + u * d[k]) / (a[k] + u * c[k])
        leave, g = [1.0] * n, 1.0
        for k in range(n - 2, -1, -1):
            if first[k + 1]:
                g = 1.0
            else:
                x = (c[k + 1] + d[k + 1] * g) / (a[k + 1] + b[k + 1] * g)
                g = (t10 + t11 * x) / (t00 + t01 * x)
            leave[k] = g
        f, g = np.empty_like(e), np.empty_like(e)
        f[0], g[-1] = np.array(enter) * e[0], leave
        for k in range(1, width):
            f[k] = e[k] * (t01 + t11 * f[k - 1]) / (t00 + t10 * f[k - 1])
        for k in range(width - 2, -1, -1):
            x = e[k + 1] * g[k + 1]
            g[k] = np.where(length <= k + 1, g[-1], (t10 + t11 * x) / (t00 + t01 * x))
        return f, g, e

    def posteriors(self, toxic: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
        """runs x RUN marginals of the toxic state, by forward-backward over whole chains."""
        f, g, _ = self.odds(toxic, length, text)
        return (f * g / (1 + f * g)).T

    def marginals(self, toxic: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marginals, and by run the expected transitions (n x 2 x 2), those from its last token into the next run included."""
        f, g, e = self.odds(toxic, length, text)
        width, n = e.shape
        last = length - 1
        goes_on = np.append(text[1:] == text[:-1], False)
        k, r = np.nonzero((np.arange(width)[:, None] < last) | ((np.arange(width)[:, None] == last) & goes_on))
        inner = k < last[r]
        behind = np.where(inner, k + 1, 0), np.where(inner, r, r + 1)
        x = e[behind] * g[behind]
        (t00, t01), (t10, t11) = np.exp(self.step)
        own = np.stack([np.full(len(k), t00), t01 * x, t10 * f[k, r], t11 * f[k, r] * x])
        own /= own.sum(axis=0)
        pairs = np.stack([np.bincount(r, w, n) for w in own], axis=1).reshape(n, 2, 2)
        return (f * g / (1 + f * g)).T, pairs


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How texts of these many tokens are dealt into runs: (place of each token in runs x RUN, length of each run, its text)."""
    rows = -(-sizes // RUN)
    text = np.repeat(np.arange(len(sizes)), rows)
    first = np.cumsum(rows) - rows
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * RUN, sizes)
    length = np.minimum(sizes[text] - (np.arange(len(text)) - first[text]) * RUN, RUN)
    return place, length, text


def dealt(tokens: np.ndarray, place: np.ndarray, runs: int, none: float) -> np.ndarray:
    out = np.full(runs * RUN, none, dtype=tokens.dtype)
    out[place] = tokens
    return out.reshape(runs, RUN)


def neighbours(tokens: np.ndarray, sizes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the token after each one of its text."""
    left, right = np.append(none, tokens[:-1]), np.append(tokens[1:], none)
    ends = np.cumsum(sizes[sizes > 0])
    left[ends[:-1]], right[ends - 1] = none, none
    return left, right


def train_field(tokens: np.ndarray, sizes: np.ndarray, gold: np.ndarray, buckets: np.ndarray, words: np.ndarray, epochs: int = 6, seed: int = 11) -> Field:
    """tokens: the word types of all texts (`sizes` each), gold: their states, buckets: types x features, words: the bucket of each type's word. AdaGrad on the likelihood."""
    rng = np.random.default_rng(seed)
    f = Field(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros(2))
    seen = {k: np.full(getattr(f, k).shape, 1e-2) for k in ("own", "before", "after", "step", "start")}
    none = len(buckets) - 1
    place, length, text = places(sizes)
    runs = len(length)
    rows = [dealt(t, place, runs, none) for t in (tokens, *neighbours(tokens, sizes, none))]
    states = [dealt(t, place, runs, -1) for t in (gold, neighbours(gold, sizes, -1)[1])]
    first = np.searchsorted(text, np.arange(len(sizes) + 1))
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(sizes))
        lot = np.cumsum((first[1:] - first[:-1])[order]) // 512
        for texts in np.split(order, np.flatnonzero(np.diff(lot)) + 1) if len(order) else []:
            b = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])
            x, left, right = (r[b] for r in rows)
            y, after = (r[b] for r in states)
            score = f.own[buckets].sum(axis=1)[x] + f.before[words][left] + f.after[words][right]
            p, pairs = f.marginals(score, length[b], text[b])
            live = y >= 0
            d = np.where(live, y - p, 0.0) / 8
            g = {k: np.zeros_like(getattr(f, k)) for k in seen}
            np.add.at(g["own"], buckets, np.bincount(x.ravel(), d.ravel(), len(buckets))[:, None])
            np.add.at(g["before"], words, np.bincount(left.ravel(), d.ravel(), len(buckets)))
            np.add.at(g["after"], words, np.bincount(right.ravel(), d.ravel(), len(buckets)))
            for i in (0, 1):
                for j in (0, 1):
                    g["step"][i, j] = ((y == i) & (after == j)).sum() - pairs[:, i, j].sum()
            g["step"] /= 64
            head = np.append(True, text[b][1:] != text[b][:-1])
            g["start"] = (np.bincount(y[head, 0], minlength=2) - np.array([(1 - p[head, 0]).sum(), p[head, 0].sum()])) / 64
            for k in seen:
                w = getattr(f, k)
                grad = g[k] - 1e-4 * w
                seen[k] += grad**2
                w += 0.3 * grad / np.sqrt(seen[k])
            f.own[BUCKETS] = f.before[BUCKETS] = f.after[BUCKETS] = 0.0
    return f


@dataclass
class Model:
    field_: Field | None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float = 0.5
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass
class Words:
    """Potentials of words as they are met: for the word, the one before it and the one after it."""

    model: Field
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((CACHE + 1, 3)))

    def __post_init__(self):
        self.weights = self.model.own.tolist(), self.model.before.tolist(), self.model.after.tolist()

    def ids(self, words: list[str]) -> np.ndarray:
        get, rows = self.rows.get, self.rows
        out = [get(w, -1) for w in words]
        if -1 in out:
            fresh = list(dict.fromkeys(w for w, k in zip(words, out, strict=True) if k < 0))
            if len(rows) + len(fresh) > CACHE:
                rows.clear()
                fresh = list(dict.fromkeys(words))
            own, before, after = self.weights
            new = []
            for w in fresh:
                kinds = features_of(core_of(w))
                word = bucket(kinds[0])
                new.append((own[word] + sum([own[bucket(x)] for x in kinds[1:]]), before[word], after[word]))
            first = len(rows)
            self.table[first : first + len(new)] = new
            rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            out = [rows[w] for w in words]
        return np.array(out, dtype=np.int64)

    def of_texts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of every word of each text, each text one chain."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        words = [w for t in texts for w in t]
        if not words:
            return [np.zeros(0) for _ in texts]
        # the table may start afresh between these parts, so potentials are taken at once
        own = np.concatenate([self.table[self.ids(words[at : at + CACHE // 2])] for at in range(0, len(words), CACHE // 2)])
        ends = np.cumsum(sizes[sizes > 0])
        inside = np.ones(len(words), dtype=bool)
        inside[ends - 1] = False
        toxic = own[:, 0].copy()
        toxic[1:] += np.where(inside[:-1], own[:-1, 1], 0.0)
        toxic[:-1] += np.where(inside[:-1], own[1:, 2], 0.0)
        place, length, text = places(sizes)
        p = self.model.posteriors(dealt(toxic, place, len(length), 0.0), length, text).ravel()[place]
        return np.split(p, np.cumsum(sizes)[:-1])


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's score reads: one, largest marginal, expected toxic tokens (log), their share (root)."""
    return np.array([1.0, p.max(), np.log1p(p.sum()), np.sqrt(p.mean())]) if len(p) else np.array([1.0, 0.0, 0.0, 0.0])


def _family(words: list[str]) -> int:
    """The smallest hash of the text's runs of five words: copies of a text mostly share it."""
    return min((xxhash.xxh64_intdigest(" ".join(words[k : k + 5]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 4))), default=0)


def token_labels(texts: list[list[str]], toxic: list[bool]) -> set[tuple[str, int]]:
    """Features that mark toxic tokens: those in clearly more families of toxic texts than of clean ones."""
    where = (defaultdict(set), defaultdict(set))
    families: tuple[set, set] = (set(), set())
    for cores, t in zip(texts, toxic, strict=True):
        family = _family(cores)
        families[t].add(family)
        for x in {x for c in set(cores) if len(c) > 2 for x in features_of(c)}:
            where[t][x].add(family)
    share = len(families[1]) / max(1, len(families[0]) + len(families[1]))
    tested = sorted((_tail(len(own), len(own) + len(where[0].get(x, ())), share), x) for x, own in where[1].items() if len(own) >= LEAST)
    last = max((k for k, (p, _) in enumerate(tested, 1) if p <= FALSE * k / len(tested)), default=0)
    return {x for _, x in tested[:last] if len(where[1][x]) * (1 - share) > RATIO * len(where[0].get(x, ())) * share}


def _tail(k: int, n: int, share: float) -> float:
    """Chance of k or more of n at this share."""
    if n > 300:
        return 0.5 * math.erfc((k - 0.5 - n * share) / math.sqrt(2 * n * share * (1 - share)))
    return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, n + 1))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, per_label: int = PER_LABEL) -> Model:
    """Learns from labelled rows outside the held-out fold, from at most `per_label` of each class.

    Rows with a null id or a label other than 0 and 1 teach nothing; an id labelled twice counts with the larger label. With no or one class,
    every document scores that class's share (0.5 with none).
    """
    known = labels.filter(remainder("doc_id", folds) != held).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    shares = {int(r[0]): r[1] for r in known.groupBy(label).count().collect()}
    if len(shares) < 2:
        return Model(None, constant=float(next(iter(shares), 0.5)))
    rows = fitted_rows(docs, bounded_ids(known, label, per_label), label, FIT_CHARS)
    y = np.array([r[label] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(None, constant=shares.get(1, 0) / sum(shares.values()))
    texts = [[core_of(w) for w in (r["text"] or "").split()] for r in rows]
    part = np.random.default_rng(11).random(len(y)) < 0.65
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part = np.ones(len(y), bool)
    found = _field_of([t for t, a in zip(texts, part, strict=True) if a], y[part])
    # the document's score is fitted on texts that the field has not seen
    own = ~part if not part.all() else part
    table = Words(found)
    z = np.array([summary(p) for t, a in zip(texts, own, strict=True) if a for p in table.of_texts([t])])
    prior, target = shares[1] / (shares[0] + shares[1]), y[own]
    weight = np.where(target == 1, prior / (target == 1).mean(), (1 - prior) / (target == 0).mean())
    return Model(found, logistic(z, target, weight))


def _field_of(texts: list[list[str]], y: np.ndarray) -> Field:
    marks = token_labels(texts, (y == 1).tolist())
    kinds = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    names = [features_of(w) for w in kinds]
    width = max(map(len, names), default=1)
    buckets = np.full((len(kinds) + 1, width), BUCKETS)
    for k, own in enumerate(names):
        buckets[k, : len(own)] = [bucket(x) for x in own]
    words = np.append(buckets[:-1, 0], BUCKETS)
    hit = np.array([any(x in marks for x in own) for own in names] + [False])
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    tokens = np.array([kinds[w] for t in texts for w in t], dtype=np.int64)
    return train_field(tokens, sizes, (hit[tokens] & (np.repeat(y, sizes) == 1)).astype(np.int64), buckets, words)


def _spans(text: str, p: np.ndarray, found: list[re.Match]) -> list[str]:
    out, at = [], None
    for k, q in enumerate([*p, 0.0]):
        if q >= SPAN and at is None:
            at = k
        elif q < SPAN and at is not None:
            out.append(f"{found[at].start()}:{found[k - 1].end()}")
            at = None
    return out


_WORD = re.compile(r"\S+")


def scored(docs: DataFrame, model: Model, folds: int = FOLDS, held: int = HELD, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of `docs`(doc_id, text), over whole texts.

    spans: "start:end" of the toxic runs in characters, end exclusive, comma-joined; empty without any. Null and empty texts score as texts
    without words. Rows that repeat stay; a null id is in no fold, so held_out is null. Other columns are ignored. No documents give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = remembered(m.key, lambda: Words(m.field_)) if m.field_ else None
        for keys, texts in text_slices(batches):
            if table is None:
                score, spans = [m.constant] * len(texts), [""] * len(texts)
            else:
                split = [(t or "").split() for t in texts]
                score, spans, at = [], [], 0
                while at < len(texts):
                    to, n = at + 1, len(split[at])
                    while to < len(texts) and n + len(split[to]) <= 40_000:
                        n += len(split[to])
                        to += 1
                    for t, p in zip(texts[at:to], table.of_texts(split[at:to]), strict=True):
                        score.append(1 / (1 + np.exp(-float(np.clip(summary(p) @ m.weights, -30, 30)))))
                        spans.append(",".join(_spans(t, p, list(_WORD.finditer(t)))) if len(p) and p.max() >= SPAN else "")
                    at = to
            yield pa.RecordBatch.from_arrays([keys, pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans string")
    return out.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
