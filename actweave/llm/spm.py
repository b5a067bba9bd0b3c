"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces and one Viterbi pass.

The automaton reads a text once. At every position its output links name the pieces that end there, and each relaxes the
position's state. For a unigram model the state is the best sum of scores. For a merge (BPE) model sums of scores do not give
the model's own encoding, so the state is the last piece, and a piece relaxes it if the merges of the joined pair give that
very pair back; exactly one piece does, and the path is the encoding that the merges give.
No piece holds a space mark after another character, so text is cut into words before each run of space marks; a word is cut again
between two characters that stand together in no piece. New words are read many at once: the pass goes on by one position in all
segments together, in numpy. Words are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers; when full, it forgets those not met since it was last full.
REMEMBERED = 80_000
#: Characters of new words that go through the automaton at once, and slots for what is known of pairs of pieces (a power of two).
AT_ONCE, PAIRS = 100_000, 1 << 21
#: Segments of more characters than this go through the pass one by one, with the same result.
LONG = 128
#: Characters of text whose words are looked up at once.
SLICE = 500_000


@dataclass
class Vocabulary:
    """Pieces and scores of a model without the library's objects, so that it can be sent to executors."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # by byte value; empty without byte fallback
    special: frozenset[int]
    unknown: int
    merges: bool
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    seen: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    courses: dict[int, tuple | None] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str = MODEL, merges: bool | None = None) -> Vocabulary:
        """Reads the model with the library. A model whose scores are whole ranks is one of merges unless `merges` says otherwise."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        special = frozenset(i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i))
        bytes_ = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        scores = [p.get_score(i) for i in range(n)]
        if merges is None:
            merges = all(s == int(s) for s in scores)
        out = cls([p.id_to_piece(i) for i in range(n)], scores, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], special | frozenset(bytes_.values()), p.unk_id(), merges)
        if any(MARK in x.lstrip(MARK) for i, x in enumerate(out.pieces) if i not in out.special):
            raise ValueError("pieces that run over a space mark are not supported")
        return out

    def __getstate__(self) -> dict:
        """What defines the vocabulary; all that is derived from it is made again where it is needed."""
        return {k: self.__dict__[k] for k in ("pieces", "scores", "byte_ids", "special", "unknown", "merges", "key")} | {"seen": {}, "older": {}, "courses": {}}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.pieces) if i not in self.special}

    @cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each character, which classes stand side by side in some piece); characters of no longer piece have class 0."""
        longer = [x for x in self.ids if len(x) > 1]
        chars = sorted({c for x in longer for c in x})
        kind = np.zeros(0x110000, dtype=np.int16)
        kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        near = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for x in longer:
            k = kind[[ord(c) for c in x]]
            near[k[:-1], k[1:]] = True
        return kind, near

    @cached_property
    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for x, i in self.ids.items():
            if len(x) > 1:
                out.add_word(x, i)
        out.make_automaton()
        return out

    @cached_property
    def single(self) -> np.ndarray:
        """The piece of each character by itself (-1: none): what would be the last output link of any place."""
        out = np.full(0x110000, -1, dtype=np.int32)
        for x, i in self.ids.items():
            if len(x) == 1:
                out[ord(x)] = i
        return out

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.pieces], dtype=np.int64)

    @cached_property
    def between(self) -> str:
        """A character of no piece."""
        used = {c for x in self.ids for c in x}
        return next(c for c in map(chr, range(1, 0xD800)) if c not in used)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, whether its second piece can follow its first), by a hash of the pair; a new pair takes the slot of an older one."""
        return np.full(PAIRS, -1, dtype=np.int64 if len(self.pieces) >= 1 << 15 else np.int32), np.zeros(PAIRS, dtype=bool)

    @cached_property
    def decoding(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all pieces, where each begins, how many it has): what ids decode to."""
        value = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        raw = [value.get(i, b"" if i in self.special else x.replace(MARK, " ").encode("utf-8")) for i, x in enumerate(self.pieces)]
        size = np.array(list(map(len, raw)), dtype=np.int64)
        return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size, size

    def _merges(self, parts: list[str]) -> Iterator[tuple[float, list[str]]]:
        """Merges neighbours, best score first and leftmost among equals; after each merge its rank (the score's negative) and the parts, "" for those merged away."""
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        parts = list(parts)
        ids, scores, heap = self.ids, self.scores, []

        def offer(k: int) -> None:
            if k >= 0 and right[k] >= 0 and (i := ids.get(parts[k] + parts[right[k]])) is not None:
                heapq.heappush(heap, (-scores[i], k, parts[k], parts[right[k]]))

        for k in range(len(parts)):
            offer(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if parts[k] != a or right[k] < 0 or parts[right[k]] != b:
                continue  # one of the two has been merged since
            gone = right[k]
            parts[k], parts[gone], right[k] = a + b, "", right[gone]
            if right[k] >= 0:
                left[right[k]] = k
            offer(k)
            offer(left[k])
            yield rank, parts

    def _merged(self, parts: list[str]) -> list[str]:
        for _, parts in self._merges(parts):  # noqa: B007, B020, PLR1704
            pass
        return [x for x in parts if x]

    def _course(self, i: int) -> tuple | None:
        """How piece i comes about alone: (first parts, last parts, ranks), parts at the edges before and after each merge; None if it does not."""
        if i not in self.courses:
            text = list(self.pieces[i])
            first, last, ranks, parts = [text[0]], [text[-1]], [], text
            for rank, parts in self._merges(text):  # noqa: B007
                ranks.append(rank)
                first.append(parts[0])
                last.append(next(x for x in reversed(parts) if x))
            self.courses[i] = (first, last, [*ranks, math.inf]) if [x for x in parts if x] == [self.pieces[i]] else None
        return self.courses[i]

    def _fit(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a (-1: it starts the segment) in an encoding by merges: no merge over their border comes first."""
        to = self._course(b)
        if to is None:
            return False
        if a < 0:
            return True
        _, last, ranks_a = self._course(a)
        first, _, ranks_b = to
        ids, scores, m, n = self.ids, self.scores, 0, 0
        while True:
            over = ids.get(last[m] + first[n])
            rank_a, rank_b = ranks_a[m], ranks_b[n]
            if over is not None and -scores[over] < rank_a and -scores[over] <= rank_b:
                return False
            if rank_a <= rank_b:
                if rank_a == math.inf:
                    return True
                m += 1
            else:
                n += 1

    def _fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8")) if self.byte_ids else (self.unknown,)

    def _whole(self, parts: list[str]) -> list[int]:
        return list(chain.from_iterable((self.ids[x],) if x in self.ids else self._fallback(x) for x in parts))

    def _follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """`_fit` of many pairs; each is worked out once and remembered."""
        known, ok = self.pairs
        pair = (before + 1) * len(self.pieces) + piece
        slot = (pair * 0x9E3779B1 >> 7) & (PAIRS - 1)
        out, new = ok[slot], known[slot] != pair
        if new.any():
            fresh, back = np.unique(pair[new], return_inverse=True)
            out[new] = np.array([self._fit(p // len(self.pieces) - 1, p % len(self.pieces)) for p in fresh.tolist()])[back]
            known[slot[new]], ok[slot[new]] = pair[new], out[new]
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of one segment, by one pass of the automaton."""
        if self.merges and s.startswith(MARK * 2):  # runs of marks tie in score: merged as they stand, at any length
            return self._whole(self._merged(list(s)))
        char = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n = len(s)
        links, low = self._links(s, char), self.low
        piece, size_of, best = [-1] * (n + 1), [1] * (n + 1), [0.0] + [-math.inf] * n  # the last piece up to each position; -1: the bytes of a character
        done = np.zeros(n + 1, dtype=bool)
        for end, i, size in zip(*(x.tolist() for x in links), strict=True):
            before = end + 1 - size
            if self.merges:
                if not done[end + 1] and self._fit(piece[before], i):
                    piece[end + 1], size_of[end + 1], done[end + 1] = i, size, True
            elif best[before] + (self.scores[i] if i >= 0 else low) > best[end + 1]:
                piece[end + 1], size_of[end + 1], best[end + 1] = i, size, best[before] + (self.scores[i] if i >= 0 else low)
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(reversed(self._fallback(s[n - 1])))
            n -= size_of[n]
        out.reverse()
        return out

    @cached_property
    def low(self) -> float:
        """Score of a character that no piece has."""
        return min(self.scores, default=0.0) - 10

    def _links(self, text: str, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, piece, size) of all output links on the way through `text`, by place of their last character and longest first.

        For models of scores, a character that is no piece has a link of its own (-1).
        """
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64)
        end, piece, own = flat[::2], flat[1::2], self.single[char]
        alone = np.arange(len(char)) if not self.merges else np.flatnonzero(own >= 0)
        where = np.searchsorted(end, alone, side="right")
        return np.insert(end, where, alone), np.insert(piece, where, own[alone]), np.insert(self.sizes[piece], where, 1)

    def _pass(self, text: str, char: np.ndarray, start: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pass of the automaton over `text`: the last piece (-1: bytes) up to each character, and its characters.

        `start` names the first character of each one's segment; segments don't see each other. Output links are followed position
        by position of all segments at once, longest piece first. `alone` marks segments that are left out.
        """
        end, piece, size = self._links(text, char)
        first = np.concatenate([[True], end[1:] != end[:-1]])
        link = np.arange(len(end)) - np.maximum.accumulate(np.where(first, np.arange(len(end)), 0))
        use = ~alone[end]
        end, piece, size, link = end[use], piece[use], size[use], link[use]
        turn = (end - start[end]) << 8 | link
        order = np.argsort(turn, kind="stable")
        end, piece, size, turn = end[order], piece[order], size[order], turn[order]
        gain = np.where(piece < 0, self.low, np.array(self.scores)[piece])
        n = len(text)
        last, width, best = np.full(n, -1, dtype=np.int64), np.ones(n, dtype=np.int64), np.full(n, -np.inf)
        reached = np.zeros(n, dtype=bool)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]]).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            e, p, w = end[a:b], piece[a:b], size[a:b]
            before = e - w
            first = before < start[e]
            if self.merges:
                open_ = ~reached[e]
                e, p, w, before, first = e[open_], p[open_], w[open_], before[open_], first[open_]
                ok = self._follows(np.where(first, -1, last[before]), p)
                reached[e[ok]] = True
            else:
                total = np.where(first, 0.0, best[before]) + gain[a:b]
                ok = total > best[e]
                best[e[ok]] = total[ok]
            last[e[ok]], width[e[ok]] = p[ok], w[ok]
        return last, width

    def _starts(self, char: np.ndarray) -> np.ndarray:
        """For each character the first one of its segment: a segment ends between two characters that stand together in no piece."""
        kind, near = self.together
        k = kind[char]
        start = np.arange(len(char))
        start[1:][near[k[:-1], k[1:]]] = 0
        return np.maximum.accumulate(start)

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of each of `words`, a mark put before it."""
        part, chars = [], 0
        for w in words:
            if len(w) > AT_ONCE:  # in parts that end where a segment does
                whole, parts = MARK + w, [0]
                heads = np.unique(self._starts(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64))).tolist()
                for h, after in zip(heads, [*heads[1:], len(whole)], strict=True):
                    if after - parts[-1] > AT_ONCE and h > parts[-1]:
                        parts.append(h)
                self.seen[w] = b"".join([self._codes([whole[a:b]])[0] for a, b in zip(parts, [*parts[1:], len(whole)], strict=True)])
                continue
            part.append(w)
            chars += len(w) + 2
            if chars > AT_ONCE:
                self.seen.update(zip(part, self._codes([MARK + w for w in part]), strict=True))
                part, chars = [], 0
        if part:
            self.seen.update(zip(part, self._codes([MARK + w for w in part]), strict=True))

    def _codes(self, runs: list[str]) -> list[bytes]:
        """Ids of each run of characters by itself, as little-endian 32-bit integers."""
        text = self.between.join(runs)
        char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n, start = len(char), self._starts(char)
        head = np.flatnonzero(start == np.arange(n))
        tail = np.append(head[1:], n) - 1
        own = tail - head >= LONG
        if self.merges:
            own |= (char[head] == ord(MARK)) & (tail > head) & (char[np.minimum(head + 1, n - 1)] == ord(MARK))
        alone = np.repeat(own, tail - head + 1)
        last, width = self._pass(text, char, start, alone)
        chosen, at = np.zeros(n, dtype=bool), tail[~own]
        while len(at):
            chosen[at] = True
            at = (low := at - width[at])[low >= start[at]]
        single = {int(h): self.segment(text[h : t + 1]) for h, t in zip(head[own].tolist(), tail[own].tolist(), strict=True)}
        chosen[list(single)] = True
        size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) + 1
        begin = np.cumsum(size) - size
        chosen[begin[1:] - 1] = False
        at = np.flatnonzero(chosen)
        c, piece = char[at], last[at]
        bare = (piece < 0) & ~alone[at]
        count = np.where(bare, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) if self.byte_ids else 1, 1)
        whole = np.flatnonzero(alone[at])
        count[whole] = [len(single[h]) for h in at[whole].tolist()]
        where = np.cumsum(count) - count
        out = np.repeat(np.where(bare & (not self.byte_ids), self.unknown, piece), count)
        if self.byte_ids:
            table = np.array(self.byte_ids)
            for bytes_ in range(1, 5):
                mine = np.flatnonzero(bare & (count == bytes_))
                for b in range(bytes_):
                    x = c[mine] >> 6 * (bytes_ - 1 - b)
                    x = (x & 0x3F) | 0x80 if b else x | (0, 0xC0, 0xE0, 0xF0)[bytes_ - 1]
                    out[where[mine] + b] = table[x]
        for k_ in whole.tolist():
            out[where[k_] : where[k_] + count[k_]] = single[int(at[k_])]
        ends = np.cumsum(np.bincount(np.searchsorted(begin, at, side="right") - 1, count, len(runs))).astype(np.int64) * 4
        raw = out.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _words(text: str | None) -> list[str]:
        """A text's words, each standing for itself behind a mark; further marks before it are written out."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, marks = [], 0
        for w in words:
            if w:
                out.append(MARK * marks + w)
                marks = 0
            else:
                marks += 1
        if marks:
            out.append(MARK * (marks - 1))
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers: spaces become marks behind one mark put first; null and empty texts have none."""
        split = [self._words(t) for t in texts]
        codes = [list(map(self.seen.get, words)) for words in split]
        if any(None in c for c in codes):
            missing = dict.fromkeys(w for words, c in zip(split, codes, strict=True) if None in c for w, x in zip(words, c, strict=True) if x is None)
            if len(self.seen) + len(missing) > REMEMBERED:
                self.seen, self.older = {}, self.seen
            before = self.older.get
            again = {w: x for w in missing if (x := before(w)) is not None}
            self.seen.update(again)
            self.learn([w for w in missing if w not in again])
            get = self.seen.get
            codes = [c if None not in c else [get(w) if x is None else x for w, x in zip(words, c, strict=True)] for words, c in zip(split, codes, strict=True)]
        return [b"".join(c) for c in codes]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes that ids stand for, how many bytes up to each id): marks are spaces, pieces of one byte that byte."""
        raw, begin, size = self.decoding
        own = size[ids]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        return raw[np.repeat(begin[ids] - ends + own, own) + np.arange(total)].tobytes(), ends

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first one is dropped, pieces of one byte are read as UTF-8."""
        out = self.decode_bytes(np.array(ids, dtype=np.int64))[0].decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`docs` with `pieces` array<int>, the ids of each row's whole text; null and empty texts have an empty array.

    A column `pieces` that is there already is replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("pieces")
    schema = docs.select("*", F.array().cast("array<int>").alias("pieces")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = remembered(shared.value.key, lambda: shared.value)
        for batch in batches:
            at = 0
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = pa.RecordBatch.from_arrays([texts, texts], ["doc_id", "text"])
            for _, part in text_slices([rows], chars=SLICE):
                ids = v.encode_texts(part)
                sizes = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], [*own.schema.names, "pieces"])
                at += len(part)

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows(key, pieces); null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.select(key, "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = remembered(shared.value.key, lambda: shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else v.decode(x) for x in part.column(1).to_pylist()], pa.string())], [key, "text"])

    return rows.mapInArrow(run, rows.select(key, F.lit("").alias("text")).schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, pieces_sha256, round_trip) for every row, encoded and decoded over its whole text.

    pieces_sha256 is of the ids as little-endian 32-bit integers. round_trip: decoding gives the text back, with space marks
    read as spaces; true for null and empty texts, which have no pieces. Rows that repeat stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = remembered(shared.value.key, lambda: shared.value)
        own = np.zeros(len(v.pieces), dtype=bool)
        own[v.byte_ids] = True
        for keys, texts in text_slices(batches, chars=SLICE):
            codes = v.encode_texts(texts)
            n = np.array([len(c) // 4 for c in codes], dtype=np.int64)
            ids = np.frombuffer(b"".join(codes), dtype="<u4").astype(np.int64)
            ends = np.cumsum(n)
            raw = np.concatenate([[0], np.cumsum(own[ids])])
            data, upto = v.decode_bytes(ids)
            upto = np.concatenate([[0], upto])
            back = []
            for a, b, t in zip(upto[ends - n].tolist(), upto[ends].tolist(), texts, strict=True):
                a += data[a : a + 1] == b" " and a < b
                back.append(data[a:b] == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass"))
            sha = [hashlib.sha256(c).hexdigest() for c in codes]
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(raw[ends] - raw[ends - n]), pa.array(sha, pa.string()), pa.array(back, pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "round_trip"])

    out = "doc_id long, n_pieces long, n_byte_pieces long, pieces_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)
