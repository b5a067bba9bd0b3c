"""SimHash near-duplicates by a binary-trie self-join.

Texts become 64-bit fingerprints. Two fingerprints link if they differ in at most BUDGET bits. The 64 bits are dealt
into BUDGET + 1 blocks: linked fingerprints agree in at least one whole block, so rotating each block to the front and
grouping by it puts every linked pair into a common subtrie. In a subtrie, pairs of nodes are walked down together,
adding up the bits in which they differ and dropping a pair of nodes beyond the budget. Each task keeps a spanning
forest of the links it finds, which has fewer rows than fingerprints; components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices, with_facts, without
from .components import components

SEED = 42
WORDS = 4
BUDGET = 4
#: A subtrie with more fingerprints than this is dealt again by the blocks of its other bits.
SUBTRIE = 50_000
#: Pairs of nodes with at most this many pairs of fingerprints are compared one by one.
LEAF = 1024
PAIRS = 1_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text; 0 for no words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(found) <= words:
        return xx(b" ".join(found), SEED)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    hashes = np.array([xx(line[a:b], SEED) for a, b in zip((end - size).tolist(), end[words - 1 :].tolist(), strict=False)], dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        count += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches):
            fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of each block of the `bits` low bits, widest first."""
    out, at = [], 0
    for k in range(parts):
        width = bits // parts + (k < bits % parts)
        out.append((at, width))
        at += width
    return out


def _pairs(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of fingerprints of each pair of nodes, in chunks; of a node with itself, those with i < j."""
    total = size_a * size_b
    ends = np.cumsum(total)
    at = 0
    while at < len(total):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        n = total[at:to]
        which = np.repeat(np.arange(at, to), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[which] + k // size_b[which], b[which] + k % size_b[which]
        keep = ~own[which] | (i < j)
        yield i[keep], j[keep]
        at = to


def trie_links(rows: np.ndarray, roots: list[tuple[int, int]] | np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in `rows` whose words differ in at most `budget` bits, below each root.

    `rows` are unsigned words sorted within each root [lo, hi); the words of a root agree in their top `depth` bits.
    """
    roots = np.asarray(roots, dtype=np.int64).reshape(-1, 2)
    alo, ahi = roots[:, 0].copy(), roots[:, 1].copy()
    blo, bhi, err = alo.copy(), ahi.copy(), np.zeros(len(roots), dtype=np.int64)
    while len(alo):
        own = alo == blo
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth >= 64)
        if small.any():
            for i, j in _pairs((ahi - alo)[small], (bhi - blo)[small], alo[small], blo[small], own[small]):
                near = np.bitwise_count(rows[i] ^ rows[j]) <= budget
                yield i[near], j[near]
            alo, ahi, blo, bhi, err, own = (x[~small] for x in (alo, ahi, blo, bhi, err, own))
        if not len(alo):
            return
        ones = np.concatenate([[0], np.cumsum((rows >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        step = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        step = [tuple(np.concatenate(x) for x in zip(*step, tuple(y[~own] for y in (amid, ahi, blo, bmid, err + 1)), strict=True))][0]
        keep = (step[1] > step[0]) & (step[3] > step[2]) & (step[4] <= budget)
        alo, ahi, blo, bhi, err = (x[keep] for x in step)
        depth += 1


class Forest:
    """Disjoint sets over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.up[i], self.up[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (up := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = up


def _by_key(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by `key`, cut only where the key changes, so memory is bounded by `least` rows and one group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {n: table.column(n).to_numpy() for n in table.column_names}

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key[::-1] != key[-1], True)) if key[0] != key[-1] else len(key)
            if cut < len(key):
                yield columns(table.slice(0, len(key) - cut))
                held = table.slice(len(key) - cut).to_batches()
                count = cut
    if count:
        yield columns(pa.Table.from_batches(held).combine_chunks())


def near_links(distinct: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """(fp) distinct fingerprints → (u, v): a spanning forest of the links within each subtrie.

    Links not returned are implied by those that are: two fingerprints are connected by the result exactly if they are
    connected by the links of at most `budget` differing bits.
    """
    first = _blocks(64, budget + 1)
    place = F.expr(" ".join(["array(", ", ".join(f"named_struct('b', {k}, 'x', shiftright(fp, {s}) & {2**w - 1}L)" for k, (s, w) in enumerate(first)), ")"]))
    keyed = distinct.select("fp", F.explode(place).alias("p")).select("fp", (F.col("p.b") * (1 << 16) + F.col("p.x")).alias("k1"), F.col("p.b").alias("b"))
    hot = keyed.groupBy("k1").count().filter(F.col("count") > subtrie).select("k1", F.lit(1).alias("hot"))
    # The other bits of a large subtrie again hold at most `budget` errors: one of budget + 1 blocks of them agrees.
    def again(b: int) -> str:
        s, w = first[b]
        rest = f"((shiftright(fp, {s + w}) << {s}) | (fp & {2**s - 1}L))" if s + w < 64 else f"(fp & {2**s - 1}L)"
        return "array(" + ", ".join(f"{k + 1} * 65536L + (shiftright({rest}, {s2}) & {2**w2 - 1}L)" for k, (s2, w2) in enumerate(_blocks(64 - w, budget + 1))) + ")"

    more = F.expr("CASE " + " ".join(f"WHEN hot = 1 AND b = {b} THEN {again(b)}" for b in range(budget + 1)) + " ELSE array(0L) END")
    keyed = keyed.join(hot, "k1", "left").select("fp", "b", F.explode(more).alias("k2"), "k1").select("fp", "b", (F.col("k1") * (1 << 20) + F.col("k2")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            fp, key = rows["fp"].view(np.uint64), rows["key"]
            # the block that agrees comes first: its bits rotate to the top
            s = np.array([s + w for s, w in first], dtype=np.uint64)[rows["b"]]
            turned = np.where(s == 64, fp, (fp << (np.uint64(64) - s)) | (fp >> (s % np.uint64(64))))
            order = np.lexsort((turned, key))
            turned, key, fp = turned[order], key[order], fp[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            forest = Forest(len(fp))
            for i, j in trie_links(turned, np.stack([at[:-1], at[1:]], 1), min(w for _, w in first), budget):
                forest.link(i, j)
            own = np.flatnonzero(forest.up != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[forest.up[own]].view(np.int64))], ["u", "v"])

    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for every row of `docs`(doc_id, text).

    `fingerprint` is 16 lowercase hex digits. `component_id` is the smallest doc_id that links reach, the row's own
    included; it is null only if no row that is reached has an id. Empty and null texts have fingerprint zero, which links like
    any other. `copies`: rows in the component. Rows that repeat a doc_id stay, each with its own text's component.
    Other columns of `docs` are ignored. No documents give no rows.
    """
    named = _named(docs, words, budget)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def _named(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(fp, doc_id, n, root, component_id, copies) for every row; `root` tells components apart."""
    prints = materialize(fingerprints(docs, words))
    facts = materialize(components_of(prints, budget))
    return with_facts(prints, facts, "fp", "n", facts.agg(F.sum("n")).first()[0] or 0)


def components_of(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """prints(doc_id, fp) → (fp, n, root, component_id, copies) for every fingerprint: its rows, and the smallest fingerprint, the smallest id and the rows of its component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(near_links(distinct.select("fp"), budget))
    members = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"))
    whole = materialize(members.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("copies"), F.count("*").alias("members")))
    total = whole.agg(F.sum("members")).first()[0] or 0
    named = with_facts(members.select("fp", "root"), whole, "root", "members", total).select("fp", "root", "component_id", "copies")
    return distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id"), F.coalesce("copies", "n").alias("copies"))


def _with_print(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rows(row, doc_id, text) with `fp` in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], schema=pa.schema([batch.schema.field(0), batch.schema.field(1), pa.field("fp", pa.int64())]))

    return rows.mapInArrow(run, rows.select("row", "doc_id", F.lit(0).cast("long").alias("fp")).schema)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay after near-duplicate removal: of each component, the row with the smallest doc_id.

    Of rows of one component that share that id one stays; rows that share an id but lie in different components are judged apart. Rows
    without an id stay, as nothing can name them. All columns stay, whatever their names.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    near = materialize(_named(named).select("doc_id", "fp", "root", "component_id"))
    again = materialize(near.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = near.filter("doc_id <> component_id").select("doc_id")
    if again.isEmpty():
        return without(docs, materialize(gone))
    out = without(docs, materialize(gone.unionByName(again).distinct()))
    # rows that share an id are told apart by their fingerprints
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _with_print(rows.join(again, "doc_id", "left_semi").select("row", "doc_id", "text"))
    place = near.filter("doc_id = component_id").select("doc_id", "fp", "root").distinct()
    one = Window.partitionBy("doc_id", "root").orderBy("fp", F.xxhash64("row.text"))
    stay = rows.join(place, ["doc_id", "fp"]).withColumn("rank", F.row_number().over(one)).filter("rank = 1")
    return out.unionByName(stay.select("row.*"))
