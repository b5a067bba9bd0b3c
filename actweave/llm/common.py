"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actweave.operators.graph import discarded as discard
from actweave.operators.graph import shared_dir, spread
from actweave.operators.graph import written as materialize

__all__ = ["discard", "materialize", "shared_dir", "spread"]
T = TypeVar("T")
#: A batch of texts is worked on in slices of about this many characters, which bounds a worker's memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in HOT of all rows is looked up in a broadcast table: there are fewer than HOT such keys.
HOT = 10_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` with the columns of `facts`, which has one row for each non-null `key` and in `count` how many of `rows` have it, `total` in all.

    Rows of the keys that hold more than one in HOT of all go by a broadcast of those fewer than HOT keys, the rest by a shuffle, so no
    task has to take a key that holds much of the table. `facts` must be cheap to read twice (a written table).
    """
    names = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(count) * HOT > total).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    few = marked.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *names).join(facts, key)
    return few.unionByName(rest)


def give_back() -> None:
    """Returns the memory that a worker has free to the system, where the C library can; else it would keep the most it ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker remembers from one task to the next: one thing, that of the operator it runs.
_REMEMBERED: dict = {}


def remembered(key: str, make: Callable[[], T]) -> T:
    """What `make` gave for this key last time; whatever another key had is forgotten and given back, so that a worker's memory doesn't add up over operators."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        give_back()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def remainder(doc_id: str, modulus: int):
    """crc32(doc_id as text) mod `modulus`: which fold a row belongs to."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, list]]:
    """(keys, texts) in slices of at most `chars` characters or one document; a null text stays None."""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key))
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64)))
        at, n = 0, len(column)
        while at < n:
            base = sizes[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(sizes, base + chars, side="right")))
            yield keys.slice(at, to - at), column.slice(at, to - at).to_pylist()
            give_back()
            at = to


def bounded_ids(labels: DataFrame, label: str, bound: int, seed: int = 7) -> DataFrame:
    """(doc_id, label) of at most `bound` rows of each label value, all where there are no more: the lowest by a hash of the id.

    Only rows below a hash that the label's count gives are ranked: six deviations more than `bound` are expected there, so fewer come with a chance of
    about one in a thousand million, and no task ranks all rows of a label.
    """
    counts = labels.groupBy(label).agg(F.count("*").alias("_n"))
    rows = labels.select("doc_id", label, F.xxhash64("doc_id", F.lit(seed)).alias("_h")).join(F.broadcast(counts), label)
    low = (F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_n") <= bound + 6 * bound**0.5 + 30
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "doc_id"))
    return rows.filter(low).withColumn("_r", rank).filter(F.col("_r") <= bound).select("doc_id", label)


#: Groups that a sample's rows are dealt into before they are ranked together.
SHARES = 32
#: So many rows of a label at most are brought to the driver, whatever their texts.
FIT_ROWS = 4_000


def fitted_rows(docs: DataFrame, ids: DataFrame, label: str, chars: int, on: tuple[str, ...] = ("doc_id",), rows: int = FIT_ROWS) -> list:
    """Brings a bounded sample to the driver: whole rows of `docs` that `ids` (see bounded_ids) names, by a hash, until those of a label have `chars` characters.

    At most `rows` of a label; rows that repeat id and text count once; a text of more than `chars` characters is left out, none is cut.
    """
    keys = [c for c in on if c != "doc_id"]
    named = docs.select("doc_id", *keys, "text").join(F.broadcast(ids), list(on)).select("doc_id", "text", label)
    pick = materialize(named.filter(F.coalesce(F.length("text"), F.lit(0)) <= chars).distinct())
    order = (F.xxhash64("doc_id", F.lit(7)), "doc_id", "text")
    group = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(SHARES))
    some = pick.withColumn("_r", F.row_number().over(Window.partitionBy(label, group).orderBy(*order))).filter(F.col("_r") <= rows)
    own = Window.partitionBy(label).orderBy(*order)
    before = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("_r", F.row_number().over(own)).withColumn("_n", F.coalesce(before, F.lit(0))).filter((F.col("_r") <= rows) & (F.col("_n") < chars))
    found = sorted(some.select("doc_id", "text", label).collect(), key=lambda r: (r["doc_id"], r["text"] or "", str(r[label])))
    discard(pick)
    return found


#: Up to so many ids (8 bytes each) are broadcast to filter a table; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not among `ids`(doc_id, no nulls); rows with a null id stay. `ids` must be a written table."""
    small = ids.select(F.col("doc_id").alias("_gone")).distinct()
    if small.count() <= BROADCAST_IDS:
        small = F.broadcast(small)
    return docs.join(small, docs["doc_id"] == small["_gone"], "left_anti")
