"""Steps over rows in order, and small relational rules that go with them. All are Column expressions and windows over a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeats_marked(rows: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """`rows` with `mark`: the number, and `.rip<n>` behind it from its second occurrence under the keys on."""
    n = F.row_number().over(Window.partitionBy(*keys, number).orderBy(*order))
    return rows.withColumn("mark", F.concat(F.col(number).cast("string"), F.when(n > 1, F.concat(F.lit(".rip"), n)).otherwise(F.lit(""))))


def sections(rows: DataFrame, keys: list[str], number: str, order: list[str], past_nulls: bool = True) -> DataFrame:
    """`rows` with `section`, from 1: a new one begins where the number does not rise. Nulls are last in order and begin no section; a number behind one is held against the last number before it or, without `past_nulls`, against nothing."""
    turn = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    last = F.last(number, ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1)) if past_nulls else F.lag(number).over(turn)
    return rows.withColumn("_new", (F.col(number) <= last).cast("int")).withColumn("section", F.coalesce(F.sum("_new").over(turn.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + 1).drop("_new")


def gathered_turns(turns: DataFrame, closes: Column, source: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, turn_group, sources): the distinct sources of the turns since the last one that `closes` a group, for each closed group.

    Turns behind the last closing one are in no group yet and give no row.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("turn_group", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)))
    found = rows.groupBy(*keys, "turn_group").agg(F.array_sort(F.collect_set(F.when(~closes, source))).alias("sources"), F.bool_or(closes).alias("_closed"))
    return found.filter("_closed").drop("_closed")


def carried(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`rows` with the last value that was not null, the row's own included."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def common(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, common): how many values the two tables share under each key."""
    both = a.select(*keys, value).distinct().join(b.select(*keys, value).distinct(), [*keys, value])
    return both.groupBy(*keys).agg(F.count("*").alias("common"))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same ones at every run with the same seed: those whose keys hash lowest."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def compacted(columns: dict[str, Column]) -> Column:
    """A JSON record of the fields that are neither null nor empty strings."""
    return F.to_json(F.struct(*[F.when(c.cast("string") != "", c).alias(k) for k, c in columns.items()]))


def embedding_text(*parts: Column) -> Column:
    """What is embedded for a text: its headings and itself, a line each, without those that are missing or blank."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def novel_attached(rows: DataFrame, names: Column, keys: list[str]) -> DataFrame:
    """Of the rows under a key those that name the target; all of them where none does."""
    hit = F.coalesce(names, F.lit(False)).cast("int")
    return rows.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy(*keys))).filter("_hit = 1 OR _any = 0").drop("_hit", "_any")


def doubles(rows: DataFrame, others: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(id, double, has_edges): rows of `others` that stand for the same thing as one of `rows`(id, key); a double with edges(node) must not simply be removed."""
    pairs = rows.select("id", key).join(others.select(F.col("id").alias("double"), key), key).select("id", "double")
    linked = edges.select(F.col("node").alias("double")).distinct().withColumn("has_edges", F.lit(True))
    return pairs.join(linked, "double", "left").select("id", "double", F.coalesce("has_edges", F.lit(False)).alias("has_edges"))


def golden(found: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, expected, counted, ok): the first numbers of pairs of one-row tables held against each other."""
    out = None
    for name, expected, counted in found:
        row = expected.select(F.lit(name).alias("name"), F.col(expected.columns[0]).cast("long").alias("expected")).join(counted.select(F.lit(name).alias("name"), F.col(counted.columns[0]).cast("long").alias("counted")), "name")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("expected").eqNullSafe(F.col("counted")))
