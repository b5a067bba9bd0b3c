"""Relational steps over nodes and edges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="actweave-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes `df` as a table in the shared folder and reads it back, so a lost executor costs only a read.

    `discarded` deletes the table; one that a result still reads when its maker returns goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/actweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _place(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discarded(*tables: DataFrame | None) -> None:
    """Deletes tables of `written`, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            files, p = _place(df.sparkSession, path)
            files.delete(p, True)
            files.cancelDeleteOnExit(p)


#: Tables of more bytes than this for each core stay as they lie: dealing them anew would cost more than an uneven scan.
SPREAD_BYTES = 256_000_000


def spread(rows: DataFrame) -> DataFrame:
    """Deals the rows of a small table over all cores if fewer of its partitions than there are cores hold any.

    A file of one row group is planned as several partitions, of which one has all the rows; so rows are counted, from the footers alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * SPREAD_BYTES or rows.groupBy(F.spark_partition_id()).count().filter("count > 0").count() >= cores:
        return rows
    return rows.repartition(cores)


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, citations): targets of edges(dst) that are no node(id), the most cited first. Counted before the join."""
    cited = edges.filter("dst IS NOT NULL").groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("citations"))
    return cited.join(nodes, cited["target"] == nodes["id"], "left_anti").orderBy(F.desc("citations"), "target")


def unique(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys that exactly one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_matches"), F.first(value).alias(value)).filter("_matches = 1").drop("_matches")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of each pair, in one pass."""
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")


def reached(edges: DataFrame, roots: list[int]) -> DataFrame:
    """(node): all that edges(src, dst) reach from the roots, those included. Each round joins only the nodes that are new."""
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst").filter("dst IS NOT NULL").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    seen = new = written(spark.createDataFrame([(r,) for r in sorted(set(roots))], f"node {kind}"))
    while True:
        found = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").cast(kind).alias("node")).distinct()
        new = written(found.join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = written(seen.unionByName(new))


def same_text(rows: DataFrame) -> DataFrame:
    """(doc_id, first_id, copies) of the rows(doc_id, text) whose text occurs again. Equal texts meet by two hashes, so texts themselves are not shuffled."""
    key = [F.xxhash64("text").alias("h1"), F.md5("text").alias("h2")]
    small = rows.select("doc_id", *key)
    classes = small.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return small.join(classes, ["h1", "h2"]).select("doc_id", "first_id", "copies")


#: Rows of a group that one round decides on.
BLOCK = 32


def represented(rows: DataFrame, keys: list[str], like: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """(doc_id, first_id, ratio): in the order of ids, rows(doc_id, keys, s) join the first representative of their group that is alike, or become one.

    Each round settles the BLOCK first rows of a group that none has taken, by a fold over them alone; the others of the group are held against the
    representatives among these, row by row where they lie. Groups of no more rows are done in one round, and no task holds more of a group than a block.
    """

    def hit(reps: Column, s: Column) -> Column:
        """(id, ratio) of the first representative that is alike; none behind it is looked at."""

        def step(a: Column, r: Column) -> Column:
            ratio = F.transform(F.array(F.round(like(s, r["s"]), 6)), lambda v: F.when(v >= least, F.struct(r["doc_id"].alias("id"), v.alias("ratio"))))
            return F.when(a.isNotNull(), a).otherwise(F.get(ratio, 0))

        return F.aggregate(reps, F.lit(None).cast(f"struct<id:{kind},ratio:double>"), step)

    def settle(a: Column, x: Column) -> Column:
        def one(h: Column) -> Column:
            again = F.exists(a["reps"], lambda r: r["doc_id"] == x["doc_id"])
            took = F.struct(x["doc_id"].alias("doc_id"), h["id"].alias("first_id"), h["ratio"].alias("ratio"))
            return F.struct(F.when(h.isNull() & ~again, F.array_append(a["reps"], x)).otherwise(a["reps"]).alias("reps"), F.when(h.isNotNull() & ~again, F.array_append(a["out"], took)).otherwise(a["out"]).alias("out"))

        return F.get(F.transform(F.array(hit(a["reps"], x["s"])), one), 0)

    rest, found = written(rows.select("doc_id", *keys, "s").dropna(subset=["doc_id", *keys])), None
    kind = rest.schema["doc_id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<doc_id:{kind},s:string>>").alias("reps"), F.array().cast(f"array<struct<doc_id:{kind},first_id:{kind},ratio:double>>").alias("out"))
    while True:
        block = rest.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy("doc_id"))).filter(F.col("_r") <= BLOCK)
        block = block.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("x")).filter(F.size("x") > 1)
        block = written(block.select(*keys, F.size("x").alias("n"), F.element_at("x", -1)["doc_id"].alias("last"), F.aggregate("x", start, settle).alias("f")))
        taken = block.select(F.explode("f.out").alias("o")).select("o.*")
        full = block.filter(F.col("n") >= BLOCK).select(*keys, "last", "f.reps")
        seen = written(rest.join(full, keys).filter("doc_id > last").select("doc_id", *keys, "s", hit(F.col("reps"), F.col("s")).alias("h")))
        taken = taken.unionByName(seen.filter("h IS NOT NULL").select("doc_id", F.col("h.id").alias("first_id"), "h.ratio"))
        found = taken if found is None else found.unionByName(taken)
        rest = seen.filter("h IS NULL").select("doc_id", *keys, "s")
        if rest.isEmpty():
            return found


def reconciled(stores: dict[str, DataFrame]) -> DataFrame:
    """(id, in_<store>...): which stores have each id; every store is a frame of one column id."""
    union = None
    for name, rows in stores.items():
        part = rows.select(F.col("id").cast("long").alias("id"), F.lit(name).alias("store"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("id").agg(*[F.bool_or(F.col("store") == s).alias(f"in_{s}") for s in stores])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: dictionaries with first-wins rules become this."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that are wanted and not there yet, each once."""
    return wanted.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def without_nodes(edges: DataFrame, gone: DataFrame, ends: tuple[str, ...] = ("src_id", "dst_id")) -> DataFrame:
    """Edges none of whose ends is among gone(id): deleting a node deletes its edges."""
    for end in ends:
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def upserted(target: DataFrame, rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`target` with `rows` merged in by key: new values win where they are not null, columns in `keep` only where there was none."""
    t, r = target.alias("t"), rows.alias("r")
    joined = t.join(r, F.col(f"t.{key}") == F.col(f"r.{key}"), "full_outer")
    columns = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        new = F.col(f"r.{c}") if c in rows.columns else F.lit(None)
        columns.append((F.coalesce(old, new) if c in keep or c == key else F.coalesce(new, old)).alias(c))
    return joined.select(*columns)
