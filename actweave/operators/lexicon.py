"""A stored full-text index: postings by term, built once, merged by document, and read only where a question's terms lie.

Postings carry their document's length, so a search reads nothing of the texts. They are partitioned by a hash of the term and sorted by it: the folders of a question's
terms are pruned when planning, row groups by their least and greatest term. Terms of many documents lie in several files of their folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actweave.operators import graph, ranking

# The light stemming of Italian (accents and endings of words of six letters on), articles that elide, and words that carry nothing.
ACCENTS, PLAIN = "àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu"
ENDING, LEAST_LETTERS = "(?:[ih]e|[hi]i|ia|io|[aeio])$", 6
ELIDED = ("c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d")
EMPTY = (
    "a", "ad", "ai", "agli", "al", "alla", "alle", "allo", "anche", "che", "chi", "ci", "come", "con", "da", "dai", "dagli", "dal", "dalla", "dalle", "dallo", "dei", "degli", "del", "della", "delle", "dello", "di", "e", "ed", "è",
    "gli", "ha", "hanno", "i", "il", "in", "la", "le", "li", "lo", "ma", "nei", "negli", "nel", "nella", "nelle", "nello", "non", "o", "per", "più", "quale", "se", "si", "sono", "su", "sui", "sugli", "sul", "sulla", "sulle", "sullo", "tra", "una", "uno",
)

BUCKETS, SPLITS = 64, 4
#: Postings that a task sorts at once, more or less.
POSTINGS = 500_000
#: Questions of up to so many different terms name them in the scan's filters; more are joined.
NAMED_TERMS = 2_000


def stem(term: Column) -> Column:
    """A term without accents and the ending that number and gender change, if it is long enough."""
    return F.when(F.length(term) < LEAST_LETTERS, term).otherwise(F.regexp_replace(F.translate(term, ACCENTS, PLAIN), ENDING, ""))


def analysed(text: Column) -> Column:
    """The stems of a text's terms in their order, without empty words and elided articles."""
    return F.transform(F.filter(ranking.terms(text), lambda t: ~t.isin(*ELIDED, *EMPTY)), stem)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term, tf) of docs by their analysed terms; a document without any has none."""
    return ranking.counted(graph.spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", analysed(F.col("text")).alias("_terms")), "key")


def _about(docs: DataFrame, text: str) -> int:
    """How many postings texts have at most, more or less: words have some six letters and a space."""
    return (docs.agg(F.sum(F.length(text))).first()[0] or 0) // 7


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class Lexicon:
    """An index in a folder: `postings` (bucket, term, key, tf, dl), `terms` (bucket, term, df) and `totals` (n, average, buckets, kind: the keys' type)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.n, self.average, self.buckets, kind = spark.read.parquet(f"{path}/totals").select("n", "average", "buckets", "kind").first()
        self.postings = spark.read.schema(f"key {kind}, dl int, term string, tf long, bucket int").parquet(f"{path}/postings")
        self.terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")

    @classmethod
    def _written(cls, spark: SparkSession, rows: DataFrame, path: str, buckets: int, about: int) -> Lexicon:
        """Writes rows(key, dl, term, tf), of which there are `about` so many: a bucket has as many files as keep POSTINGS rows in each."""
        splits = max(SPLITS, -(-about // (buckets * POSTINGS)))
        dealt = rows.withColumn("bucket", _bucket(buckets)).repartition(buckets * splits, "bucket", F.pmod(F.xxhash64("key"), F.lit(splits)))
        dealt.sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
        kind = rows.schema["key"].dataType.simpleString()
        own = spark.read.schema(f"key {kind}, dl int, term string, tf long, bucket int").parquet(f"{path}/postings")
        own.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        lengths = own.groupBy("key").agg(F.first("dl").alias("dl"))
        lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("average")).withColumns({"buckets": F.lit(buckets), "kind": F.lit(kind)}).coalesce(1).write.parquet(f"{path}/totals")
        return cls(spark, path)

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Lexicon:
        """Builds the index of docs(key, text) in a folder that is not there yet; keys are unique."""
        return cls._written(docs.sparkSession, postings(docs, key, text), path, buckets, _about(docs, text))

    def updated(self, path: str, changed: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Lexicon:
        """The index with changed(key, text) in place of what it had of them and without gone(key), in a new folder; texts that stay are not read."""
        drop = changed.select(F.col(key).alias("key"))
        if gone is not None:
            drop = drop.unionByName(gone.select(F.col(key).alias("key")))
        stay = self.postings.join(drop.distinct(), "key", "left_anti").select("key", "dl", "term", "tf")
        return self._written(changed.sparkSession, stay.unionByName(postings(changed, key, text)), path, self.buckets, self.postings.count() + _about(changed, text))

    def search(self, queries: DataFrame, query_id: str, k: int, key: str = "doc_id", allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score, rank): the k best documents by BM25 for each query(query_id, text), of those in allowed(key) if given.

        How rare a term is, is counted over the whole index, whatever is allowed.
        """
        asked = queries.select(query_id, F.explode(F.array_distinct(analysed(F.col("text")))).alias("term")).withColumn("bucket", _bucket(self.buckets))
        few = asked.select("bucket", "term").distinct().limit(NAMED_TERMS + 1).collect()
        rows, terms = self.postings, self.terms
        if len(few) <= NAMED_TERMS:
            here = F.col("bucket").isin(*{r["bucket"] for r in few} or {-1}) & F.col("term").isin(*{r["term"] for r in few} or {""})
            rows, terms = rows.filter(here), terms.filter(here)
        if allowed is not None:
            rows = rows.join(allowed.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(terms, ["bucket", "term"]).select(query_id, "bucket", "term", idf.alias("idf"))
        part = F.col("tf") / (F.col("tf") + ranking.K1 * (1 - ranking.B + ranking.B * F.col("dl") / F.lit(self.average)))
        rows = rows.select("bucket", "term", F.col("key").alias(key), "dl", part.alias("p")).join(ranking._small(weighted.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
        score = ranking.summed(rows, weighted, query_id, key, ["bucket", "term"], self.n).drop("dl")
        return ranking.top(score, k, [query_id], [F.desc("score"), F.asc(key)])
