from actweave.llm import common, toxicity


def test_fitted_rows_are_whole(spark):
    texts = {k: f"start {k} " + "word " * 10_000 + f"end{k}" for k in range(12)}
    docs = spark.createDataFrame([*texts.items(), (12, None), (13, "")], "doc_id long, text string")
    ids = spark.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, y int")
    rows = common.fitted_rows(docs, ids, "y", 10**9)
    assert [(r.doc_id, r.text, r.y) for r in rows] == [(k, {**texts, 12: None, 13: ""}[k], k % 2) for k in range(14)]
    few = common.fitted_rows(docs, ids, "y", 120_000)  # three long texts of each label
    assert all(r.text == texts[r.doc_id] for r in few if r.text) and [sum(bool(r.text) for r in few if r.y == y) for y in (0, 1)] == [3, 3]
    assert few == common.fitted_rows(docs, ids, "y", 120_000)


def test_what_stands_late_in_a_text_is_learned(spark):
    rows = [(k, ("plain words here " * 1_300) + (f"w{k} zzgrim zzvile x{k}" if k % 2 else f"w{k} fine x{k}"), k % 2) for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(df.select("doc_id", "text"), toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 150


def test_bounded_ids_keep_all_within_the_bound_and_no_more_beyond(spark):
    labels = spark.range(1_400).selectExpr("id AS doc_id", "1 AS y").unionByName(spark.range(5_000, 5_040).selectExpr("id AS doc_id", "0 AS y"))
    count = lambda bound: {r.y: r["count"] for r in common.bounded_ids(labels, "y", bound).groupBy("y").count().collect()}
    assert count(1_500) == {1: 1_400, 0: 40} and count(5) == {1: 5, 0: 5} and count(500) == {1: 500, 0: 40}
    few = {r.doc_id for r in common.bounded_ids(labels, "y", 5).collect()}
    assert few <= {r.doc_id for r in common.bounded_ids(labels, "y", 500).collect()}


def test_fitted_rows_are_bounded_in_number(spark):
    docs = spark.range(30_000).selectExpr("7L AS doc_id", "'' AS text").unionByName(spark.range(3_000).selectExpr("8L AS doc_id", "cast(id AS string) AS text"))
    docs = docs.unionByName(spark.createDataFrame([(9, "x" * 5_000)], "doc_id long, text string"))
    ids = spark.createDataFrame([(7, 0), (8, 1), (9, 1)], "doc_id long, y int")
    rows = common.fitted_rows(docs, ids, "y", 10**6, rows=500)
    assert [r.text for r in rows if r.y == 0] == [""] and sum(r.y for r in rows) == 500
    assert all(len(r.text) < 5_000 for r in common.fitted_rows(docs, ids, "y", 4_999))


def test_spread_counts_rows_not_partitions(spark, tmp_path):
    spark.range(1_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    planned = spark.read.option("maxPartitionBytes", 100).parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert planned.rdd.getNumPartitions() > 1
        sizes = lambda df: [n for n in df.rdd.glom().map(len).collect() if n]
        assert len(sizes(planned)) == 1 and len(sizes(common.spread(planned))) == cores
        even = spark.range(1_000).repartition(2 * cores)
        assert common.spread(even) is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
