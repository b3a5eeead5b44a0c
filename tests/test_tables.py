"""Table maintenance, joins with quirks, streaming."""

import datetime

from pyspark.sql import functions as F

from topicloom.operators import analysis as A
from topicloom.operators import corpus as D
from topicloom.operators import scale as S
from topicloom.runtime import run_path
from topicloom.sources import posts as P
from topicloom.sources import tables as TB
from topicloom.streaming.ingest import ingest


def test_update_column_sets_null_and_last_value_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, None, 1), (2, "x", 1), (2, "w", 2)], "id long, v string, n int")
    got = {r.id: r.v for r in TB.update_column(df, changes, "v", order="n").collect()}
    assert got == {1: None, 2: "w", 3: "c"}


def test_batches_are_dense_and_never_empty(spark):
    rows = TB.batch_numbers(spark.range(100).withColumn("id", F.col("id") * 7), size=50).collect()
    assert sorted({r.batch for r in rows}) == [0, 1]
    assert [r.id for r in sorted(rows, key=lambda r: r.row_no)] == [7 * i for i in range(100)]
    part = TB.batch_numbers(spark.range(100), size=50, offset=10, limit=60).collect()
    assert len(part) == 60 and {r.batch for r in part} == {0, 1}


def test_read_page_orders_and_ignores_case(spark):
    df = spark.createDataFrame([(1, "Token"), (2, "no"), (3, "my TOKEN")], "id long, t string")
    assert [r.id for r in P.read_page(df, ["id"], "t", "%token%", ["id"]).collect()] == [3, 1]
    assert [r.id for r in P.read_page(df, ["id"], order=["id"], descending=False, limit=1, offset=1).collect()] == [2]


def test_in_years_open_sides(spark):
    df = spark.createDataFrame([(1, datetime.date(2011, 5, 1)), (2, datetime.date(2013, 1, 1))], "id long, creation_date date")
    assert P.in_years(df).count() == 2
    assert [r.id for r in P.in_years(df, 2013).collect()] == [2]
    assert P.in_years(df, 2011).count() == 2
    assert [r.id for r in P.in_years(df, 2011, 2011).collect()] == [1]
    assert [r.id for r in P.in_years(df, None, 2012).collect()] == [1]


def test_keywords_are_whole_words(spark):
    df = spark.createDataFrame([(1, "a", "the Key."), (2, "b", "monkey"), (3, "C++ rocks", "")], "id long, title string, body string")
    assert [r.id for r in P.keyword_filter(df, ["key", "C++"]).orderBy("id").collect()] == [1, 3]


def test_stream_reads_each_file_once(spark):
    source, sink, state = (run_path(spark, n) for n in ("drop", "sink", "state"))
    spark.range(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    assert ingest(spark, source, schema, sink, state).count() == 5
    spark.range(5, 12).write.mode("append").parquet(source)
    assert ingest(spark, source, schema, sink, state).count() == 12
    assert ingest(spark, source, schema, sink, state).count() == 12


def test_log_lines(spark):
    path = run_path(spark, "log")
    lines = ["-8.123 per-word bound, 278.9 perplexity estimate", "nothing", "-7.5 per-word bound, 181.0 perplexity"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows = [tuple(r) for r in TB.read_log(spark, path).orderBy("iteration").collect()]
    assert rows == [(0, -8.123, 278.9), (10, -7.5, 181.0)]


def test_runs_get_the_next_free_number(spark):
    path = run_path(spark, "runs")
    assert TB.next_run_number(spark, path) == 1
    TB.write_run(spark.range(2), path, 1)
    TB.write_run(spark.range(3), path, 1)
    assert TB.next_run_number(spark, path) == 2
    assert spark.read.parquet(path).count() == 3
    assert TB.next_run(spark.createDataFrame([], "run int")).head().run == 1


def test_lookup_join_with_a_hot_key(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("w"))
    joined = S.lookup_join(facts, lookup, "k", "w", hot=5)
    assert joined.count() == 3000 and joined.filter("k = 'hot' and w = 1000").count() == 1000


def test_row_numbers_in_any_order(spark):
    df = spark.range(997).select(F.xxhash64("id").alias("x"))
    rows = S.row_numbers(df, [F.col("x").desc()], "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: -r.x)] == list(range(997))


def test_existing_is_by_key_and_relabel_keeps_unknown(spark):
    total = spark.createDataFrame([(5, 2012), (9, 2012), (11, 2013)], "id long, year int")
    assert sorted(r.id for r in D.existing(total, total.filter("id = 9")).collect()) == [5, 11]
    topics = spark.createDataFrame([(1, 0), (2, 5), (3, 8), (4, None)], "id long, topic_id int")
    assert {r.id: r.topic_id for r in A.relabel(topics).collect()} == {1: 2, 2: 4, 3: 8, 4: None}
