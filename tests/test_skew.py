"""Joins with few keys: rows must not be dealt by them."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from axisloom.llm.simhash import edited_fingerprints, near_counts
from axisloom.sources.tables import label_dictionary, with_class, with_colours, with_names


@pytest.fixture
def no_small_tables(spark):
    """A session in which no table is small enough for the planner to send it to the tasks by itself, as large inputs are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_not_dealt_by_label(no_small_tables):
    spark = no_small_tables
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 < 8, "N").when(F.col("id") % 10 == 8, "A").alias("flag"))
    classed = with_class(rows, "flag", label_dictionary(rows, "flag"))
    named = with_names(classed.drop("flag"), "cls", label_dictionary(rows, "flag"))
    coloured = with_colours(named, spark.createDataFrame([("N", "blue")], "name string, value string"))
    plan = coloured._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = {r["cls"]: (r["name"], r["colour"], r["n"]) for r in coloured.groupBy("cls", "name", "colour").agg(F.count("*").alias("n")).collect()}
    assert got == {1: ("N", "blue", 800), 0: ("A", "red", 100), -1: ("Unknown (-1)", "red", 100)}


def test_near_search_is_not_collected(spark):
    """The asked side, repeated for every table, stays off the driver; the size before that looks small enough."""
    prints = spark.range(3000).select(F.col("id").alias("doc_id"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32).alias("fingerprint"))
    near = near_counts(prints, F.col("doc_id") % 50 == 0, blocks=14)
    assert near.filter("n_near = 1").count() == 60
    assert near.collect() and "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()


def test_rows_that_do_not_ask_are_dealt(no_small_tables):
    spark = no_small_tables
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
        shares = edited_fingerprints(docs).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in shares) == 400 and max(r["count"] for r in shares) < 200


@pytest.fixture(scope="module")
def repeated_lines(spark, tmp_path_factory):
    """Line items ten times over, 60,000 rows in one file."""
    d = tmp_path_factory.mktemp("lines")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.crossJoin(spark.range(10)).drop("id").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def most_read(spark, run) -> int:
    """The most shuffle records that one task of the jobs of run() reads."""
    sc = spark.sparkContext
    sc.setJobGroup("most_read", "")
    before = set(sc.statusTracker().getJobIdsForGroup("most_read"))
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = set(sc.statusTracker().getJobIdsForGroup("most_read")) - before
    store, tasks = sc._jsc.sc().statusStore(), []
    for stage in {k for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds}:
        found = store.taskList(stage, 0, 10_000)
        tasks += [found.apply(i) for i in range(found.size())]
    return max(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks)


@pytest.mark.parametrize("name", ["class_statistics", "metric_auc", "metric_bp", "metric_coverage_p70", "metric_f1", "metric_jsd", "metric_purity_weighted", "metric_silhouette", "metric_silhouette_all", "metric_totals", "rank_pairs", "sparse_projection"])
def test_a_task_reads_counts(no_small_tables, repeated_lines, name):
    """Partial counts of classes or cells, not the table's rows."""
    spark = no_small_tables
    assert 0 < most_read(spark, lambda: queries()[name](spark, repeated_lines).collect()) < 6000
