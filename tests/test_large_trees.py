"""One tree of many nodes: dealt over tasks, in a time that grows with its nodes."""

import time

import pytest
from pyspark.sql import functions as F

from bindery.operators import chapters, toc

N = 100_000


@pytest.fixture
def tree(spark):
    """A root, a hundred parts and what is below them in turn; the last node alone has a reference."""
    place = F.when(F.col("id") == 0, F.array().cast("array<long>")).when(F.col("id") <= 100, F.array(F.col("id") - 1)).otherwise(F.array(F.col("id") % 100, F.col("id")))
    return spark.range(N).select(F.lit(0).alias("book_id"), F.lit(0).alias("root_ord"), place.alias("path"), F.when(F.col("id") == N - 1, "last").alias("href"))


def _largest_task(spark, df):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_reference(spark, tree):
    began = time.time()
    out = chapters.with_first_reference(tree)
    assert {tuple(r.path) for r in out.filter("target = 'last'").collect()} == {(), (99,), (99, N - 1)}
    assert time.time() - began < 90  # pairs of nodes would be 5e9
    assert _largest_task(spark, out) < N * 0.7


def test_retained(spark, tree):
    out = toc.retained(tree, (F.size("path") != 1) | (F.element_at("path", -1) != 7))
    assert out.count() == tree.filter("size(path) = 0 or path[0] <> 7").count()
    assert _largest_task(spark, out) < N * 0.7


def test_cleaned(spark, tree):
    nodes = tree.withColumn("href", F.when(F.col("path") == F.array(F.lit(7).cast("long")), "gone").when(F.size("path") == 2, "here"))
    out = toc.cleaned(nodes, spark.createDataFrame([(0, "here", "raw")], "book_id int, href string, href_raw string"))
    assert out.count() == tree.filter("size(path) = 0 or path[0] <> 7").count()
    assert _largest_task(spark, out) < N * 0.7


def test_sizes(spark, tree):
    out = toc.sizes(tree)
    below = dict(tree.filter("size(path) = 2").groupBy(F.col("path")[0]).count().collect())
    assert {(tuple(r.path), r.total_len, r.max_depth) for r in out.filter("total_len > 0").collect()} == {((), N - 1, 2)} | {((k,), n, 1) for k, n in below.items()}
    assert out.count() == N and _largest_task(spark, out) < N * 0.7
