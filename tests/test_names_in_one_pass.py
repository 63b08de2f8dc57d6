from pyspark.sql import functions as F

from bindery.operators import edit


def test_names_of_many_books_are_one_pass(spark):
    """Not a Python call for each root: books of 'a' and 'a-1' in turn."""
    rows = spark.range(20_000).select((F.col("id") / 4).cast("long").alias("book_id"), (F.col("id") % 4).alias("ord"), F.when(F.col("id") % 2 == 0, "a").otherwise("a-1").alias("id"))
    out = edit.unique_ids(rows, rows.limit(0).select("book_id", "id"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert {(r.ord, r.new_id, r["count"]) for r in out.groupBy("ord", "new_id").count().collect()} == {(0, "a", 5000), (1, "a-1", 5000), (2, "a-2", 5000), (3, "a-1-1", 5000)}
