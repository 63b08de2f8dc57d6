"""What reports do once for all rows, and what only for those that need it."""

import pytest
from pyspark.sql import functions as F

from bindery.operators import common, constraints, metadata
from bindery.plans import validated
from bindery.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["epub_validate", "epub_validate_first"])
def test_lines_are_sorted_once(spark, name):
    """Items, itemrefs and entries are read from lines that were numbered before; what has to be there is one join, not on distinct triples."""
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "lineitem.parquet" not in plan and plan.count("LeftAnti") == 1


def test_only_books_that_can_have_cycles_are_walked(spark, monkeypatch):
    """Of a thousand books with a chain of five, one has a ring of three with two entries below it."""
    walked, tree = [], constraints.tree
    monkeypatch.setattr(constraints, "tree", lambda links, *rest: walked.append(links.count()) or tree(links, *rest))
    chains = spark.range(5000).select(F.floor(F.col("id") / 5).alias("book_id"), (F.col("id") % 5).alias("node_id"))
    ring = F.col("book_id") == 7
    parent = F.when(ring & (F.col("node_id") == 0), 2).when(F.col("node_id") > 0, F.col("node_id") - 1)
    meta = chains.select("book_id", "node_id", parent.cast("long").alias("parent_node_id"), F.col("node_id").alias("natural_order"), F.concat(F.lit("n"), "node_id").alias("id"), F.lit(None).cast("string").alias("refines"))
    found = constraints._cycles(meta).collect()
    assert {(r.book_id, r.ord, r.code, r.detail) for r in found} == {(7, k, "cyclic_meta", f"n{k}") for k in range(5)}
    assert walked == [5]


def test_claims_read_numbered_lines(spark):
    plan = _plan(QUERIES["meta_claims"](spark, SMALL))
    assert "lineitem.parquet" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("depth, tables", [(1, 1), (2, 2), (4, 3), (9, 5)])
def test_walks_begin_below_roots(spark, monkeypatch, depth, tables):
    """A table for the start, in which children of roots are done, and one for each doubling; what is done is not written again."""
    written, save = [], common.Levels.save
    monkeypatch.setattr(common.Levels, "save", lambda self, df: written.append(0) or save(self, df))
    links = spark.range(20 * (depth + 1)).select(F.floor(F.col("id") / (depth + 1)).alias("book_id"), (F.col("id") % (depth + 1)).alias("k"))
    out = metadata.tree(links.withColumn("p", F.when(F.col("k") > 0, F.col("k") - 1)), "k", "p")
    assert {tuple(r) for r in out.collect()} == {(b, k, k, 0) for b in range(20) for k in range(depth + 1)}
    assert len(written) == tables


def test_keys_are_summed_where_books_are(spark):
    """Uses and definitions of names meet in sums of numbers where each book was dealt out, not in joins of strings."""
    plan = _plan(validated.epub_validate_first(spark, SMALL))
    assert "_key" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "SortMergeJoin" in line)


@pytest.mark.parametrize("start, joined", [(0, False), (60, True), (10**12, True)])
def test_places_beyond_the_bits(spark, start, joined):
    """A book with items, itemrefs and refinements around the last place that has a bit: each fault is told at its place, copies of a row as often as they are there."""
    n = 8
    rows = spark.range(start, start + n).select(F.lit(1).alias("book_id"), F.col("id").alias("ord"))
    package = spark.createDataFrame([(1, "3.0", "epub3", "u", None, [])], "book_id int, version_raw string, family string, unique_identifier string, ncx_id string, prefixes array<struct<name: string, uri: string>>")
    entry = ["cast(null as long) AS parent_node_id", "'meta3' AS kind", "'p' AS property", "'v' AS value"]
    meta = rows.selectExpr("book_id", "ord AS node_id", "ord AS natural_order", "concat('m', ord) AS id", "'gone' AS refines", *entry)
    items = rows.selectExpr("book_id", "ord", f"IF(ord < {start + 5}, 'i', concat('i', ord)) AS id", "'a' AS href_raw", "'b/c' AS media_type", "'nav' AS properties")
    refs = rows.selectExpr("book_id", "ord", "cast(null as string) AS id", f"IF(ord % 2 = 0, concat('i', ord), 'lost') AS idref")
    refs = refs.unionAll(refs.filter(f"ord = {start + 1}")) if joined else refs
    toc = spark.createDataFrame([], "book_id int, root_kind string, root_ord int, path array<int>, href string, label string")
    report = constraints.violations(package, meta, items, refs, toc)
    told = [(r.code, r.ord, r.detail) for r in report.filter("stage in (1, 2, 3)").collect()]
    key = lambda k: f"i{k}" if k >= start + 5 else "i"
    ids = {key(k) for k in range(start, start + n)}
    idrefs = [(k, f"i{k}" if k % 2 == 0 else "lost") for k in [*range(start, start + n), *([start + 1] if joined else [])]]
    want = [("invalid_refines", k, "gone") for k in range(start, start + n)] + [("duplicate_item_id", k, "i") for k in range(start + 1, start + 5)] + [("invalid_idref", k, x) for k, x in idrefs if x not in ids]
    assert sorted(told) == sorted(want)
    first = constraints.first(report).collect()
    assert [tuple(r)[1:3] for r in first] == [(1, start)]


def test_allowed_characters_are_looked_up_at_once(spark):
    """No ranges, and the same characters as before, all others of the first 65,535 included."""
    assert not any(x in constraints.UNENCODED for x in ("a-z", "A-Z", "0-9"))
    c = spark.range(1, 65536).filter("id not between 55296 and 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8").alias("c"))
    assert c.filter(F.col("c").rlike(constraints.UNENCODED) != F.col("c").rlike(r"[^A-Za-z0-9_.~%/:#?=&-]")).isEmpty()
