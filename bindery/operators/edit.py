"""Edits as transformations of a book's tables, with their cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import href
from . import manifest, names, toc
from .common import Levels

BOOK = "book_id"


def renamed(df: DataFrame, renames: DataFrame, column: str, keys: tuple[str, ...] = (BOOK,)) -> DataFrame:
    """``column`` after renames (keys, old, new)."""
    r = renames.select(*keys, F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(r, [*keys, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def set_ids(items: DataFrame, spine: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ids of items; fallbacks, overlays and idrefs follow."""
    for column in ("id", "fallback", "media_overlay"):
        items = renamed(items, renames, column)
    return items, renamed(spine, renames, "idref")


def try_set_ids(items: DataFrame, spine: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``set_ids``, but a new id that another item has, or that two renames want, is no rename: the third table has each rename with
    its error ``duplicate_item_id`` or null."""
    taken = items.select(BOOK, F.col("id").alias("new"), F.col("id").alias("_owner"))
    wanted = renames.groupBy(BOOK, "new").agg(F.count("*").alias("_n"))
    judged = renames.join(taken, [BOOK, "new"], "left").join(wanted, [BOOK, "new"])
    judged = judged.withColumn("error", F.when((F.col("_owner") != F.col("old")) | (F.col("_n") > 1), "duplicate_item_id")).select(BOOK, "old", "new", "error")
    return *set_ids(items, spine, judged.filter("error is null")), judged


def detached(entries: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Copies of entries without their book and place; items with their content, if ``resources`` are given."""
    out = entries
    if resources is not None:
        out = entries.withColumn("path", href.decode(F.col("href"))).join(resources.select(BOOK, "path", "content"), [BOOK, "path"], "left").drop("path")
    return out.drop(BOOK, "ord", "node_id", "parent_node_id", "natural_order", "root_ord")


def bytes_copied(items: DataFrame, resources: DataFrame) -> DataFrame:
    """Bytes of each book's items, as a copy of them writes."""
    read = items.select(BOOK, href.decode(F.col("href")).alias("path")).distinct().join(resources.select(BOOK, "path", F.octet_length("content").alias("_n")), [BOOK, "path"])
    return read.groupBy(BOOK).agg(F.sum("_n").cast("long").alias("bytes"))


def set_hrefs(items: DataFrame, nodes: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New hrefs of items, whose raw form is then unknown; navigation follows and keeps its ? and # part."""
    r = renames.select(BOOK, F.col("old").alias("href"), F.col("new").alias("_new"))
    moved = items.join(r, [BOOK, "href"], "left").withColumn("href_raw", F.when(F.col("_new").isNull(), F.col("href_raw"))).withColumn("href", F.coalesce("_new", "href")).drop("_new")
    n = renames.select(BOOK, F.col("old").alias("_path"), F.col("new").alias("_new"))
    path = href.path(F.col("href"))
    tail = F.substr(F.col("href"), F.char_length(path) + 1)
    follow = nodes.withColumn("_path", path).join(n, [BOOK, "_path"], "left").withColumn("href", F.when(F.col("_new").isNotNull(), F.concat("_new", tail)).otherwise(F.col("href"))).drop("_path", "_new")
    return moved, follow


def cleaned(items: DataFrame, spine: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without references to items that are not there."""
    kept = spine.join(items.select(BOOK, F.col("id").alias("idref")).distinct(), [BOOK, "idref"], "left_semi")
    return manifest.dangling_cleared(items), kept, toc.cleaned(nodes, items)


def removed_subtrees(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries without those of the given ids (book_id, id) and without all that refines them, at any depth."""
    levels = Levels(entries)
    gone = levels.save(entries.join(ids.select(BOOK, "id").distinct(), [BOOK, "id"], "left_semi").select(BOOK, "node_id").distinct())
    fresh = gone
    while not fresh.isEmpty():
        below = entries.join(fresh.withColumnRenamed("node_id", "parent_node_id"), [BOOK, "parent_node_id"], "left_semi").select(BOOK, "node_id").distinct()
        fresh = levels.save(below.join(levels.all(gone), [BOOK, "node_id"], "left_anti"))
    return entries.join(levels.all(gone), [BOOK, "node_id"], "left_anti")


def unique_ids(wanted: DataFrame, taken: DataFrame, keys: tuple[str, ...] = (BOOK,)) -> DataFrame:
    """wanted (book_id, ord, id): ids that neither ``taken`` nor an earlier wanted id has, by -1, -2 and so on."""
    out = names.unique(wanted.select(*keys, "ord", F.col("id").alias("name")), taken.select(*keys, F.col("id").alias("name")), keys)
    return out.select(*keys, "ord", F.col("name").alias("id"), F.col("new_name").alias("new_id"))


def unique_hrefs(wanted: DataFrame, taken: DataFrame, keys: tuple[str, ...] = (BOOK,)) -> DataFrame:
    """wanted (book_id, ord, href): hrefs that neither ``taken`` nor an earlier wanted href has, by numbers before the ending."""
    out = names.unique(wanted.select(*keys, "ord", F.col("href").alias("name")), taken.select(*keys, F.col("href").alias("name")), keys, names.HREFS)
    return out.select(*keys, "ord", F.col("name").alias("href"), F.col("new_name").alias("new_href"))
