"""Chapters of many books at once, expanded to manifest, spine, navigation and landmarks.

A chapter is a row: book_id, path (places from 0 among siblings, the children of a chapter below it), title, href, kind, has_content, linear.
Depth first, a chapter with content is a resource and an entry of the reading order, one with a title an entry of the navigation, one
with a title and a kind also one of the landmarks. What stands below a chapter without a title is in no navigation, but its resources,
reading order and landmarks are. Ids and hrefs that are not given are made unique for all books in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import href, mime, text
from . import names, toc
from .common import Levels

BOOK = "book_id"


@dataclass(frozen=True)
class Expanded:
    manifest: DataFrame
    spine: DataFrame
    toc: DataFrame
    landmarks: DataFrame


def _folder(directory: str) -> str:
    """What hrefs.resolve puts before a name in the directory."""
    kept: list[str] = []
    for part in directory.split("/"):
        kept = kept[:-1] if part == ".." else kept if part in ("", ".") else [*kept, part]
    return ("/" if f"{directory}/".startswith("/") else "") + "".join(f"{part}/" for part in kept)


def expanded(chapters: DataFrame, taken: DataFrame | None = None, directory: str = "/OEBPS") -> Expanded:
    """Tables of the chapters of all books. ``taken`` (book_id, id, href): items that the books have already; ids and hrefs that are made
    differ from theirs, and a book's new items and entries stand after those (``ord`` counts the new ones from 0).

    A chapter's id comes from its title, else from the name of its href, as text.entry_id says; of equal ones the later get numbers. Without
    an href it is the id with .xhtml, with a number before the ending if an item before it, or one the book had, is there. A given
    href is taken as it is. Null paths are errors of the caller; empty tables give empty tables."""
    levels = Levels(chapters)
    folder = _folder(directory)
    place = lambda raw: href.resolve(F.lit(directory), raw)
    said, raw, given = F.col("_said"), F.col("_raw"), F.col("has_content") & F.col("_raw").isNotNull()
    # of hrefs that are taken only those count that an id may make; no other is met
    meets = lambda full: F.when(F.startswith(full, F.lit(folder)) & F.substr(full, F.lit(len(folder) + 1)).rlike(r"^[a-z0-9_-]+\.xhtml$"), full)
    rows = chapters.select(BOOK, "path", "title", F.col("href").alias("_said"), "kind", F.coalesce("has_content", F.lit(False)).alias("has_content"), "linear", F.lit(False).alias("_claim"))
    # one after the other, so that each is computed once
    rows = rows.withColumn("_path", href.path(said)).withColumn("_raw", href.encode(F.col("_path"))).withColumn("_full", place(raw))
    rows = rows.withColumns({"name": F.when(F.col("has_content"), text.entry_id(F.coalesce("title", href.name(F.col("_path")), F.lit("")))), "_meets": F.when(given, meets(F.col("_full"))), "_said": F.when(said != F.col("_path"), said)}).drop("_path")
    if taken is not None:
        of = F.col(BOOK).cast(dict(chapters.dtypes)[BOOK]).alias(BOOK)
        rows = rows.unionByName(taken.select(of, F.col("id").alias("name"), meets(F.col("href")).alias("_meets"), F.lit(True).alias("_claim")), allowMissingColumns=True)

    # books are dealt out once: one window has all numbers of a book's tables, what a book had comes first there, as it has no path; the windows
    # of the ids stand on the same rows, which carry all that the tables need
    book = Window.partitionBy(BOOK)
    so_far = book.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda which: F.count_if(which).over(so_far) - 1
    hides = F.when(F.col("title").isNull() & (F.size("path") > 0), toc.end(chapters))
    rows = rows.withColumns({
        "ord": F.when(~F.col("_claim"), count(~F.col("_claim"))), "_item": count(F.col("has_content")), "_place": count(F.col("title").isNotNull() & F.col("kind").isNotNull()),
        "_listed": F.coalesce(F.max(hides).over(so_far) <= F.col("path"), F.lit(True)), "_nth": F.count("_meets").over(so_far),
    })
    met = F.when(F.col("_nth") <= names.FEW, names.HREFS.root(F.col("_meets")))
    rows = rows.withColumns({"_met": F.collect_set(met).over(book), "_many": F.max("_nth").over(book) > names.FEW}).drop("_nth")

    # hrefs that ids make differ as the ids do; those of which one may be taken, or that hang on such a one, are told apart
    own = F.concat(F.lit(folder), "id", F.lit(".xhtml"))
    open_ = F.col("has_content") & raw.isNull()
    held = F.col("_many") | ((F.size("_met") > 0) & F.array_contains("_met", names.HREFS.root(own)))
    placed = lambda rows: rows.withColumn("id", F.col("new_name")).withColumn("_held", F.coalesce(open_ & held, F.lit(False))).drop("new_name")
    linked = lambda rows: rows.withColumns({"href": F.when(given, F.col("_full")).when(open_, own), "href_raw": F.when(given, raw).when(open_, F.concat("id", F.lit(".xhtml")))})

    # what is told of each row by others is written only where the id is not settled
    rows = placed(names.told(rows, [BOOK]))
    rows = levels.save(rows.withColumns({c: F.when(F.col("_way").isNotNull(), F.col(c)) for c in ("name", "_root", "_base", "_met")}))
    columns = [BOOK, "ord", "path", "title", "kind", "linear", "has_content", "id", "_said", "_raw", "_full", "_item", "_place", "_listed", "_held"]
    nodes, more = rows.filter("_way is null").select(*columns), names.rest(rows, [BOOK])
    nodes = linked(nodes.unionByName(levels.save(placed(more).select(*columns))) if more is not None else nodes)
    taken_hrefs = rows.filter("not _claim and _meets is not null").select(BOOK, F.col("_meets").alias("name"), "ord")
    if taken is not None:
        taken_hrefs = taken_hrefs.unionByName(taken.select(of, meets(F.col("href")).alias("name")), allowMissingColumns=True)
    free = names.unique(nodes.filter("_held").withColumnRenamed("href", "name"), taken_hrefs, [BOOK], names.HREFS)
    free = free.withColumns({"href": F.col("new_name"), "href_raw": F.substr("new_name", F.lit(len(folder) + 1))})
    nodes = nodes.filter("not _held").unionByName(levels.save(free.select(*nodes.columns)))
    found = nodes.filter("has_content")

    manifest = found.select(BOOK, F.col("_item").alias("ord"), "id", "href", "href_raw", F.lit(mime.XHTML).alias("media_type"))
    spine = found.select(BOOK, F.col("_item").alias("ord"), F.col("id").alias("idref"), F.coalesce("linear", F.lit(True)).alias("linear"))

    # an entry leads to what its chapter says, else to its content
    link = href.encode(said)
    nodes = nodes.withColumns({"href": F.when(said.isNotNull(), place(link)).when(raw.isNotNull(), F.col("_full")).otherwise(F.col("href")), "href_raw": F.when(said.isNotNull(), link).otherwise(F.coalesce("_raw", "href_raw"))})
    nodes = nodes.select(BOOK, "ord", "path", F.col("title").alias("label"), "kind", "href_raw", "href", "_place", "_listed")
    listed = nodes.filter("_listed").drop("_listed", "_place")
    marks = nodes.filter("label is not null and kind is not null").drop("path", "_listed").withColumnRenamed("_place", "place")
    return Expanded(manifest, spine, listed, marks)


def with_first_reference(nodes: DataFrame, keys: tuple[str, ...] = (BOOK, "root_ord")) -> DataFrame:
    """``target``: a node's own href, else that of the first node below it that has one; null without any."""
    return toc.first_below(nodes, F.col("href"), keys).withColumnRenamed("_first", "target")
