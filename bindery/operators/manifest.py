"""Manifest: lookups, media sets, fallback chains and overlays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import href, mime, text
from . import rewrite
from .common import Levels, first_of

BOOK = "book_id"


def by_kind(items: DataFrame, targets: Sequence[str]) -> DataFrame:
    return items.filter(reduce(lambda a, b: a | b, [mime.matches(F.col("media_type"), t) for t in targets], F.lit(False)))


def media_sets(items: DataFrame) -> DataFrame:
    """Adds ``media_set``: images, scripts, styles, fonts, audio, video, readable or other."""
    kind = F.col("media_type")
    any_of = lambda names: reduce(lambda a, b: a | b, [mime.matches(kind, n) for n in names])
    rules = [
        ("images", mime.is_family(kind, "image")),
        ("scripts", any_of(mime.SCRIPTS)),
        ("styles", any_of([mime.CSS])),
        ("fonts", mime.is_font(kind)),
        ("audio", mime.is_family(kind, "audio")),
        ("video", mime.is_family(kind, "video")),
        ("readable", any_of([mime.XHTML, mime.HTML])),
    ]
    chosen = reduce(lambda out, rule: F.when(rule[1], rule[0]).otherwise(out), reversed(rules), F.lit("other"))
    return items.withColumn("media_set", chosen)


def by_property(items: DataFrame, token: str) -> DataFrame:
    return items.filter(text.has_property(F.col("properties"), token))


def by_id(items: DataFrame, ids: DataFrame) -> DataFrame:
    """(book_id, id) requests with their items, nulls where there is none."""
    return ids.select(BOOK, "id").join(items, [BOOK, "id"], "left")


def read(items: DataFrame, resources: DataFrame, prefix: str | None = None, css: str | None = None) -> DataFrame:
    """Items with their bytes and their text, rewritten if asked for; error ``invalid_resource`` where the container has no such file.

    Texts are UTF-8 but for those that begin with the mark of UTF-16."""
    asked = items.withColumn("path", href.decode(href.path(F.col("href"))))
    out = asked.join(resources.select(BOOK, "path", F.col("content").alias("bytes")), [BOOK, "path"], "left")
    mark = F.hex(F.substring("bytes", 1, 2))
    decoded = F.when(mark.isin("FEFF", "FFFE"), F.decode("bytes", "UTF-16")).otherwise(F.regexp_replace(F.decode("bytes", "UTF-8"), "^\\uFEFF", ""))
    is_text = ~(mime.is_family(F.col("media_type"), "image") | mime.is_family(F.col("media_type"), "audio") | mime.is_family(F.col("media_type"), "video") | mime.is_font(F.col("media_type")))
    out = out.withColumn("content", F.when(is_text, decoded)).withColumn("error", F.when(F.col("bytes").isNull(), "invalid_resource"))
    return out if prefix is None and css is None else out.withColumn("content", rewrite.rewritten(F.col("content"), F.col("path"), prefix, css))


def resources_of(entries: DataFrame, items: DataFrame, column: str = "idref") -> DataFrame:
    """Spine entries (by idref) or navigation entries (by href) with the key, path and media type of the resource they stand for."""
    if column == "href":
        met = by_href(items, entries.withColumnsRenamed({c: f"entry_{c}" for c in ("id", "ord") if c in entries.columns}))
        named = items.select(BOOK, "ord", F.col("id"), F.col("href").alias("resource_path"), F.col("media_type").alias("resource_type"))
        return met.join(named.hint("merge"), [BOOK, "ord", "id"], "left").withColumnRenamed("id", "resource_id").drop("ord")
    named = items.select(BOOK, F.col("id").alias(column), F.col("id").alias("resource_id"), F.col("href").alias("resource_path"), F.col("media_type").alias("resource_type"))
    return entries.join(named, [BOOK, column], "left")


def stylesheets(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items that (book_id, href) links name, in the manifest's order."""
    return items.join(links.select(BOOK, href.path(F.col("href")).alias("href")).distinct(), [BOOK, "href"], "left_semi")


def by_href(items: DataFrame, requests: DataFrame, column: str = "href") -> DataFrame:
    """The first item whose href or href_raw is a request's, without its ? and #. Two equi-joins: an OR would be no join on keys.

    Names are dealt out before the first of each is looked for, and nothing is sent to all tasks: a small file can hold many items."""
    asked = requests.withColumn("_path", href.path(F.col(column)))
    names = items.select(BOOK, "ord", "id", F.explode(F.array_distinct(F.array("href", "href_raw"))).alias("_path"))
    names = names.filter("_path is not null").hint("rebalance", BOOK, "_path", "ord")
    return asked.join(first_of(names, [BOOK, "_path"], [F.col("ord")]).hint("merge"), [BOOK, "_path"], "left").drop("_path")


def cover(items: DataFrame, entries: DataFrame) -> DataFrame:
    """The first item with the property cover-image, else the item that the first meta ``cover`` names."""
    tagged = by_property(items, "cover-image").withColumn("_rank", F.lit(0))
    meta = entries.filter((F.col("property") == "cover") & F.col("parent_node_id").isNull())
    named = first_of(meta.select(BOOK, "ord", F.col("value").alias("id")), [BOOK], [F.col("ord")]).select(BOOK, "id")
    rows = tagged.unionByName(items.join(named, [BOOK, "id"], "left_semi").withColumn("_rank", F.lit(1)))
    return first_of(rows, [BOOK], [F.col("_rank"), F.col("ord")]).drop("_rank")


def fallback(items: DataFrame, column: str = "fallback") -> DataFrame:
    """Each item with the item its fallback (or media_overlay) names; one that names itself has none."""
    other = items.select(F.col(BOOK), F.col("id").alias(column), F.col("id").alias(f"{column}_id"))
    return items.join(other, [BOOK, column], "left").withColumn(f"{column}_id", F.when(F.col(f"{column}_id") != F.col("id"), F.col(f"{column}_id")))


def fallback_chain(items: DataFrame) -> DataFrame:
    """book_id, id, step (from 1), fallback_id: the chain from each item, which ends where an item would come again.

    Each round puts the chain of a chain's last item behind it, so that lengths double: as many rounds as the logarithm of the longest chain. What
    comes again is left out; all that follows it has come, too."""
    levels = Levels(items)
    known = items.select(F.col(BOOK), F.col("id").alias("fallback"))
    links = items.select(BOOK, "id", "fallback").join(known, [BOOK, "fallback"]).filter("id <> fallback")
    state = levels.save(links.select(BOOK, "id", F.array("fallback").alias("way"), F.lit(False).alias("done")))
    none = F.array().cast(dict(state.dtypes)["way"])
    while not state.filter("not done").isEmpty():
        ends = state.select(BOOK, F.col("id").alias("_last"), F.col("way").alias("_more"), F.col("done").alias("_done"))
        met = state.filter("not done").withColumn("_last", F.element_at("way", -1)).join(ends, [BOOK, "_last"], "left").withColumn("_more", F.coalesce("_more", none))
        fresh = F.array_except("_more", F.concat(F.array("id"), "way"))
        on = met.select(BOOK, "id", F.concat("way", fresh).alias("way"), (F.coalesce("_done", F.lit(True)) | (F.size(fresh) < F.size("_more"))).alias("done"))
        state = levels.save(state.filter("done").unionByName(on))
    return state.select(BOOK, "id", F.posexplode("way").alias("_k", "fallback_id")).select(BOOK, "id", (F.col("_k") + 1).alias("step"), "fallback_id")


def dangling_cleared(items: DataFrame) -> DataFrame:
    """fallback and media_overlay are null where they name no item."""
    for column in ("fallback", "media_overlay"):
        known = items.select(F.col(BOOK), F.col("id").alias(column)).distinct().withColumn("_known", F.lit(True))
        items = items.join(known, [BOOK, column], "left").withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")
    return items


def orphans(resources: DataFrame, items: DataFrame, keep_prefix: str = "/META-INF/") -> DataFrame:
    """Resources that no item names and that are kept all the same."""
    named = items.select(BOOK, href.decode(F.col("href")).alias("path"))
    return resources.join(named, [BOOK, "path"], "left_anti").filter(F.startswith("path", F.lit(keep_prefix)))


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Resources of a container with pending changes: base (path, content), overlay (path, content, moved_from).

    Content wins over the base, a moved resource is read at its old path and is no longer listed there."""
    moved = overlay.filter("moved_from is not null").select(F.col(BOOK), F.col("moved_from").alias("path"))
    stays = base.join(moved, [BOOK, "path"], "left_anti")
    renamed = overlay.filter("moved_from is not null").select(BOOK, "path", F.col("moved_from")).join(base.select(BOOK, F.col("path").alias("moved_from"), "content"), [BOOK, "moved_from"]).select(BOOK, "path", "content")
    fresh = overlay.filter("moved_from is null").select(BOOK, "path", "content").unionByName(renamed)
    return stays.join(fresh, [BOOK, "path"], "left_anti").select(BOOK, "path", "content").unionByName(fresh)
