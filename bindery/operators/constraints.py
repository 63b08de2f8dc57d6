"""Constraints of strict books as one report over tables, and claims of refinements whose parents are items.

A book's rules are of three kinds. What a row breaks by itself is told row by row, without a shuffle. What has to be there without a name, as
a title, is one sum for each book. What has a name within the book, as the item of an itemref, is one sum for each key, of the definitions and uses of every
table: the bits of all rules it serves, and for each kind of rows that need it the bits of their places. Sums are of numbers only, so that no strings are sorted
and nothing is joined. Of the keys that lack something, those whose rows places do not tell apart, as they are beyond a number's bits or equal, are joined with their rows.
Tables that come dealt out by book into equally many partitions are not shuffled, as both sums go by the book before all else.

Defined results: null and empty attributes are missing ones; rows that are equal break a rule each; empty tables break no rule but
those of the packages that are there; other columns do not matter.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Levels
from .metadata import BOOK, tree

#: Where a reader of a package meets a rule, in its order.
PACKAGE, METADATA, MANIFEST, SPINE, SECTIONS, REQUIRED, NAVIGATION, TOC = range(8)
#: What a reference may not have without being encoded. Allowed characters are listed one by one, as Java looks these up in one table, but asks range by range.
UNENCODED = f"[^{string.ascii_letters}{string.digits}_.~%/:#?=&-]"
REPORT = (BOOK, "stage", "ord", "code", "detail")
#: What books, those of EPUB 3 and trees have to have, each once, and what a key needs, with their stages; a rule's bit is its place.
BOOKS = {"no_metadata_found": SECTIONS, "no_manifest_found": SECTIONS, "no_spine_found": SECTIONS, "missing_title": REQUIRED, "missing_language": REQUIRED}
THIRD = {"no_xhtml_toc_reference": NAVIGATION}
TREES = {"no_toc_found": TOC}
KEYS = {"invalid_unique_identifier": REQUIRED, "invalid_ncx_reference": NAVIGATION, "invalid_refines": METADATA, "invalid_idref": SPINE, "duplicate_item_id": MANIFEST}
TWICE = "duplicate_item_id"
#: The bit of a number that stands for all places from it on.
LAST = 63
BIT = {code: 1 << k for k, code in enumerate([*BOOKS, *THIRD, *TREES, *KEYS])}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _told(rows: DataFrame, stage: int, order: Column, *rules: tuple[Column, str, Column]) -> DataFrame:
    """What rows break by themselves: (condition, code, detail). Nulls are left out after the explosion, as a lambda here would be part of the filter that all rows pass."""
    found = F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.coalesce(d, F.lit("")).alias("detail"))) for c, code, d in rules])
    faulty = rows.filter(reduce(Column.__or__, [c for c, *_ in rules]))
    return faulty.select(BOOK, F.lit(stage).alias("stage"), order.cast("long").alias("ord"), F.explode(found).alias("_v")).filter("_v is not null").select(BOOK, "stage", "ord", "_v.code", "_v.detail")


def _bits(*rules: tuple[Column, str]) -> Column:
    """The bits of the rules whose condition holds."""
    return reduce(Column.bitwiseOR, [F.when(c, BIT[code]).otherwise(0) for c, code in rules])


def _there(rows: DataFrame, has: Column, **asking: Column) -> DataFrame:
    """What a row is there for, and what it asks of its book, as one of ``books``, ``third`` or ``trees``."""
    return rows.select(BOOK, has.alias("_has"), *[F.coalesce(asking.get(x, F.lit(False)), F.lit(False)).cast("long").alias(x) for x in ("books", "third", "trees")])


def _uses(rows: DataFrame, order: Column, key: str, code: str) -> DataFrame:
    """What rows need."""
    return rows.filter(~_blank(key)).select(BOOK, F.col(key).alias("_key"), order.cast("long").alias("ord"), F.lit(BIT[code]).alias("_needs"))


def _defined(rows: DataFrame, bits: Column) -> DataFrame:
    """What rows with an id are there for."""
    return rows.filter(~_blank("id")).select(BOOK, F.col("id").alias("_key"), bits.alias("_has"))


def _placed(rows: DataFrame) -> DataFrame:
    """Uses with their places as bits, the last of them for all places that have none."""
    place = F.when(F.col("ord").between(0, LAST - 1), F.col("ord").cast("int")).otherwise(LAST)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return rows.select(BOOK, "_key", F.lit(0).alias("_has"), *[F.when(F.col("_needs") == BIT[code], x).otherwise(0).cast("long").alias(f"{name}{code}") for code in KEYS for name, x in (("_n_", F.lit(1)), ("_at_", bit))])


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _absent(rows: DataFrame) -> DataFrame:
    """What has to be there without a name, and is not; a book is told as often as it asks."""
    found = rows.groupBy(BOOK).agg(F.bit_or("_has").alias("_has"), *[F.sum(x).alias(x) for x in ("books", "third", "trees")])
    rules = [(code, stage, asking) for asking, group in (("books", BOOKS), ("third", THIRD), ("trees", TREES)) for code, stage in group.items()]
    fails = [(F.col(asking) > 0) & (F.col("_has").bitwiseAND(BIT[code]) == 0) for code, _, asking in rules]
    told = [F.when(fail, F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.col(asking).cast("int").alias("n"))) for fail, (code, stage, asking) in zip(fails, rules, strict=True)]
    lacking = found.filter(reduce(Column.__or__, fails)).select(BOOK, F.explode(F.array(*told)).alias("_v")).filter("_v is not null").select(BOOK, "_v.*")
    return lacking.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("n")))).select(BOOK, "stage", F.lit(0).cast("long").alias("ord"), "code", F.lit("").alias("detail"))


def _at(code: str) -> Column:
    """Where a rule is broken, which the first item is not where a key is there twice."""
    places = F.filter(F.sequence(F.lit(0), F.lit(LAST - 1)), lambda k: F.call_function("getbit", F.col(f"_at_{code}"), k) == 1)
    return F.slice(places, 2, LAST) if code == TWICE else places


def _unmet(uses: list[DataFrame], definitions: list[DataFrame]) -> DataFrame:
    """Keys that are needed and not defined, and items whose key an earlier item has."""
    sums = [f"{name}{code}" for code in KEYS for name in ("_n_", "_at_")]
    none = {x: F.lit(0).cast("long") for x in sums}
    keys = _union(*[_placed(x) for x in uses], *[x.withColumns(none) for x in definitions]).groupBy(BOOK, "_key").agg(F.bit_or("_has").alias("_has"), *[(F.sum if x.startswith("_n_") else F.bit_or)(x).alias(x) for x in sums])
    fails = {code: F.col(f"_n_{code}") > 1 if code == TWICE else (F.col(f"_n_{code}") > 0) & (F.col("_has").bitwiseAND(BIT[code]) == 0) for code in KEYS}
    lacking = keys.withColumns({f"_fails_{code}": x for code, x in fails.items()}).filter(reduce(Column.__or__, [F.col(f"_fails_{code}") for code in KEYS]))
    told = {code: (F.col(f"_n_{code}") == F.bit_count(f"_at_{code}")) & (F.col(f"_at_{code}") >= 0) for code in KEYS}
    lacking = Levels(lacking).save(lacking.withColumn("_told", reduce(Column.__and__, [~F.col(f"_fails_{code}") | x for code, x in told.items()])))
    rows = [F.when(F.col(f"_fails_{code}"), F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), _at(code).alias("places"))) for code, stage in KEYS.items()]
    out = lacking.filter("_told").select(BOOK, F.explode(F.array(*rows)).alias("_v"), F.col("_key").alias("detail")).filter("_v is not null").select(BOOK, "_v.*", "detail")
    out = out.withColumn("ord", F.explode_outer("places")).select(BOOK, "stage", F.col("ord").cast("long").alias("ord"), "code", "detail")
    rest = lacking.filter("not _told")
    if rest.isEmpty():
        return out
    needs = reduce(Column.bitwiseOR, [F.when(F.col(f"_fails_{code}"), BIT[code]).otherwise(0) for code in KEYS])
    met = _union(*uses).join(rest.select(BOOK, "_key", needs.alias("_lacks")).hint("merge"), [BOOK, "_key"]).filter(F.col("_lacks").bitwiseAND(F.col("_needs")) != 0)
    again = F.row_number().over(Window.partitionBy(BOOK, "_key", "_needs").orderBy("ord"))
    met = met.withColumn("_again", again).filter((F.col("_needs") != BIT[TWICE]) | (F.col("_again") > 1))
    stage, code = (reduce(lambda other, x: F.when(F.col("_needs") == BIT[x[0]], x[k]).otherwise(other), KEYS.items(), F.lit(None)) for k in (1, 0))
    return out.unionByName(met.select(BOOK, stage.alias("stage"), "ord", code.alias("code"), F.col("_key").alias("detail")))


def _cycles(meta: DataFrame) -> DataFrame:
    """Entries on a cycle of parents, or below one. Keys cannot fall all the way round a cycle, so that only books with an entry whose parent's
    key is not below its own are walked."""
    below = meta.filter("parent_node_id is not null")
    suspects = below.filter("parent_node_id >= node_id").select(BOOK).distinct()
    below = Levels(meta).save(below.select(BOOK, "node_id", "parent_node_id", "natural_order", F.coalesce("id", "refines").alias("id")).join(suspects, BOOK, "left_semi"))
    reached = tree(below, "node_id", "parent_node_id").select(BOOK, "node_id")
    return _told(below.join(reached.hint("merge"), [BOOK, "node_id"], "left_anti"), METADATA, F.col("natural_order"), (F.lit(True), "cyclic_meta", F.col("id")))


def violations(package: DataFrame, meta: DataFrame, manifest: DataFrame, spine: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, stage, ord, code, detail): every rule that a book of ``package`` breaks, wherever its rows come from.

    Unlike strict decoding, which ends at a book's first fault, all of them are told; ``first`` gives the one that ends it. A refinement
    whose parent is no entry, item or itemref is invalid_refines at any level."""
    yes, none = F.lit(True), F.lit("")
    heads = F.split(F.trim("version_raw"), r"\.")
    major, minor = (x.rlike(r"\A\+?[0-9]{1,5}\z") & (x.try_cast("int") < 65536) for x in (F.get(heads, F.lit(0)), F.get(heads, F.lit(1))))
    parsed = major & ((F.size(heads) < 2) | minor)
    bad = F.filter("prefixes", lambda p: (F.coalesce(p["name"], none) == "") | (F.coalesce(p["uri"], none) == ""))
    top = F.col("parent_node_id").isNull()
    root, leaf = F.size("path") == 0, F.size("path") > 0
    nav = F.contains("properties", F.lit("nav")) & F.array_contains(F.split("properties", r"\s+"), "nav")
    told = _union(
        _told(
            package, PACKAGE, F.lit(0), (_blank("version_raw"), "missing_attribute", F.lit("package[*version]")), (~_blank("version_raw") & ~parsed, "invalid_version", F.col("version_raw")),
            (_blank("unique_identifier"), "missing_attribute", F.lit("package[*unique-identifier]")),
        ),
        _told(package.filter(F.size("prefixes") > 0), PACKAGE, F.lit(0), (F.size(bad) > 0, "invalid_prefix", F.get(bad, F.lit(0))["name"])),
        _told(package.filter("family = 'epub2'"), NAVIGATION, F.lit(0), (_blank("ncx_id"), "no_ncx_reference", none)),
        _told(
            meta, METADATA, F.col("natural_order"), (F.col("kind").isin("dc", "meta3") & F.col("value").isNull(), "missing_value", F.col("property")),
            ((F.col("kind") == "meta2") & _blank("property"), "missing_attribute", F.lit("metadata > meta[*name]")), ((F.col("kind") == "meta2") & F.col("value").isNull(), "missing_attribute", F.lit("metadata > meta[*content]")),
        ),
        _cycles(meta),
        _told(
            manifest, MANIFEST, F.col("ord"), (_blank("id"), "missing_attribute", F.lit("manifest > item[*id]")), (_blank("href_raw"), "missing_attribute", F.lit("manifest > item[*href]")),
            (_blank("media_type"), "missing_attribute", F.lit("manifest > item[*media-type]")), (F.col("href_raw").rlike(UNENCODED), "unencoded_href", F.col("href_raw")),
        ),
        _told(spine, SPINE, F.col("ord"), (_blank("idref"), "missing_attribute", F.lit("spine > itemref[*idref]"))),
        _told(toc, TOC, F.col("root_ord"), (leaf & _blank("href") & _blank("label"), "missing_attribute", F.lit("toc > entry[*href]"))),
    )
    owned = top & _blank("refines")
    identifier = owned & (F.col("property") == "dc:identifier")
    item = BIT["invalid_idref"] | BIT["invalid_ncx_reference"] | BIT["invalid_refines"]
    there = _union(
        _there(package, _bits((~_blank("ncx_id"), "no_xhtml_toc_reference")), books=yes, third=F.col("family") == "epub3"),
        _there(meta, _bits((yes, "no_metadata_found"), (owned & (F.col("property") == "dc:title"), "missing_title"), (owned & (F.col("property") == "dc:language"), "missing_language"))),
        _there(manifest, _bits((yes, "no_manifest_found"), (nav, "no_xhtml_toc_reference"))),
        _there(spine, _bits((yes, "no_spine_found"))),
        _there(toc.filter(root), _bits((F.col("root_kind") == "toc", "no_toc_found")), trees=F.col("root_ord") == 0),
    )
    uses = [
        _uses(package, F.lit(0), "unique_identifier", "invalid_unique_identifier"), _uses(package, F.lit(0), "ncx_id", "invalid_ncx_reference"), _uses(meta.filter(top), F.col("natural_order"), "refines", "invalid_refines"),
        _uses(manifest, F.col("ord"), "id", TWICE), _uses(spine, F.col("ord"), "idref", "invalid_idref"),
    ]
    definitions = [_defined(meta, _bits((yes, "invalid_refines"), (identifier, "invalid_unique_identifier"))), _defined(manifest, F.lit(item)), _defined(spine, F.lit(BIT["invalid_refines"]))]
    absent, unmet = _absent(there), _unmet(uses, definitions)
    return _union(told.select(*REPORT), absent, unmet)


def first(report: DataFrame) -> DataFrame:
    """A book's first violation: by stage, then order, then code."""
    return report.groupBy(BOOK).agg(F.min(F.struct("stage", "ord", "code", "detail")).alias("_v")).select(BOOK, "_v.*")


def claimed(pending: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """Refinements that no metadata entry took, with the owner that takes them: owner (manifest or spine), owner_key and owner_ord.

    ``pending`` has book_id, node_id, parent_node_id and refines; a tree of them belongs to who takes its root. An id is taken once, by
    the first item that has it in document order, else by the first itemref; later ones of that id go without. What nobody takes is left out, and so
    is what hangs on a cycle."""
    claimers = manifest.select(BOOK, "id", F.col("ord").cast("long").alias("_item"), F.lit(None).cast("long").alias("_ref")).unionByName(spine.select(BOOK, "id", F.lit(None).cast("long").alias("_item"), F.col("ord").cast("long").alias("_ref")))
    taken = claimers.filter(~_blank("id")).groupBy(BOOK, F.col("id").alias("refines")).agg(F.min("_item").alias("_item"), F.min("_ref").alias("_ref"))
    tops = pending.filter("parent_node_id is null").select(BOOK, F.col("node_id").alias("root"), "refines").join(taken.hint("merge"), [BOOK, "refines"])
    owner = F.when(F.col("_item").isNotNull(), "manifest").otherwise("spine")
    owners = tops.select(BOOK, "root", owner.alias("owner"), F.col("refines").alias("owner_key"), F.coalesce("_item", "_ref").alias("owner_ord"))
    roots = tree(pending.select(BOOK, "node_id", "parent_node_id"), "node_id", "parent_node_id").select(BOOK, "node_id", "root")
    columns = [c for c in pending.columns if c not in ("owner", "owner_key", "owner_ord")]
    return pending.select(*columns).join(roots.join(owners.hint("merge"), [BOOK, "root"]).drop("root").hint("merge"), [BOOK, "node_id"])
