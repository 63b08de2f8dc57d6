"""Metadata: groups by property, refinements, and the entries with a meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .common import Levels, first_of

BOOK = "book_id"


def ordered(entries: DataFrame) -> DataFrame:
    """Adds group_ord (properties in the order of first appearance) and ord (in a property by display_seq, missing last)."""
    starts = entries.groupBy(BOOK, "property").agg(F.min("natural_order").alias("_start"))
    starts = starts.withColumn("group_ord", F.row_number().over(Window.partitionBy(BOOK).orderBy("_start")) - 1).drop("_start")
    within = Window.partitionBy(BOOK, "property").orderBy(F.col("display_seq").asc_nulls_last(), "natural_order")
    return entries.join(starts, [BOOK, "property"]).withColumn("ord", F.row_number().over(within) - 1)


def by_property(entries: DataFrame, name: str) -> DataFrame:
    return entries.filter((F.col("property") == name) & F.col("parent_node_id").isNull())


def by_id(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """For each (book_id, id) the first entry of that id, depth-first: groups, their entries, and below each its refinements in order.
    Entries on a ring of parents, or below one, are in no tree and never found.

    Only entries with a wanted id are walked up to their roots, a join for each level. Where a round ends no walk there may be a ring:
    then only what ``tree`` reaches goes on."""
    way = F.struct(F.col("group_ord").alias("g"), F.col("ord").alias("o"))
    levels = Levels(entries)
    asked = ids.select(BOOK, "id").distinct()
    entries = levels.save(entries.filter("owner = 'metadata'"))
    above = entries.select(BOOK, F.col("node_id").alias("_up"), F.col("parent_node_id").alias("_next"), way.alias("_step"))
    found = entries.join(asked, [BOOK, "id"], "left_semi")
    open_ = levels.save(found.select(BOOK, "node_id", F.col("parent_node_id").alias("_up"), F.array(way).alias("_way")))
    done, checked, before = None, False, None
    while True:
        top = open_.filter("_up is null").select(BOOK, "node_id", "_way")
        done = top if done is None else done.unionByName(top)
        rest = open_.filter("_up is not null")
        left = rest.count()
        if not left:
            break
        if left == before and not checked:
            rest, checked = rest.join(tree(entries, "node_id", "parent_node_id").select(BOOK, "node_id"), [BOOK, "node_id"], "left_semi"), True
        before = left
        open_ = levels.save(rest.join(above, [BOOK, "_up"]).select(BOOK, "node_id", F.col("_next").alias("_up"), F.concat(F.array("_step"), "_way").alias("_way")))
    return first_of(found.join(done, [BOOK, "node_id"]), [BOOK, "id"], [F.col("_way")]).drop("_way")


def links(entries: DataFrame) -> DataFrame:
    """Link entries that refine nothing."""
    return entries.filter((F.col("kind") == "link") & F.col("parent_node_id").isNull())


def scheme(entries: DataFrame) -> DataFrame:
    """scheme_source and scheme_code of any entry: the attribute opf:scheme without a source, else the attribute scheme and the value."""
    old, new = text.attribute(F.col("attributes"), "opf:scheme"), text.attribute(F.col("attributes"), "scheme")
    return entries.withColumns({"scheme_source": F.when(old.isNull(), new), "scheme_code": F.coalesce(old, F.col("value"))})


def refinements(entries: DataFrame, name: str | None = None) -> DataFrame:
    rows = entries.filter(F.col("parent_node_id").isNotNull())
    return rows if name is None else rows.filter(F.col("property") == name)


def first_refinement(entries: DataFrame, name: str, *columns: str) -> DataFrame:
    """book_id, node_id of the parent, and columns of its first refinement of this name."""
    rows = refinements(entries, name).select(BOOK, F.col("parent_node_id").alias("_parent"), "ord", *columns)
    low = first_of(rows, [BOOK, "_parent"], [F.col("ord")]).withColumnRenamed("_parent", "node_id")
    return low.select(BOOK, "node_id", *columns)


def file_as(entries: DataFrame) -> DataFrame:
    """The refinement file-as, else the attribute opf:file-as."""
    roots = entries.filter(F.col("parent_node_id").isNull())
    found = first_refinement(entries, "file-as", "value").withColumnRenamed("value", "_refined")
    return roots.join(found, [BOOK, "node_id"], "left").withColumn("file_as", F.coalesce("_refined", text.attribute(F.col("attributes"), "opf:file-as"))).drop("_refined")


def roles(entries: DataFrame) -> DataFrame:
    """All role refinements in order; only where there are none, the attribute opf:role."""
    roots = entries.filter(F.col("parent_node_id").isNull() & F.col("property").isin("dc:creator", "dc:contributor"))
    found = refinements(entries, "role").groupBy(BOOK, F.col("parent_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_roles"))
    own = text.attribute(F.col("attributes"), "opf:role")
    out = roots.join(found, [BOOK, "node_id"], "left")
    return out.withColumn("roles", F.when(F.size("_roles") > 0, F.transform("_roles", lambda r: r["value"])).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))).drop("_roles")


def main_title(entries: DataFrame) -> DataFrame:
    """The title refined as main, else the first title."""
    main = refinements(entries, "title-type").filter(F.col("value") == "main").select(BOOK, F.col("parent_node_id").alias("node_id")).distinct().withColumn("_main", F.lit(0))
    titles = by_property(entries, "dc:title").join(main, [BOOK, "node_id"], "left")
    return first_of(titles, [BOOK], [F.coalesce("_main", F.lit(1)), F.col("ord")]).drop("_main")


#: Kinds of titles.
TITLE_KINDS = ("main", "subtitle", "short", "collection", "edition", "expanded")


def title_kinds(entries: DataFrame) -> DataFrame:
    """Titles with their kind: main for the book's main title, whatever it says; else its title-type if that is known, else unknown."""
    said = first_refinement(entries, "title-type", "value").withColumnRenamed("value", "_said")
    main = main_title(entries).select(BOOK, "node_id", F.lit(True).alias("_main"))
    out = by_property(entries, "dc:title").join(said, [BOOK, "node_id"], "left").join(main, [BOOK, "node_id"], "left")
    kind = F.when(F.col("_main"), "main").when(F.lower("_said").isin(*TITLE_KINDS), F.lower("_said")).otherwise("unknown")
    return out.withColumn("title_kind", kind).drop("_said", "_main")


def main_role(entries: DataFrame) -> DataFrame:
    """The first of ``roles``, null without any."""
    return roles(entries).withColumn("main_role", F.get("roles", F.lit(0)))


def languages(entries: DataFrame) -> DataFrame:
    """Language entries with their scheme, which is always BCP 47."""
    return by_property(entries, "dc:language").withColumns({"scheme_source": F.lit("BCP 47"), "scheme_code": F.col("value"), "language_kind": F.lit("bcp47")})


def _event(name: str) -> Column:
    return text.attribute(F.col("attributes"), "opf:event") == name


def published(entries: DataFrame) -> DataFrame:
    """The date with the event publication, else the first date without an event."""
    dates = by_property(entries, "dc:date").withColumn("_rank", F.when(_event("publication"), 0).when(text.attribute(F.col("attributes"), "opf:event").isNull(), 1))
    return first_of(dates.filter("_rank is not null"), [BOOK], [F.col("_rank"), F.col("ord")]).drop("_rank")


def modified(entries: DataFrame) -> DataFrame:
    """The first dcterms:modified, else the date with the event modification."""
    roots = entries.filter(F.col("parent_node_id").isNull())
    rank = F.when(F.col("property") == "dcterms:modified", 0).when((F.col("property") == "dc:date") & _event("modification"), 1)
    return first_of(roots.withColumn("_rank", rank).filter("_rank is not null"), [BOOK], [F.col("_rank"), F.col("ord")]).drop("_rank")


def unique_identifier(entries: DataFrame, package: DataFrame) -> DataFrame:
    """The first dc:identifier with the id that the package names."""
    met = by_property(entries, "dc:identifier").join(package.select(BOOK, "unique_identifier"), BOOK).filter(F.col("id") == F.col("unique_identifier"))
    return first_of(met.drop("unique_identifier"), [BOOK], [F.col("ord")])


def inherited(entries: DataFrame, package: DataFrame) -> DataFrame:
    """Language and direction of an entry, else of its package."""
    base = package.select(BOOK, F.col("language").alias("_language"), F.col("text_direction").alias("_direction"))
    out = entries.join(base, BOOK, "left")
    out = out.withColumn("language", F.coalesce("language", "_language"))
    return out.withColumn("text_direction", F.when(F.col("text_direction") == "auto", F.col("_direction")).otherwise(F.col("text_direction"))).drop("_language", "_direction")


def identifier_scheme(entries: DataFrame) -> DataFrame:
    """source and code: of the refinement identifier-type, else of the attribute opf:scheme."""
    found = first_refinement(entries, "identifier-type", "value", "attributes")
    found = found.select(BOOK, "node_id", text.attribute(F.col("attributes"), "scheme").alias("_source"), F.col("value").alias("_code"))
    out = by_property(entries, "dc:identifier").join(found, [BOOK, "node_id"], "left")
    return out.withColumn("scheme_source", F.col("_source")).withColumn("scheme_code", F.coalesce("_code", text.attribute(F.col("attributes"), "opf:scheme"))).drop("_source", "_code")


def tag_scheme(entries: DataFrame) -> DataFrame:
    """authority and term, both or none: attributes first, else refinements."""
    a, t = (text.attribute(F.col("attributes"), f"opf:{x}") for x in ("authority", "term"))
    out = by_property(entries, "dc:subject")
    for name in ("authority", "term"):
        out = out.join(first_refinement(entries, name, "value").withColumnRenamed("value", f"_{name}"), [BOOK, "node_id"], "left")
    refined = F.when(F.col("_authority").isNotNull() & F.col("_term").isNotNull(), F.struct(F.col("_authority").alias("authority"), F.col("_term").alias("term")))
    both = F.when(a.isNotNull() & t.isNotNull(), F.struct(a.alias("authority"), t.alias("term")))
    return out.withColumn("scheme", F.coalesce(both, refined)).drop("_authority", "_term")


def alternate_scripts(entries: DataFrame) -> DataFrame:
    """array<struct<value, language>>: the refinements alternate-script, else opf:alt-rep with opf:alt-rep-lang."""
    roots = entries.filter(F.col("parent_node_id").isNull())
    rows = refinements(entries, "alternate-script").withColumn("_s", F.struct("ord", "value", F.coalesce("language", F.lit("")).alias("language")))
    found = rows.groupBy(BOOK, F.col("parent_node_id").alias("node_id")).agg(F.array_sort(F.collect_list("_s")).alias("_scripts"))
    v, lang = text.attribute(F.col("attributes"), "opf:alt-rep"), text.attribute(F.col("attributes"), "opf:alt-rep-lang")
    plain = lambda s: F.struct(s["value"].alias("value"), s["language"].alias("language"))
    legacy = F.when(v.isNotNull() & lang.isNotNull(), F.array(F.struct(v.alias("value"), lang.alias("language")))).otherwise(F.array().cast("array<struct<value string, language string>>"))
    out = roots.join(found, [BOOK, "node_id"], "left")
    return out.withColumn("scripts", F.when(F.size("_scripts") > 0, F.transform("_scripts", plain)).otherwise(legacy)).drop("_scripts")


def tree(links: DataFrame, key: str, parent: str, book: str = BOOK) -> DataFrame:
    """(book, key, depth, root) of every node that is reached from a root; nodes on a cycle and below it are not reached.

    ``links`` has one row for each node; a null parent, or one that is no node, makes a root. Each round doubles the length of the
    ways that are known, so that there are as many rounds as the logarithm of the depth; it ends when a round reaches no more nodes.
    What has been reached is written once, and only the rest goes on."""
    levels = Levels(links)
    rows = links.select(F.col(book).alias("b"), F.col(key).alias("k"), F.col(parent).alias("p"))
    above = rows.groupBy("b", F.col("k").alias("p")).agg(F.bool_and(F.col("p").isNull()).alias("top"))
    met = rows.filter("p is not null").join(above.hint("merge"), ["b", "p"], "left").select("b", "k", F.when(F.col("top").isNull(), F.col("k")).otherwise(F.col("p")).alias("at"), F.when(F.col("top").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("top", F.lit(True)).alias("done"))
    state = levels.save(rows.filter("p is null").select("b", "k", F.col("k").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done")).unionByName(met))
    reached, rest = state.filter("done"), state.filter("not done")
    left = rest.count()
    while left:
        there = reached.unionByName(rest).select("b", F.col("k").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        on = rest.drop("done").join(there.hint("merge"), ["b", "at"]).select("b", "k", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = levels.save(on)
        reached, rest = reached.unionByName(state.filter("done")), state.filter("not done")
        before, left = left, rest.count()
        if left == before:
            break
    return reached.select(F.col("b").alias(book), F.col("k").alias(key), F.col("depth").cast("int").alias("depth"), F.col("at").alias("root"))
