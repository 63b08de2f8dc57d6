"""The report of constraints and the claims of refinements, on rows made by hand and against the decoder."""

import pytest

from bindery.operators import constraints
from bindery.plans import validated
from bindery.sources import epub

SF = "/root/testdata/sf0.001"
#: Every code that strict reading has for a package and its navigation.
CODES = {
    "missing_attribute", "invalid_version", "invalid_prefix", "missing_value", "cyclic_meta", "invalid_refines", "unencoded_href", "duplicate_item_id", "invalid_idref", "no_metadata_found",
    "no_manifest_found", "no_spine_found", "missing_title", "missing_language", "invalid_unique_identifier", "no_ncx_reference", "invalid_ncx_reference", "no_xhtml_toc_reference", "no_toc_found",
}


def frames(spark, **rows):
    return [spark.createDataFrame(rows.get(n, []), f"book_id string, {epub.SCHEMAS[n]}") for n in ("package", "meta", "manifest", "spine", "toc")]


def package(book, version="3.0", uid="u", family="epub3", prefixes=(), ncx=None):
    return (book, "/p.opf", "/", version, 3, 0, family, uid, list(prefixes), None, "auto", [], "default", ncx)


def entry(book, node, prop, value="x", key=None, refines=None, parent=None, kind="dc"):
    return (book, node, parent, "metadata", None, 0, node, None, key, refines, prop, value, None, "auto", [], kind)


def test_query_has_every_code(spark):
    report = validated.epub_validate(spark, SF)
    assert {r.code for r in report.select("code").distinct().collect()} == CODES
    # each of the 24 defects, and no other book, is told
    assert {r.d for r in report.selectExpr("book_id % 25 AS d").distinct().collect()} >= set(range(1, 24))
    assert not report.filter("book_id % 25 = 0").count() - report.filter("book_id % 25 = 0 AND code IN ('no_manifest_found', 'no_spine_found', 'no_xhtml_toc_reference', 'invalid_refines')").count()


def test_empty_tables_and_packages_alone(spark):
    assert constraints.violations(*frames(spark)).count() == 0
    got = {(r.code, r.detail) for r in constraints.violations(*frames(spark, package=[package("a", version=None, uid=None)])).collect()}
    sections = {(f"no_{x}_found", "") for x in ("metadata", "manifest", "spine")}
    assert got == sections | {("missing_title", ""), ("missing_language", ""), ("no_xhtml_toc_reference", ""), ("missing_attribute", "package[*version]"), ("missing_attribute", "package[*unique-identifier]")}
    assert constraints.first(constraints.violations(*frames(spark, package=[package("a", version="65536.1")]))).first()[1:] == (0, 0, "invalid_version", "65536.1")


@pytest.mark.parametrize("version,good", [("3", True), ("+3.0", True), ("3.0.x", True), ("3.x", False), ("x", False), ("65535", True), ("3.", False), (" 2.0 ", True)])
def test_versions_as_the_decoder(spark, version, good):
    from bindery.sources.package import version_family

    codes = {r.code for r in constraints.violations(*frames(spark, package=[package("a", version=version)])).collect()}
    assert ("invalid_version" not in codes) == good == (version_family(version)[0] is not None)


def test_cycles_refinements_and_nulls(spark):
    meta = [
        entry("a", 0, "dc:title"), entry("a", 1, "dc:language", key="l"), entry("a", 2, "dc:identifier", key="u"),
        entry("a", 3, "role", key="r", refines="s", parent=4, kind="meta3"), entry("a", 4, "role", key="s", refines="r", parent=3, kind="meta3"), entry("a", 5, "role", refines="s", parent=4, kind="meta3"),
        entry("a", 6, "role", refines="nowhere", kind="meta3"), entry("a", 7, "role", refines="i", kind="meta3"), entry("a", 8, None, value=None, kind="meta2"), entry("b", 0, "dc:title", value=None),
    ]
    items = [("a", 0, "i", "/i", "i", "x/y", None, None, "nav", []), ("a", 1, None, None, None, None, None, None, None, [])]
    spine = [("a", 0, None, "i", True, "", []), ("a", 1, None, None, True, "", [])]
    report = constraints.violations(*frames(spark, package=[package("a")], meta=meta, manifest=items, spine=spine))
    got = sorted((r.stage, r.ord, r.code, r.detail) for r in report.filter("book_id = 'a'").collect())
    name = "missing_attribute"
    assert got == [
        (1, 3, "cyclic_meta", "r"), (1, 4, "cyclic_meta", "s"), (1, 5, "cyclic_meta", "s"), (1, 6, "invalid_refines", "nowhere"), (1, 8, name, "metadata > meta[*content]"), (1, 8, name, "metadata > meta[*name]"),
        (2, 1, name, "manifest > item[*href]"), (2, 1, name, "manifest > item[*id]"), (2, 1, name, "manifest > item[*media-type]"), (3, 1, name, "spine > itemref[*idref]"),
    ]


def test_claims(spark):
    """Items before itemrefs, the first of equal ids, whole trees; rings and unknown ids are left out."""
    pending = spark.createDataFrame([("a", 0, None, "x"), ("a", 1, 0, "y"), ("a", 2, 1, "z"), ("a", 3, None, "x"), ("a", 4, None, "r"), ("a", 5, None, "no"), ("a", 6, 7, "q"), ("a", 7, 6, "p"), ("b", 0, None, "x"), ("a", 8, None, None)], "book_id string, node_id long, parent_node_id long, refines string")
    items = spark.createDataFrame([("a", "x", 4), ("a", "x", 2), ("a", None, 1)], "book_id string, id string, ord int")
    refs = spark.createDataFrame([("a", "x", 0), ("a", "r", 3)], "book_id string, id string, ord int")
    out = {(r.book_id, r.node_id): (r.owner, r.owner_key, r.owner_ord) for r in constraints.claimed(pending, items, refs).collect()}
    assert out == {**{("a", k): ("manifest", "x", 2) for k in (0, 1, 2, 3)}, ("a", 4): ("spine", "r", 3)}
    assert constraints.claimed(pending.limit(0), items, refs).count() == 0
