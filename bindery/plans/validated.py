"""Queries of constraints: orders are books, their lines items, itemrefs and entries; the order's key says which rule a book breaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import constraints
from ..operators.common import Levels
from . import adapters
from .registry import query

_RUN = 1000  # lines that one array numbers
_LINES = "(SELECT l_orderkey AS book_id, l_orderkey % 25 AS d, l_orderkey % 50 AS e, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS j FROM lineitem)"
#: The defect d of a book, as expressions that both engines read.
_VERSION = "CASE d WHEN 1 THEN '' WHEN 2 THEN 'three' WHEN 3 THEN '2.0' WHEN 4 THEN '2.0' ELSE '3.0' END"
_FAMILY = "CASE d WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'epub2' WHEN 4 THEN 'epub2' ELSE 'epub3' END"
_UID = "CASE d WHEN 5 THEN '' WHEN 6 THEN 'other' ELSE 'u' END"
_NCX = "CASE d WHEN 4 THEN 'lost' END"
_ITEM_ID = "CASE WHEN d = 15 THEN 'i0' ELSE concat('i', j) END"
_HREF = "CASE WHEN d = 16 THEN concat('c ', j, '.xhtml') ELSE concat('c', j, '.xhtml') END"
_TYPE = "CASE WHEN d = 17 AND j = 1 THEN '' ELSE 'application/xhtml+xml' END"
_PROPERTIES = "CASE WHEN j = 0 AND d <> 18 THEN 'scripted nav' ELSE 'svg' END"
_IDREF = "CASE WHEN d = 20 AND j > 0 THEN concat('x', j) WHEN d = 22 THEN '' ELSE concat('i', j) END"
_REF_ID = "CASE WHEN j = 0 THEN 'first' END"
_ROOT = "CASE WHEN d = 23 THEN 'landmarks' ELSE 'toc' END"
_TOC_HREF = "CASE WHEN e <> 24 THEN '/c0.xhtml' END"
_TOC_LABEL = "CASE WHEN e <> 24 THEN 'Start' ELSE '' END"
#: node, kind, property, id, refines, parent, value and the condition under which a book has the entry.
_META = [
    ("0", "'dc'", "'dc:title'", "'t'", "NULL", "NULL", "CASE WHEN d <> 12 THEN 'Title' END", "d <> 8"),
    ("1", "'dc'", "'dc:language'", "NULL", "NULL", "NULL", "'en'", "d <> 9"),
    ("2", "'dc'", "'dc:identifier'", "'u'", "NULL", "NULL", "'urn:1'", "true"),
    ("3", "'meta3'", "'identifier-type'", "NULL", "'u'", "2", "'15'", "true"),
    ("4", "'meta3'", "'role'", "'a'", "'b'", "5", "'x'", "d = 11"),
    ("5", "'meta3'", "'role'", "'b'", "'a'", "4", "'y'", "d = 11"),
    ("6", "'meta3'", "'duration'", "'m'", "CASE WHEN d = 10 THEN 'gone' WHEN e > 24 THEN 'i0' ELSE 'first' END", "NULL", "'z'", "d NOT IN (15, 19, 21)"),
    ("7", "'meta3'", "'note'", "NULL", "'m'", "6", "'below'", "d NOT IN (15, 19, 21)"),
    ("8", "'meta2'", "CASE WHEN d = 14 THEN '' ELSE 'cover' END", "NULL", "NULL", "NULL", "'i0'", "true"),
]


def _tables(s, d):
    # Books are dealt out while they are one row each; what they are made into stays where it is.
    parts, defect = int(s.conf.get("spark.sql.shuffle.partitions")), {"d": F.col("book_id") % 25, "e": F.col("book_id") % 50}
    books = adapters.read(s, d, "orders").select(F.col("o_orderkey").alias("book_id")).repartition(parts, "book_id").withColumns(defect)
    # Lines of an order differ by their number alone, and numbers are 0 to n - 1 in any order, so that lines are counted, not sorted; counts are dealt out by runs.
    counts = adapters.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("book_id")).agg(F.count("*").alias("n"))
    counts = Levels(counts).save(counts).repartition(parts, "book_id").withColumns(defect)  # many scans, one count
    runs = counts.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {_RUN}L)")))
    lines = runs.select("book_id", "d", "e", F.explode(F.expr(f"sequence(int(at), int(least(at + {_RUN - 1}, n - 1)))")).alias("j"))
    prefixes = "CASE WHEN d = 7 THEN array(named_struct('name', 'a', 'uri', 'urn:a'), named_struct('name', 'b', 'uri', '')) ELSE array() END AS prefixes"
    package = books.selectExpr("book_id", f"{_VERSION} AS version_raw", f"{_FAMILY} AS family", f"{_UID} AS unique_identifier", f"{_NCX} AS ncx_id", prefixes)
    meta = books.withColumn("natural_order", F.explode(F.array([F.lit(int(n)).cast("long") for n, *_ in _META])))
    case = lambda k, cast: f"CAST(CASE natural_order {' '.join(f'WHEN {row[0]} THEN {row[k]}' for row in _META)} END AS {cast})"
    fields = [f"{case(k, cast)} AS {name}" for k, (name, cast) in enumerate({"kind": "string", "property": "string", "id": "string", "refines": "string", "parent_node_id": "long", "value": "string"}.items(), 1)]
    meta = meta.filter(f"d <> 13 AND {case(7, 'boolean')}").selectExpr("book_id", "natural_order", "natural_order AS node_id", *fields)
    manifest = lines.filter("d <> 19").selectExpr("book_id", "j AS ord", f"{_ITEM_ID} AS id", f"{_HREF} AS href_raw", f"{_TYPE} AS media_type", f"{_PROPERTIES} AS properties")
    spine = lines.filter("d <> 21").selectExpr("book_id", "j AS ord", f"{_REF_ID} AS id", f"{_IDREF} AS idref")
    root = counts.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    toc = root.selectExpr("book_id", f"{_ROOT} AS root_kind", "0 AS root_ord", "CASE k WHEN 0 THEN CAST(array() AS array<int>) ELSE array(0) END AS path", f"CASE k WHEN 1 THEN {_TOC_HREF} END AS href", f"CASE k WHEN 1 THEN {_TOC_LABEL} ELSE '' END AS label")
    return package, meta, manifest, spine, toc


_WITH = f"""WITH o AS (SELECT o_orderkey AS book_id, o_orderkey % 25 AS d, o_orderkey % 50 AS e FROM orders), l AS {_LINES},
  p AS (SELECT book_id, d, {_VERSION} AS version_raw, {_FAMILY} AS family, {_UID} AS uid, {_NCX} AS ncx_id FROM o),
  m AS ({" UNION ALL ".join(f"SELECT book_id, {n} AS ord, {kind} AS kind, {prop} AS property, {key} AS id, {refines} AS refines, CAST({parent} AS BIGINT) AS parent, {value} AS value FROM o WHERE d <> 13 AND {when}" for n, kind, prop, key, refines, parent, value, when in _META)}),
  i AS (SELECT book_id, j AS ord, {_ITEM_ID} AS id, {_HREF} AS href, {_TYPE} AS media_type, {_PROPERTIES} AS properties FROM l WHERE d <> 19),
  s AS (SELECT book_id, j AS ord, {_REF_ID} AS id, {_IDREF} AS idref FROM l WHERE d <> 21),
  t AS (SELECT book_id, {_ROOT} AS root_kind, {_TOC_HREF} AS href, {_TOC_LABEL} AS label FROM l WHERE j = 0),
  v AS (
    SELECT book_id, 0 AS stage, 0 AS ord, 'missing_attribute' AS code, 'package[*version]' AS detail FROM p WHERE version_raw = ''
    UNION ALL SELECT book_id, 0, 0, 'invalid_version', version_raw FROM p WHERE version_raw <> '' AND NOT regexp_full_match(version_raw, '[0-9]+([.].*)?')
    UNION ALL SELECT book_id, 0, 0, 'missing_attribute', 'package[*unique-identifier]' FROM p WHERE uid = ''
    UNION ALL SELECT book_id, 0, 0, 'invalid_prefix', 'b' FROM p WHERE d = 7
    UNION ALL SELECT book_id, 1, ord, 'missing_value', property FROM m WHERE kind <> 'meta2' AND value IS NULL
    UNION ALL SELECT book_id, 1, ord, 'missing_attribute', 'metadata > meta[*name]' FROM m WHERE kind = 'meta2' AND property = ''
    UNION ALL SELECT a.book_id, 1, a.ord, 'cyclic_meta', a.id FROM m a JOIN m b ON b.book_id = a.book_id AND b.ord = a.parent AND b.parent = a.ord
    UNION ALL SELECT book_id, 1, ord, 'invalid_refines', refines FROM m WHERE refines IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM m x WHERE x.book_id = m.book_id AND x.id = m.refines) AND NOT EXISTS (SELECT 1 FROM i x WHERE x.book_id = m.book_id AND x.id = m.refines) AND NOT EXISTS (SELECT 1 FROM s x WHERE x.book_id = m.book_id AND x.id = m.refines)
    UNION ALL SELECT book_id, 2, ord, 'missing_attribute', 'manifest > item[*media-type]' FROM i WHERE media_type = ''
    UNION ALL SELECT book_id, 2, ord, 'unencoded_href', href FROM i WHERE href LIKE '% %'
    UNION ALL SELECT book_id, 2, ord, 'duplicate_item_id', id FROM i WHERE EXISTS (SELECT 1 FROM i x WHERE x.book_id = i.book_id AND x.id = i.id AND x.ord < i.ord)
    UNION ALL SELECT book_id, 3, ord, 'missing_attribute', 'spine > itemref[*idref]' FROM s WHERE idref = ''
    UNION ALL SELECT book_id, 3, ord, 'invalid_idref', idref FROM s WHERE idref <> '' AND NOT EXISTS (SELECT 1 FROM i WHERE i.book_id = s.book_id AND i.id = s.idref)
    UNION ALL SELECT book_id, 4, 0, 'no_metadata_found', '' FROM p WHERE book_id NOT IN (SELECT book_id FROM m)
    UNION ALL SELECT book_id, 4, 0, 'no_manifest_found', '' FROM p WHERE book_id NOT IN (SELECT book_id FROM i)
    UNION ALL SELECT book_id, 4, 0, 'no_spine_found', '' FROM p WHERE book_id NOT IN (SELECT book_id FROM s)
    UNION ALL SELECT book_id, 5, 0, 'missing_title', '' FROM p WHERE book_id NOT IN (SELECT book_id FROM m WHERE property = 'dc:title')
    UNION ALL SELECT book_id, 5, 0, 'missing_language', '' FROM p WHERE book_id NOT IN (SELECT book_id FROM m WHERE property = 'dc:language')
    UNION ALL SELECT book_id, 5, 0, 'invalid_unique_identifier', uid FROM p WHERE uid <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.book_id = p.book_id AND property = 'dc:identifier' AND m.id = p.uid)
    UNION ALL SELECT book_id, 6, 0, 'no_ncx_reference', '' FROM p WHERE family = 'epub2' AND ncx_id IS NULL
    UNION ALL SELECT book_id, 6, 0, 'invalid_ncx_reference', ncx_id FROM p WHERE ncx_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.book_id = p.book_id AND i.id = p.ncx_id)
    UNION ALL SELECT book_id, 6, 0, 'no_xhtml_toc_reference', '' FROM p WHERE family = 'epub3' AND ncx_id IS NULL AND book_id NOT IN (SELECT book_id FROM i WHERE properties = 'scripted nav')
    UNION ALL SELECT book_id, 7, 0, 'no_toc_found', '' FROM t WHERE root_kind <> 'toc'
    UNION ALL SELECT book_id, 7, 0, 'missing_attribute', 'toc > entry[*href]' FROM t WHERE href IS NULL AND label = '')
"""


@query(f"{_WITH} SELECT book_id, stage, ord, code, detail FROM v")
def epub_validate(s, d):
    """Every rule that a book breaks."""
    return constraints.violations(*_tables(s, d))


@query(f"{_WITH} SELECT book_id, stage, ord, code, detail FROM v QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY stage, ord, code, detail) = 1")
def epub_validate_first(s, d):
    """The rule that ends strict reading of a book."""
    return constraints.first(constraints.violations(*_tables(s, d)))


@query(
    f"""WITH l AS {_LINES}, c AS (SELECT book_id, id, owner, ord, row_number() OVER (PARTITION BY book_id, id ORDER BY owner, ord) AS k FROM (
        SELECT book_id, concat('k', l_partkey % 5) AS id, 'manifest' AS owner, j AS ord FROM l WHERE j % 2 = 0 UNION ALL SELECT book_id, concat('k', (l_partkey + l_suppkey) % 7), 'spine', j FROM l))
    SELECT n.book_id, n.j AS node_id, owner, c.id AS owner_key, ord AS owner_ord FROM l n
    JOIN l r ON r.book_id = n.book_id AND r.j = CASE WHEN n.j % 3 = 0 THEN n.j ELSE n.j - n.j % 3 END JOIN c ON c.book_id = r.book_id AND c.id = concat('k', r.l_suppkey % 8) AND k = 1"""
)
def meta_claims(s, d):
    """Refinements of no entry, three in a chain, taken by the first item with their root's id, else by the first itemref."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = adapters.read(s, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_partkey", "l_suppkey", (F.row_number().over(order) - 1).cast("long").alias("j"))
    lines = Levels(lines).save(lines)  # many scans, one sort
    pending = lines.selectExpr("book_id", "j AS node_id", "CASE WHEN j % 3 > 0 THEN j - 1 END AS parent_node_id", "CASE WHEN j % 3 = 0 THEN concat('k', l_suppkey % 8) ELSE concat('n', j - 1) END AS refines")
    items = lines.filter("j % 2 = 0").selectExpr("book_id", "concat('k', l_partkey % 5) AS id", "j AS ord")
    refs = lines.selectExpr("book_id", "concat('k', (l_partkey + l_suppkey) % 7) AS id", "j AS ord")
    return constraints.claimed(pending, items, refs).select("book_id", "node_id", "owner", "owner_key", "owner_ord")
