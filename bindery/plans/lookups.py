"""Queries of point lookups, refined metadata, edits of pairs and trees, and whole books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import civil, text
from ..operators import common, edit, manifest, metadata, reader, rewrite, toc
from ..sources import epub, sink
from . import adapters, books
from .registry import query
from .relations import _MANIFEST, _ORDER, _ROOTS, _SPINE, _TALKS, _TREE

#: Customers as entries, with what their attributes say; orders as what refines them.
_META = """(SELECT c_nationkey AS book_id, c_custkey AS k, 'id-' || c_custkey AS id, c_name AS value, c_custkey % 7 AS p, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS language, CASE WHEN c_custkey % 5 = 0 THEN 'rtl' ELSE 'auto' END AS direction,
  CASE c_custkey % 3 WHEN 0 THEN 'publication' WHEN 1 THEN 'modification' END AS event, CASE WHEN c_custkey % 2 = 0 THEN 'FA-' || c_custkey END AS fa, CASE WHEN c_custkey % 5 < 3 THEN 'r' || c_custkey % 4 END AS role FROM customer)"""
_REFINING = "(SELECT c_nationkey AS book_id, o_custkey AS k, o_orderkey AS n, 'id-' || o_orderkey % 90 AS id, o_orderkey % 5 AS p, CASE WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'main' WHEN o_orderkey % 2 = 0 THEN 'Short' ELSE 'subtitle' END ELSE o_orderpriority END AS value FROM orders JOIN customer ON c_custkey = o_custkey)"


def _entries(s, d):
    return metadata.ordered(adapters.creators(s, d))


@query(f"SELECT m.book_id, m.k AS node_id, coalesce((SELECT arg_min(r.value, r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 1), fa) AS file_as FROM {_META} m")
def meta_file_as(s, d):
    return metadata.file_as(_entries(s, d)).select("book_id", "node_id", "file_as")


@query(f"SELECT m.book_id, m.k AS node_id, coalesce((SELECT string_agg(r.value, ',' ORDER BY r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 0), role, '') AS roles, coalesce((SELECT arg_min(r.value, r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 0), role) AS main_role FROM {_META} m WHERE p = 4")
def meta_roles_fallback(s, d):
    return metadata.main_role(_entries(s, d)).select("book_id", "node_id", F.array_join("roles", ",").alias("roles"), "main_role")


_TITLES = f"(SELECT m.*, EXISTS (SELECT 1 FROM {_REFINING} r WHERE r.k = m.k AND r.p = 2 AND r.value = 'main') AS main, (SELECT arg_min(lower(r.value), r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 2) AS said FROM {_META} m WHERE p = 0)"


@query(f"SELECT book_id, arg_min(k, struct_pack(a := CASE WHEN main THEN 0 ELSE 1 END, b := k)) AS node_id FROM {_TITLES} GROUP BY 1")
def meta_main_title(s, d):
    return metadata.main_title(_entries(s, d)).select("book_id", "node_id")


@query(f"SELECT book_id, k AS node_id, CASE WHEN k = arg_min(k, struct_pack(a := CASE WHEN main THEN 0 ELSE 1 END, b := k)) OVER (PARTITION BY book_id) THEN 'main' ELSE coalesce(said, 'unknown') END AS title_kind FROM {_TITLES}")
def meta_title_kind(s, d):
    return metadata.title_kinds(_entries(s, d)).select("book_id", "node_id", "title_kind")


@query(f"SELECT book_id, arg_min(k, struct_pack(a := CASE WHEN event = 'publication' THEN 0 ELSE 1 END, b := k)) AS node_id FROM {_META} WHERE p IN (1, 6) AND (event = 'publication' OR event IS NULL) GROUP BY 1")
def meta_published(s, d):
    return metadata.published(_entries(s, d)).select("book_id", "node_id")


@query(f"SELECT book_id, arg_min(k, struct_pack(a := CASE WHEN p = 5 THEN 0 ELSE 1 END, b := k)) AS node_id FROM {_META} WHERE p = 5 OR p IN (1, 6) AND event = 'modification' GROUP BY 1")
def meta_modified(s, d):
    return metadata.modified(_entries(s, d)).select("book_id", "node_id")


@query(f"SELECT book_id, k AS node_id, coalesce(language, lower(n_name)) AS language, CASE WHEN direction = 'auto' THEN 'ltr' ELSE direction END AS text_direction FROM {_META} JOIN nation ON n_nationkey = book_id")
def meta_language_inherit(s, d):
    package = adapters.read(s, d, "nation").select(F.col("n_nationkey").alias("book_id"), F.lower("n_name").alias("language"), F.lit("ltr").alias("text_direction"))
    return metadata.inherited(_entries(s, d).filter("parent_node_id is null"), package).select("book_id", "node_id", "language", "text_direction")


@query(f"""SELECT m.book_id, m.k AS node_id, CASE WHEN m.k % 8 = 2 THEN 'A:' || m.k ELSE (SELECT arg_min(r.value, r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 3) || ':' || (SELECT arg_min(r.value, r.n) FROM {_REFINING} r WHERE r.k = m.k AND r.p = 4) END AS scheme FROM {_META} m WHERE p = 2""")
def tag_scheme(s, d):
    found = F.when(F.col("scheme").isNotNull(), F.concat_ws(":", "scheme.authority", "scheme.term"))
    return metadata.tag_scheme(_entries(s, d)).select("book_id", "node_id", found.alias("scheme"))


@query(f"SELECT book_id, k AS node_id, CASE WHEN k % 7 <> 1 AND k % 7 < 3 THEN 'T' END AS scheme_source, CASE WHEN k % 7 = 1 THEN 'S' ELSE value END AS scheme_code FROM {_META}")
def meta_entry_scheme(s, d):
    return metadata.scheme(_entries(s, d).filter("parent_node_id is null")).select("book_id", "node_id", "scheme_source", "scheme_code")


@query("SELECT c_nationkey AS book_id, c_custkey AS node_id FROM customer WHERE c_custkey % 9 = 0")
def meta_links(s, d):
    return metadata.links(_entries(s, d)).select("book_id", "node_id")


@query(
    f"""WITH names AS (SELECT k, book_id, CASE p WHEN 6 THEN 1 ELSE p END AS g FROM {_META}), groups AS (SELECT book_id, g, min(k) AS start FROM names GROUP BY 1, 2),
    hits AS (SELECT m.book_id, m.id, m.k AS node_id, g.start, m.k AS root, -1 AS sub, -1 AS n FROM {_META} m JOIN names x USING (k) JOIN groups g ON g.book_id = m.book_id AND g.g = x.g
      UNION ALL SELECT r.book_id, r.id, r.n + 1000000000, g.start, r.k, min(r.n) OVER (PARTITION BY r.book_id, r.p), r.n FROM {_REFINING} r JOIN names x USING (k) JOIN groups g ON g.book_id = x.book_id AND g.g = x.g)
    SELECT book_id, id, arg_min(node_id, struct_pack(a := start, b := root, c := sub, d := n)) AS node_id FROM hits WHERE CAST(substr(id, 4) AS BIGINT) < 90 GROUP BY 1, 2"""
)
def meta_by_id(s, d):
    e = _entries(s, d)
    asked = e.filter(F.substring("id", 4, 20).cast("long") < 90).select("book_id", "id")
    return metadata.by_id(e, asked).select("book_id", "id", "node_id")


@query(f"SELECT book_id, coalesce(min(CASE WHEN ord IN (3, 7) AND book_id % 2 = 0 THEN id END), min(CASE WHEN ord = 5 THEN id END)) AS id FROM {_MANIFEST} GROUP BY 1 HAVING coalesce(min(CASE WHEN ord IN (3, 7) AND book_id % 2 = 0 THEN id END), min(CASE WHEN ord = 5 THEN id END)) IS NOT NULL")
def manifest_cover(s, d):
    m = adapters.manifest(s, d)
    items = m.withColumn("properties", F.when(F.col("ord").isin(3, 7) & (F.col("book_id") % 2 == 0), "svg cover-image").otherwise("svg"))
    metas = m.filter("ord in (4, 5)").select("book_id", F.lit("cover").alias("property"), F.lit(None).cast("long").alias("parent_node_id"), (-F.col("ord")).alias("ord"), "id", F.col("id").alias("value"))
    return manifest.cover(items, metas).select("book_id", "id")


@query(f"SELECT a.book_id, a.id, m.href FROM (SELECT book_id, CASE WHEN ord % 3 = 0 THEN 'no' || id ELSE id END AS id FROM {_MANIFEST}) a LEFT JOIN {_MANIFEST} m ON m.book_id = a.book_id AND m.id = a.id")
def manifest_by_id(s, d):
    m = adapters.manifest(s, d)
    asked = m.select("book_id", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("no"), "id")).otherwise(F.col("id")).alias("id"))
    return manifest.by_id(m, asked).select("book_id", "id", "href")


@query(f"SELECT book_id, id FROM {_MANIFEST} WHERE ord = 4")
def manifest_get(s, d):
    return common.at(adapters.manifest(s, d), 4).select("book_id", "id")


@query(f"SELECT book_id, id FROM {_MANIFEST} WHERE ord % 4 = 1")
def manifest_stylesheets(s, d):
    m = adapters.manifest(s, d)
    named = m.filter("ord % 4 = 1").select("book_id", F.concat("href", F.lit("?v=1")).alias("href"))
    return manifest.stylesheets(m, named.unionByName(named)).select("book_id", "id")


@query(f"SELECT book_id, idref, l_linenumber, l_suppkey, l_extendedprice FROM {_SPINE} WHERE idref % 10 = book_id % 10")
def spine_by_idref(s, d):
    rows = adapters.spine(s, d)
    asked = rows.select("book_id", F.col("idref")).filter(F.col("idref") % 10 == F.col("book_id") % 10)
    return reader.by_idref(rows, asked).select("book_id", "idref", "l_linenumber", "l_suppkey", "l_extendedprice")


@query("SELECT conv_id AS book_id, role AS id, min(turn) AS ord FROM conversations GROUP BY 1, 2")
def spine_by_id(s, d):
    rows = adapters.read(s, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("role").alias("id"), F.col("turn").alias("ord"))
    return reader.by_id(rows, rows.select("book_id", "id")).select("book_id", "id", "ord")


@query(f"SELECT book_id, CAST(bool_and(linear) AS INTEGER) AS all_linear, CAST(bool_and(NOT linear) AS INTEGER) AS all_non_linear FROM {_SPINE} GROUP BY 1")
def spine_linearity(s, d):
    return reader.linearity(adapters.spine(s, d)).select("book_id", F.col("all_linear").cast("int").alias("all_linear"), F.col("all_non_linear").cast("int").alias("all_non_linear"))


@query(f"SELECT book_id, idref, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY book_id ORDER BY n DESC) - 1 AS back FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) AS n FROM {_SPINE})")
def reader_backwards(s, d):
    out = common.backwards(reader.reading_order(adapters.spine(s, d), "original", adapters.SPINE_ORDER), ["book_id"], "position")
    return out.select("book_id", "idref", "l_linenumber", "l_suppkey", F.col("back").cast("long").alias("back"))


@query(f"SELECT c.book_id, c.position, t.idref FROM (SELECT DISTINCT book_id, CAST(CASE WHEN book_id % 3 > 0 THEN book_id % 3 END AS BIGINT) AS position FROM {_TALKS}) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS position FROM {_TALKS}) t ON t.book_id = c.book_id AND t.position = c.position")
def reader_current(s, d):
    order = reader.reading_order(adapters.talks(s, d)).withColumn("position", F.col("position").cast("long"))
    cursors = order.select("book_id").distinct().withColumn("position", F.when(F.col("book_id") % 3 > 0, F.col("book_id") % 3).cast("long"))
    return reader.current(order, cursors).select("book_id", "position", "idref")


@query(f"SELECT book_id, root_ord FROM {_ROOTS} WHERE root_kind = 'landmarks' AND root_version = 3")
def toc_by_kind_version(s, d):
    roots = adapters.read(s, d, "orders").select(F.col("o_custkey").alias("book_id"), F.when(F.col("o_orderpriority").like("%URGENT"), "toc").when(F.col("o_orderpriority").like("%HIGH"), "landmarks").otherwise("lot").alias("root_kind"), (F.col("o_orderkey") % 2 + 2).alias("root_version"), F.col("o_orderkey").alias("root_ord"))
    return toc.by_kind_version(roots, "landmarks", 3).select("book_id", "root_ord")


def _places(nodes):
    return nodes.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("place"), "label")


@query(f"SELECT CASE WHEN path[1] < 2 THEN array_to_string(path, '/') ELSE (path[1] + 2) || CASE WHEN len(path) > 1 THEN '/' || array_to_string(path[2:], '/') ELSE '' END END AS place, label FROM {_TREE} UNION ALL SELECT '2', 'new' UNION ALL SELECT '2/0', 'below' UNION ALL SELECT '3', 'newer'")
def toc_insert(s, d):
    tree = adapters.tree(s, d)
    new = s.createDataFrame([(0, [0], "new"), (0, [0, 0], "below"), (0, [1], "newer")], "book_id long, path array<long>, label string")
    return _places(toc.inserted(tree, F.array().cast("array<bigint>"), 2, new))


@query(f"SELECT CASE WHEN path[1] < 2 THEN array_to_string(path, '/') ELSE (path[1] - 1) || CASE WHEN len(path) > 1 THEN '/' || array_to_string(path[2:], '/') ELSE '' END END AS place, label FROM {_TREE} WHERE path[1] <> 1")
def toc_remove(s, d):
    return _places(toc.removed(adapters.tree(s, d), F.array().cast("array<bigint>"), 1))


@query(f"SELECT array_to_string(path, '/') AS place, label FROM {_TREE} WHERE NOT (len(path) >= 2 AND path[2] % 4 = 1)")
def toc_retain(s, d):
    return _places(toc.retained(adapters.tree(s, d), ~((F.size("path") == 2) & (F.element_at("path", -1) % 4 == 1))))


@query("SELECT p_partkey, p_type AS uri, 1 AS found, p_brand AS changed, CAST(1 AS INTEGER) AS size, 'x' AS added, CAST(3 AS INTEGER) AS longer FROM part")
def prefixes_parse(s, d):
    """Lookups and edits of named pairs, here prefixes."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("uri")) for k, v in (("a", "p_type"), ("b", "p_brand"))])
    rows = adapters.read(s, d, "part").select("p_partkey", "p_brand", pairs.alias("pairs"))
    put, more = text.insert_named(F.col("pairs"), "a", F.col("p_brand"), "uri"), text.insert_named(F.col("pairs"), "c", F.lit("x"), "uri")
    return rows.select("p_partkey", text.named(F.col("pairs"), "a", "uri").alias("uri"), text.has_named(F.col("pairs"), "b").cast("int").alias("found"), text.named(put, "a", "uri").alias("changed"),
                       F.size(text.remove_named(F.col("pairs"), "a")).alias("size"), text.named(more, "c", "uri").alias("added"), F.size(more).alias("longer"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_type) ELSE p_type END AS p_type, CASE WHEN p_size > 25 THEN 'x' ELSE p_brand END AS p_brand FROM part")
def edit_update(s, d):
    return common.updated(adapters.read(s, d, "part").select("p_partkey", "p_type", "p_brand", "p_size"), F.col("p_size") > 25, p_type=F.upper("p_type"), p_brand=F.lit("x")).drop("p_size")


@query("SELECT conv_id AS book_id, -1 AS old_ord, count(*) AS ord FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 FROM conversations")
def edit_push(s, d):
    rows = common.numbered(adapters.talks(s, d).withColumnRenamed("ord", "old_ord"), ["book_id"], [F.col("old_ord")]).select("book_id", "old_ord", F.col("ord").cast("long").alias("ord"))
    new = rows.select("book_id").distinct().select("book_id", F.lit(-1).cast("long").alias("old_ord"), F.lit(0).cast("long").alias("ord"))
    return common.inserted(rows, new, ["book_id"], 1 << 30)


@query(f"SELECT book_id, id AS old, CASE ord WHEN 0 THEN 'fresh' WHEN 1 THEN book_id * 10 || '' ELSE 'twice' END AS new, CASE WHEN ord > 1 AND cnt > 1 OR ord = 1 AND has0 THEN 'duplicate_item_id' END AS error FROM (SELECT *, count(*) FILTER (ord IN (2, 3)) OVER (PARTITION BY book_id) AS cnt, bool_or(ord = 0) OVER (PARTITION BY book_id) AS has0 FROM {_MANIFEST}) WHERE ord < 4")
def edit_set_id_duplicate(s, d):
    m = adapters.manifest(s, d)
    new = F.when(F.col("ord") == 0, "fresh").when(F.col("ord") == 1, (F.col("book_id") * 10).cast("string")).otherwise("twice")
    renames = m.filter("ord < 4").select("book_id", F.col("id").alias("old"), new.alias("new"))
    return edit.try_set_ids(m, m.select("book_id", F.col("id").alias("idref")), renames)[2]


@query("SELECT page_id AS book_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def bytes_copied(s, d):
    rows = adapters.read(s, d, "pages").select(F.col("page_id").alias("book_id"), F.lit("/a%20b").alias("href"), F.lit("/a b").alias("path"), F.col("html").cast("binary").alias("content"))
    return edit.bytes_copied(rows.select("book_id", "href"), rows.select("book_id", "path", "content"))


@query("SELECT page_id AS book_id, md5(replace(replace(html, '<a href=\"/', '<a href=\"/read/'), '</head>', '<style>/*<![CDATA[*/p{}/*]]>*/</style></head>')) AS digest, CAST(octet_length(encode(html)) AS INTEGER) AS size FROM pages")
def manifest_read_rewritten(s, d):
    rows = adapters.read(s, d, "pages").select(F.col("page_id").alias("book_id"), F.lit("/OPS/a%20b.xhtml?q").alias("href"), F.lit("application/xhtml+xml").alias("media_type"), F.lit("/OPS/a b.xhtml").alias("path"), F.col("html").cast("binary").alias("content"))
    out = manifest.read(rows.select("book_id", "href", "media_type"), rows.select("book_id", "path", "content"), "/read/", "p{}")
    return out.select("book_id", F.md5("content").alias("digest"), F.octet_length("bytes").alias("size"))


@query(f"SELECT t.book_id, t.idref, m.href AS resource_path FROM (SELECT book_id, CASE WHEN ord % 2 = 0 THEN id ELSE 'no' END AS idref FROM {_MANIFEST}) t LEFT JOIN {_MANIFEST} m ON m.book_id = t.book_id AND m.id = t.idref")
def resource_of_entry(s, d):
    m = adapters.manifest(s, d)
    return manifest.resources_of(m.select("book_id", F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise("no").alias("idref")), m).select("book_id", "idref", "resource_path")


@query(f"SELECT book_id, href || '#x' AS href, id AS resource_id, media_type AS resource_type FROM {_MANIFEST}")
def resource_of_toc_entry(s, d):
    m = adapters.manifest(s, d)
    return manifest.resources_of(m.select("book_id", F.concat("href", F.lit("#x")).alias("href"), F.lit("n").alias("id")), m, "href").select("book_id", "href", "resource_id", "resource_type")


@query("SELECT event_id, printf('%04d-%02d-%02dT%02d:%02d:%02d+14:00', event_id % 9999, least(greatest(event_id % 15, 1), 12), least(greatest(event_id % 40, 1), 31), least(event_id % 30, 23), least(event_id % 70, 59), least(event_id % 80, 59)) AS shown FROM events")
def civil_new(s, d):
    k = F.col("event_id")
    made = civil.new(civil.new_date(k % 9999, k % 15, k % 40), civil.new_time(k % 30, k % 70, k % 80, F.lit(9999)))
    return adapters.read(s, d, "events").select("event_id", made.alias("t")).select("event_id", civil.show(F.col("t")).alias("shown"))


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, 't' || turn AS id, 0 AS n_spine, 0 AS n_meta FROM conversations")
def epub_skip(s, d):
    """Items of books whose metadata, spine and navigation are not decoded."""
    parsed = epub.parse(books.archives(s, d), skip=("metadata", "spine", "toc"))
    return parsed.select("book_id", F.explode("manifest").alias("i"), F.size("spine").alias("n_spine"), F.size("meta").alias("n_meta")).select("book_id", "i.id", "n_spine", "n_meta")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS book_id, 'missing_language' AS code FROM conversations")
def epub_strict_errors(s, d):
    return epub.parse(books.archives(s, d), strict=True).select("book_id", F.col("error.code").alias("code"))


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, 't' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, md5(text) AS digest FROM conversations")
def epub_round_trip(s, d):
    """Books read, written and read again: reading order and what it reads."""
    again = epub.corpus(sink.write(epub.corpus(books.archives(s, d)), now="2024-01-02T03:04:05Z"))
    out = reader.content(reader.reading_order(again.spine), again.manifest, again.resources)
    return out.select("book_id", "idref", F.col("ord").cast("long").alias("ord"), F.md5("bytes").alias("digest"))


_PREFIXED = "SELECT page_id, md5(replace(html, '<a href=\"/', '<a href=\"/read/')) AS digest FROM pages"


@query(_PREFIXED)
def rewrite_prefix(s, d):
    """Every path in the driver's pages is that of an a and begins with the root."""
    return adapters.read(s, d, "pages").select("page_id", F.md5(rewrite.rewritten(F.col("html"), F.lit("/OPS/x.xhtml"), prefix="/read/")).alias("digest"))
