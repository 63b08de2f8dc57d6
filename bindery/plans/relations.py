"""Queries of the operators over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import href
from ..operators import common, edit, manifest, metadata, reader, rewrite, toc
from . import adapters
from .registry import query

_SPINE = "(SELECT l_orderkey AS book_id, l_linenumber, l_partkey AS idref, l_suppkey, l_extendedprice, l_linestatus = 'O' AS linear, l_shipdate FROM lineitem)"
_ORDER = "l_linenumber, idref, l_suppkey, l_extendedprice, l_shipdate"
_TALKS = "(SELECT conv_id AS book_id, turn AS ord, role || '-' || turn AS idref, role <> 'system' AS linear FROM conversations)"
_MANIFEST = """(SELECT p_partkey // 10 AS book_id, p_partkey % 10 AS ord, CAST(p_partkey AS VARCHAR) AS id, '/' || lower(split_part(p_name, ' ', 1)) || '/' || p_partkey || '.xhtml' AS href,
  lower(p_type) || '/' || lower(p_brand) AS media_type, CAST(p_partkey // 10 * 10 + p_partkey % 10 * 3 % 10 AS VARCHAR) AS fallback,
  CAST(p_partkey // 10 * 10 + p_partkey % 10 * 7 % 10 AS VARCHAR) AS media_overlay, lower(p_name) AS properties FROM part)"""
_ENTRIES = "(SELECT lang AS book_id, source AS property, d.doc_id AS natural_order, quality AS display_seq, toxic, n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"
_TREE = """(SELECT [CAST(r_regionkey AS BIGINT)] AS path, r_name AS label FROM region UNION ALL SELECT [CAST(n_regionkey AS BIGINT), n_nationkey], n_name FROM nation
  UNION ALL SELECT [CAST(n_regionkey AS BIGINT), n_nationkey, c_custkey], c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _reading(behaviour: str) -> None:
    where = {"linear_only": "WHERE linear", "non_linear_only": "WHERE NOT linear"}.get(behaviour, "")
    rank = {"prepend_non_linear": "CAST(linear AS INTEGER), ", "append_non_linear": "-CAST(linear AS INTEGER), "}.get(behaviour, "")
    query(
        f"SELECT book_id, idref, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY book_id ORDER BY {rank}{_ORDER}) - 1 AS position FROM {_SPINE} {where}", f"reader_{behaviour}"
    )(lambda s, d: reader.reading_order(adapters.spine(s, d), behaviour, adapters.SPINE_ORDER).select("book_id", "idref", "l_linenumber", "l_suppkey", F.col("position").cast("long").alias("position")))


for _b in reader.BEHAVIOURS:
    _reading(_b)

_CURSOR = f"""SELECT book_id, idref, position, lead(idref) OVER w AS next_key, lag(idref) OVER w AS prev_key, count(*) OVER (PARTITION BY book_id) AS n, count(*) OVER (PARTITION BY book_id) - position - 1 AS remaining
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY -CAST(linear AS INTEGER), ord) - 1 AS position FROM {_TALKS}) WINDOW w AS (PARTITION BY book_id ORDER BY position)"""


@query(_CURSOR)
def reader_cursor(s, d):
    out = reader.cursor(reader.reading_order(adapters.talks(s, d), "append_non_linear"))
    return out.select("book_id", "idref", F.col("position").cast("long").alias("position"), "next_key", "prev_key", "n", "remaining")


@query("SELECT c.conv_id AS book_id, 'user-' || c.c AS idref, p.position, CASE WHEN p.position IS NULL THEN 'no_mapping' END AS error FROM (SELECT DISTINCT conv_id, 1 AS c FROM conversations) c LEFT JOIN (SELECT conv_id, role || '-' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations) p ON p.conv_id = c.conv_id AND p.idref = 'user-' || c.c")
def reader_seek_idref(s, d):
    order = reader.reading_order(adapters.talks(s, d))
    asked = adapters.talks(s, d).select("book_id").distinct().withColumn("idref", F.lit("user-1"))
    return reader.seek(order, asked).select("book_id", "idref", F.col("position").cast("long").alias("position"), "error")


@query("SELECT c.conv_id AS book_id, CAST(3 AS BIGINT) AS position, p.idref, CASE WHEN p.idref IS NULL THEN 'out_of_bounds' END AS error FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, role || '-' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations) p ON p.conv_id = c.conv_id AND p.position = 3")
def reader_seek_position(s, d):
    order = reader.reading_order(adapters.talks(s, d)).withColumn("position", F.col("position").cast("long"))
    asked = adapters.talks(s, d).select("book_id").distinct().withColumn("position", F.lit(3).cast("long"))
    return reader.seek(order, asked.withColumnRenamed("idref", "x")).select("book_id", "position", "idref", "error")


@query("SELECT o_orderkey AS book_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def reader_len(s, d):
    return common.counted(adapters.read(s, d, "orders").select(F.col("o_orderkey").alias("book_id")), adapters.spine(s, d), "book_id")


@query("SELECT l_orderkey AS book_id, l_linenumber, l_partkey AS idref, p_name AS href, CASE WHEN p_name IS NULL THEN 'invalid_idref' END AS error FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey")
def spine_manifest_join(s, d):
    lines = adapters.spine(s, d)
    parts = adapters.read(s, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("idref"), F.col("p_name").alias("href"), F.col("p_type").alias("media_type"))
    items = lines.select("book_id", "idref").distinct().join(parts, "idref").withColumnRenamed("idref", "id")
    return reader.with_items(lines, items).select("book_id", "l_linenumber", "idref", "href", "error")


@query("SELECT l_orderkey AS book_id, l_partkey AS idref, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def cleanup_spine(s, d):
    lines = adapters.spine(s, d)
    parts = adapters.read(s, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("idref"), F.col("p_name").alias("href"))
    items = lines.select("book_id", "idref").distinct().join(parts, "idref").select("book_id", F.col("idref").alias("id"), "href", F.col("href").alias("href_raw"), F.lit(None).cast("long").alias("fallback"), F.lit(None).cast("long").alias("media_overlay"))
    nodes = lines.select("book_id", F.lit(0).alias("root_ord"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("href")).distinct()
    return edit.cleaned(items, lines, nodes)[1].select("book_id", "idref", "l_linenumber")


@query(f"SELECT m.book_id, m.id, CASE WHEN f.id <> m.id THEN f.id END AS fallback_id FROM {_MANIFEST} m LEFT JOIN {_MANIFEST} f ON f.book_id = m.book_id AND f.id = m.fallback")
def fallback_one(s, d):
    return manifest.fallback(adapters.manifest(s, d)).select("book_id", "id", "fallback_id")


@query(f"SELECT m.book_id, m.id, CASE WHEN f.id <> m.id THEN f.id END AS media_overlay_id FROM {_MANIFEST} m LEFT JOIN {_MANIFEST} f ON f.book_id = m.book_id AND f.id = m.media_overlay")
def media_overlay(s, d):
    return manifest.fallback(adapters.manifest(s, d), "media_overlay").select("book_id", "id", "media_overlay_id")


@query(
    f"""WITH RECURSIVE m AS (SELECT book_id, id, fallback FROM {_MANIFEST}), walk AS (
      SELECT x.book_id, x.id, CAST(1 AS BIGINT) AS step, y.id AS fallback_id, [x.id, y.id] AS seen FROM m x JOIN m y ON x.book_id = y.book_id AND x.fallback = y.id WHERE x.id <> y.id
      UNION ALL SELECT w.book_id, w.id, w.step + 1, n.id, list_append(w.seen, n.id) FROM walk w JOIN m x ON x.book_id = w.book_id AND x.id = w.fallback_id JOIN m n ON n.book_id = x.book_id AND n.id = x.fallback WHERE NOT list_contains(w.seen, n.id))
    SELECT book_id, id, step, fallback_id FROM walk"""
)
def fallback_chain(s, d):
    return manifest.fallback_chain(adapters.manifest(s, d)).withColumn("step", F.col("step").cast("long"))


@query(f"SELECT m.book_id, m.id, f.id AS fallback, o.id AS media_overlay FROM {_MANIFEST} m LEFT JOIN {_MANIFEST} f ON f.book_id = m.book_id AND f.id = m.fallback LEFT JOIN {_MANIFEST} o ON o.book_id = m.book_id AND o.id = m.media_overlay")
def cleanup_refs(s, d):
    return manifest.dangling_cleared(adapters.manifest(s, d)).select("book_id", "id", "fallback", "media_overlay")


@query(f"SELECT book_id, id FROM {_MANIFEST} WHERE split_part(media_type, '/', 1) IN ('promo', 'small') OR media_type = 'large/brand#11'")
def manifest_by_kind(s, d):
    return manifest.by_kind(adapters.manifest(s, d), ["PROMO", "small/", "Large/Brand#11"]).select("book_id", "id")


@query(f"SELECT book_id, id FROM {_MANIFEST} WHERE list_contains(string_split(properties, ' '), 'widget')")
def manifest_by_property(s, d):
    return manifest.by_property(adapters.manifest(s, d), "widget").select("book_id", "id")


@query(f"SELECT book_id, href || '?x#y' AS href, id FROM {_MANIFEST}")
def manifest_by_href(s, d):
    m = adapters.manifest(s, d)
    return manifest.by_href(m, m.select("book_id", F.concat("href", F.lit("?x#y")).alias("href"))).select("book_id", "href", "id")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def manifest_len_by_type(s, d):
    return adapters.read(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'images' WHEN 1 THEN 'scripts' WHEN 2 THEN 'styles' WHEN 3 THEN 'fonts' WHEN 4 THEN 'audio' WHEN 5 THEN 'video' WHEN 6 THEN 'readable' ELSE 'other' END AS media_set FROM part")
def manifest_media_sets(s, d):
    kinds = ("image/PNG", "text/JavaScript", "text/css", "application/font-woff", "AUDIO/mpeg", "video/mp4", "application/xhtml+xml", "text/css; a=b")
    m = adapters.read(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("media_type"))
    return manifest.media_sets(m).select("p_partkey", "media_set")


@query(
    """SELECT l_orderkey AS book_id, l_linenumber, ord, idref FROM (SELECT l_orderkey, l_linenumber, min(n) OVER (PARTITION BY l_orderkey, l_linenumber) AS ord, l_partkey AS idref, n, max(n) OVER (PARTITION BY l_orderkey, l_linenumber) AS last FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem)) WHERE n = last"""
)
def manifest_dedupe(s, d):
    rows = common.numbered(adapters.spine(s, d), ["book_id"], [F.col(c) for c in adapters.SPINE_ORDER])
    out = common.upserted(rows.select("book_id", "l_linenumber", "ord", "idref"), ["book_id", "l_linenumber"], "ord")
    return out.select("book_id", "l_linenumber", F.col("ord").cast("long").alias("ord"), "idref")


@query(f"SELECT book_id, property, natural_order, dense_rank() OVER (PARTITION BY book_id ORDER BY start) - 1 AS group_ord, row_number() OVER (PARTITION BY book_id, property ORDER BY display_seq NULLS LAST, natural_order) - 1 AS ord FROM (SELECT *, min(natural_order) OVER (PARTITION BY book_id, property) AS start FROM {_ENTRIES})")
def meta_group_order(s, d):
    return metadata.ordered(adapters.entries(s, d)).select("book_id", "property", "natural_order", F.col("group_ord").cast("long").alias("group_ord"), F.col("ord").cast("long").alias("ord"))


@query(f"SELECT book_id, natural_order FROM {_ENTRIES} WHERE property = 'src3'")
def meta_by_property(s, d):
    return metadata.by_property(adapters.entries(s, d), "src3").select("book_id", "natural_order")


@query(f"SELECT book_id, property, natural_order FROM (SELECT *, row_number() OVER (PARTITION BY book_id, property ORDER BY CASE WHEN toxic = 1 THEN 0 ELSE 1 END, display_seq NULLS LAST, natural_order) AS n FROM {_ENTRIES}) WHERE n = 1")
def meta_first_by_priority(s, d):
    e = adapters.entries(s, d).withColumn("_rank", F.when(F.col("toxic") == 1, 0).otherwise(1))
    order = [F.col("_rank"), F.coalesce("display_seq", F.lit(9223372036854775807)), F.col("natural_order")]
    return common.first_of(e, ["book_id", "property"], order).select("book_id", "property", "natural_order")


@query(
    """WITH RECURSIVE reached AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(0 AS BIGINT) AS depth, CAST(n_nationkey AS BIGINT) AS root FROM nation WHERE n_nationkey % 6 = 0
      UNION ALL SELECT n_nationkey, depth + 1, root FROM reached JOIN nation ON n_nationkey % 6 <> 0 AND n_nationkey - 1 = k) SELECT k, depth, root FROM reached"""
)
def refinement_tree(s, d):
    links = adapters.read(s, d, "nation").select(F.lit(0).alias("book_id"), F.col("n_nationkey").cast("long").alias("k"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey").cast("long") - 1).alias("p"))
    return metadata.tree(links, "k", "p").select("k", F.col("depth").cast("long").alias("depth"), "root")


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 10 NOT IN (1, 2, 3)")
def refinement_cycle(s, d):
    """Parts that a root reaches: in each ten, 1 to 3 refine one another."""
    k = F.col("p_partkey")
    parent = F.when(k % 10 == 1, k + 2).when(k % 10 == 2, k - 1).when(k % 10 == 3, k - 1)
    links = adapters.read(s, d, "part").select(F.lit(0).alias("book_id"), k.alias("k"), parent.alias("p"))
    return metadata.tree(links, "k", "p").select("k")


@query(f"SELECT array_to_string(path, '/') AS place, label, len(path) AS depth FROM {_TREE}")
def toc_flatten(s, d):
    return toc.flattened(adapters.tree(s, d)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("place"), "label", F.size("path").cast("long").alias("depth"))


@query(f"SELECT label FROM {_TREE} WHERE len(path) = 2 AND path[1] = 2")
def toc_children(s, d):
    return toc.children(adapters.tree(s, d), F.array(F.lit(2).cast("long"))).select("label")


@query(
    f"""WITH t AS {_TREE}, seen AS (SELECT [] AS top, len(path) AS n FROM t UNION ALL SELECT path[:1], len(path) FROM t UNION ALL SELECT path[:2], len(path) FROM t WHERE len(path) >= 2 UNION ALL SELECT path, len(path) FROM t WHERE len(path) >= 3)
    SELECT array_to_string(top, '/') AS place, count(*) - CASE WHEN len(top) = 0 THEN 0 ELSE 1 END AS total_len, max(n) - len(top) AS max_depth FROM seen GROUP BY top"""
)
def toc_sizes(s, d):
    tree = adapters.tree(s, d)
    root = s.createDataFrame([(0, 0, [], "root")], "book_id long, root_ord long, path array<long>, label string")
    out = toc.sizes(tree.unionByName(root))
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("place"), "total_len", F.col("max_depth").cast("long").alias("max_depth"))


_ROOTS = "(SELECT o_custkey AS book_id, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'toc' WHEN o_orderpriority LIKE '%HIGH' THEN 'landmarks' ELSE 'lot' END AS root_kind, CAST(2 + o_orderkey % 2 AS BIGINT) AS root_version, o_orderkey AS root_ord FROM orders)"


def _roots(s, d):
    p = F.col("o_orderpriority")
    kind = F.when(p.like("%URGENT"), "toc").when(p.like("%HIGH"), "landmarks").otherwise("lot")
    return adapters.read(s, d, "orders").select(F.col("o_custkey").alias("book_id"), kind.alias("root_kind"), (F.col("o_orderkey") % 2 + 2).alias("root_version"), F.col("o_orderkey").alias("root_ord"))


@query(f"SELECT book_id, root_version, root_ord FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE root_version WHEN 3 THEN 1 ELSE 2 END, root_ord) AS n FROM {_ROOTS} WHERE root_kind = 'toc') WHERE n = 1")
def toc_by_kind_preferred(s, d):
    return toc.chosen(_roots(s, d), "toc", 3).select("book_id", "root_version", "root_ord")


@query(f"SELECT book_id, root_version, root_ord FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY root_version, root_ord) AS n FROM {_ROOTS} WHERE root_kind = 'lot') WHERE n = 1")
def toc_by_kind_other(s, d):
    return toc.chosen(_roots(s, d), "lot", 3).select("book_id", "root_version", "root_ord")


@query(f"SELECT book_id, root_kind, root_version, max(root_ord) AS root_ord FROM {_ROOTS} GROUP BY 1, 2, 3")
def toc_merge(s, d):
    rows = _roots(s, d)
    return toc.merged(rows.filter("root_version = 2"), rows.filter("root_version = 3")).select("book_id", "root_kind", "root_version", "root_ord")


@query(f"SELECT book_id, root_kind, root_version, root_ord FROM {_ROOTS} r WHERE NOT (root_kind = 'landmarks' AND root_version = 2 AND book_id IN (SELECT book_id FROM {_ROOTS} WHERE root_kind = 'landmarks' AND root_version = 3))")
def toc_drop_redundant_guide(s, d):
    return toc.without_redundant_guide(_roots(s, d)).select("book_id", "root_kind", "root_version", "root_ord")


@query(f"SELECT array_to_string(path, '/') AS place FROM {_TREE} WHERE NOT (len(path) >= 2 AND path[2] % 3 = 0) AND NOT (len(path) = 3 AND path[3] % 5 = 0)")
def cleanup_toc(s, d):
    last = F.element_at("path", -1)
    bad = ((F.size("path") == 2) & (last % 3 == 0)) | ((F.size("path") == 3) & (last % 5 == 0))
    nodes = adapters.tree(s, d).withColumn("href", F.when(F.size("path") == 1, None).when(bad, F.lit("gone#x")).otherwise(F.lit("here#x")))
    items = s.createDataFrame([(0, "here", "raw")], "book_id long, href string, href_raw string")
    return toc.cleaned(nodes, items).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("place"))


@query("SELECT page_id, 'u' || page_id AS path FROM pages WHERE page_id % 3 = 0 AND page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0)")
def orphans(s, d):
    pages = adapters.read(s, d, "pages")
    base = pages.select(F.lit(0).alias("book_id"), F.concat(F.when(F.col("page_id") % 3 == 0, "u").otherwise("v"), F.col("page_id").cast("string")).alias("path"), "page_id")
    items = pages.filter("page_id % 2 = 0").select(F.lit(0).alias("book_id"), F.concat(F.when(F.col("page_id") % 3 == 0, "u").otherwise("v"), F.col("page_id").cast("string")).alias("href"))
    return manifest.orphans(base, items, "u").select("page_id", "path")


@query("SELECT CASE page_id % 3 WHEN 1 THEN 'moved' || page_id ELSE 'p' || page_id END AS path, CASE page_id % 3 WHEN 2 THEN 'new' ELSE md5(html) END AS content FROM pages")
def overlay_merge(s, d):
    pages = adapters.read(s, d, "pages")
    own = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    base = pages.select(F.lit(0).alias("book_id"), own.alias("path"), F.md5("html").alias("content"))
    k = F.col("page_id") % 3
    over = pages.filter(k != 0).select(F.lit(0).alias("book_id"), F.when(k == 1, F.concat(F.lit("moved"), F.col("page_id").cast("string"))).otherwise(own).alias("path"), F.when(k == 2, "new").alias("content"), F.when(k == 1, own).alias("moved_from"))
    return manifest.overlaid(base, over).select("path", "content")


@query("SELECT conv_id AS book_id, role AS id, turn AS ord, CASE WHEN n = 0 THEN role ELSE role || '-' || n END AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n FROM conversations)")
def unique_ids(s, d):
    rows = adapters.read(s, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.col("role").alias("id"))
    taken = rows.select("book_id").distinct().withColumn("id", F.lit("user"))
    return edit.unique_ids(rows, taken).select("book_id", "id", "ord", "new_id")


@query("SELECT p_type, max(CAST(substr(p_brand, 7) AS BIGINT)) AS top FROM part GROUP BY 1")
def id_max_suffix(s, d):
    return common.max_suffix(adapters.read(s, d, "part"), ["p_type"], "p_brand", "Brand#")


@query("SELECT conv_id AS book_id, turn AS old_ord, CASE WHEN r >= 2 THEN r + 1 ELSE r END AS ord FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) UNION ALL SELECT conv_id, -1, least(2, count(*)) FROM conversations GROUP BY 1")
def edit_insert_clamped(s, d):
    rows = common.numbered(adapters.talks(s, d).withColumnRenamed("ord", "old_ord"), ["book_id"], [F.col("old_ord")]).select("book_id", "old_ord", F.col("ord").cast("long").alias("ord"))
    new = rows.select("book_id").distinct().select("book_id", F.lit(-1).cast("long").alias("old_ord"), F.lit(0).cast("long").alias("ord"))
    return common.inserted(rows, new, ["book_id"], 2)


@query("SELECT conv_id AS book_id, role || '-' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations WHERE role <> 'assistant'")
def edit_retain(s, d):
    out = common.retained(adapters.talks(s, d), ~F.startswith("idref", F.lit("assistant")), ["book_id"])
    return out.select("book_id", "idref", F.col("ord").cast("long").alias("ord"))


@query(f"SELECT book_id, 'x' || id AS id, CASE WHEN f IN (SELECT id FROM {_MANIFEST}) THEN 'x' || f ELSE f END AS fallback FROM (SELECT book_id, id, fallback AS f FROM {_MANIFEST})")
def edit_set_id_cascade(s, d):
    m = adapters.manifest(s, d)
    renames = m.select("book_id", F.col("id").alias("old"), F.concat(F.lit("x"), "id").alias("new"))
    items, _ = edit.set_ids(m, m.select("book_id", F.col("id").alias("idref")), renames)
    return items.select("book_id", "id", "fallback")


@query(f"SELECT book_id, '/new' || href || '?q#f' AS href, id FROM {_MANIFEST}")
def edit_set_href_cascade(s, d):
    m = adapters.manifest(s, d)
    nodes = m.select("book_id", F.concat("href", F.lit("?q#f")).alias("href"), "id")
    renames = m.select("book_id", F.col("href").alias("old"), F.concat(F.lit("/new"), "href").alias("new"))
    return edit.set_hrefs(m, nodes, renames)[1].select("book_id", "href", "id")


@query("SELECT page_id, md5(replace(html, '</head>', '<style>/*<![CDATA[*/p{}/*]]>*/</style></head>')) AS digest FROM pages")
def rewrite_css(s, d):
    return adapters.read(s, d, "pages").select("page_id", F.md5(rewrite.rewritten(F.col("html"), F.col("url"), css="p{}")).alias("digest"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def rewrite_noop(s, d):
    return adapters.read(s, d, "pages").select("page_id", F.md5(rewrite.rewritten(F.col("html"), F.col("url"))).alias("digest"))


@query("SELECT page_id, ord - 1 AS ord, href FROM (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS ord FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hs FROM pages))")
def page_links(s, d):
    return adapters.links(s, d).select("page_id", F.col("ord").cast("long").alias("ord"), "href")


@query("SELECT page_id, CASE WHEN starts_with(href, '/') OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE '/dir/' || href END AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def link_targets(s, d):
    return adapters.links(s, d).select("page_id", href.resolve(F.lit("/dir"), F.col("href")).alias("target"))
