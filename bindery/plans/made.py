"""Queries of books that are made: chapters over tables, unique names, references from below, logs of edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chapters, edit, fingerprint, log, metadata
from ..sources import epub, sink
from . import adapters
from .registry import query
from .relations import _MANIFEST, _TREE

#: Customers are books; their orders are chapters, without content but for every third, and lines are the chapters below, the third one untitled.
_CHAPTERS = """(SELECT o_custkey AS book_id, [CAST(k AS BIGINT)] AS path, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS title, CAST(NULL AS VARCHAR) AS href, CASE WHEN o_orderstatus = 'F' THEN 'part' END AS kind, o_orderkey % 3 = 0 AS has_content, true AS linear
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
  UNION ALL SELECT o_custkey, [CAST(k AS BIGINT), j], CASE WHEN j <> 2 THEN ['MAIL', 'AIR', 'REG AIR', 'SHIP'][1 + l_suppkey % 4] END, CASE WHEN j = 1 THEN 'text/' || o_orderkey || ' b.xhtml' END, CASE WHEN l_returnflag = 'R' THEN 'bodymatter' END, true, l_linestatus = 'O'
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
    JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS j FROM lineitem) ON l_orderkey = o_orderkey)"""
#: Every second book has two items already.
_TAKEN = "(SELECT DISTINCT o_custkey AS book_id, unnest(['mail-1', 'air']) AS id FROM orders WHERE o_custkey % 2 = 0)"
_ITEMS = f"""(SELECT book_id, ord, path, title, href, kind, linear, CASE WHEN number = 0 THEN base ELSE base || '-' || number END AS id FROM (
  SELECT *, k + CASE WHEN book_id % 2 = 1 THEN 0 WHEN base = 'air' THEN 1 WHEN base = 'mail' AND k > 0 THEN 1 ELSE 0 END AS number FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY ord) - 1 AS k FROM (
      SELECT *, CASE WHEN title IS NOT NULL THEN CASE WHEN title SIMILAR TO '[0-9].*' THEN '_' ELSE '' END || replace(lower(title), ' ', '-') WHEN href IS NOT NULL THEN 'never' ELSE 'entry' END AS base
      FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY path) - 1 AS ord FROM {_CHAPTERS}) WHERE has_content))))"""
_HREF = "CASE WHEN href IS NOT NULL THEN replace(href, ' ', '%20') WHEN book_id % 2 = 0 AND id = 'mail' THEN 'mail1.xhtml' ELSE id || '.xhtml' END"


def _chapters(s, d):
    orders, lines = adapters.read(s, d, "orders"), adapters.spine(s, d)
    k = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    orders = orders.select("o_orderkey", F.col("o_custkey").alias("book_id"), "o_orderpriority", "o_orderstatus", k.alias("k"))
    tops = orders.select("book_id", F.array("k").alias("path"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("title"), F.lit(None).cast("string").alias("href"), F.when(F.col("o_orderstatus") == "F", "part").alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("has_content"), F.lit(True).alias("linear"))
    j = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1).cast("long")
    lines = adapters.read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), j.alias("j"), F.get(F.array(*map(F.lit, ("MAIL", "AIR", "REG AIR", "SHIP"))), (F.col("l_suppkey") % 4).cast("int")).alias("l_shipmode"), "l_returnflag", (F.col("l_linestatus") == "O").alias("linear"))
    href = F.when(F.col("j") == 1, F.concat(F.lit("text/"), F.col("o_orderkey").cast("string"), F.lit(" b.xhtml")))
    below = lines.join(orders, "o_orderkey").select("book_id", F.array("k", "j").alias("path"), F.when(F.col("j") != 2, F.col("l_shipmode")).alias("title"), href.alias("href"), F.when(F.col("l_returnflag") == "R", "bodymatter").alias("kind"), F.lit(True).alias("has_content"), "linear")
    taken = orders.filter("book_id % 2 = 0").select("book_id").distinct().select("book_id", F.explode(F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("href")) for a, b in (("mail-1", "/OEBPS/mail.xhtml"), ("air", "/OEBPS/x.css"))])).alias("i")).select("book_id", "i.*")
    return chapters.expanded(tops.unionByName(below), taken)


_LISTED = f"""SELECT c.book_id, array_to_string(c.path, '/') AS place, c.title AS label, CASE WHEN i.id IS NOT NULL THEN '/OEBPS/' || {_HREF.replace("href", "i.href").replace("book_id", "c.book_id")} END AS target
    FROM {_CHAPTERS} c LEFT JOIN {_ITEMS} i ON i.book_id = c.book_id AND i.path = c.path LEFT JOIN {_CHAPTERS} p ON p.book_id = c.book_id AND p.path = c.path[1:1] WHERE c.title IS NOT NULL AND p.title IS NOT NULL"""
_PLACE = "CAST(row_number() OVER (PARTITION BY book_id ORDER BY {}) - 1 AS VARCHAR) AS place"


@query(
    f"""SELECT 'manifest' AS part, book_id, {_PLACE.format("ord")}, id AS label, '/OEBPS/' || {_HREF} AS target FROM {_ITEMS}
    UNION ALL SELECT 'raw', book_id, {_PLACE.format("ord")}, id, {_HREF} FROM {_ITEMS}
    UNION ALL SELECT 'spine', book_id, {_PLACE.format("ord")}, id, CAST(linear AS VARCHAR) FROM {_ITEMS}
    UNION ALL SELECT 'toc', * FROM ({_LISTED})
    UNION ALL SELECT 'landmarks', book_id, {_PLACE.format("path")}, title, kind FROM {_CHAPTERS} WHERE title IS NOT NULL AND kind IS NOT NULL"""
)
def chapters_expanded(s, d):
    """All four tables of the books that orders and lines make."""
    out = _chapters(s, d)
    part = lambda name, df, place, label, target: df.select(F.lit(name).alias("part"), "book_id", place.cast("string").alias("place"), F.col(label).alias("label"), F.col(target).cast("string").alias("target"))
    toc = part("toc", out.toc, F.array_join(F.transform("path", lambda x: x.cast("string")), "/"), "label", "href")
    rows = part("manifest", out.manifest, F.col("ord"), "id", "href").unionByName(part("raw", out.manifest, F.col("ord"), "id", "href_raw"))
    return rows.unionByName(part("spine", out.spine, F.col("ord"), "idref", "linear")).unionByName(toc).unionByName(part("landmarks", out.landmarks, F.col("place"), "label", "kind"))


@query("""SELECT book_id, name, ord, CASE WHEN number = 0 THEN name ELSE stem || number || '.xhtml' END AS new_name FROM (SELECT *, CASE WHEN stem = 'user' THEN CASE WHEN k = 0 THEN 1 ELSE k + 2 END ELSE k END AS number FROM (
    SELECT conv_id AS book_id, role AS stem, role || '.xhtml' AS name, turn AS ord, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k FROM conversations))""")
def unique_hrefs(s, d):
    """``user.xhtml`` and ``user2.xhtml`` are taken in every book."""
    rows = adapters.read(s, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.concat("role", F.lit(".xhtml")).alias("href"))
    taken = rows.select("book_id").distinct().withColumn("href", F.explode(F.array(F.lit("user.xhtml"), F.lit("user2.xhtml"))))
    return edit.unique_hrefs(rows, taken).select("book_id", F.col("href").alias("name"), "ord", F.col("new_href").alias("new_name"))


@query("""WITH w AS (SELECT conv_id AS book_id, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
    SELECT book_id, ord, CASE k % 2 WHEN 0 THEN 'a' ELSE 'a-1' END AS name, CASE WHEN k = 0 THEN 'a' WHEN k = 1 THEN 'a-1' WHEN k % 2 = 0 THEN 'a-' || (k // 2 + 1) ELSE 'a-1-' || (k // 2) END AS new_name FROM w""")
def unique_ids_chain(s, d):
    """Names that are another's numbered form, taken in turn."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = adapters.read(s, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.when(k % 2 == 0, "a").otherwise("a-1").alias("id"))
    return edit.unique_ids(rows, rows.limit(0).select("book_id", "id")).select("book_id", "ord", F.col("id").alias("name"), F.col("new_id").alias("new_name"))


@query(f"""WITH t AS (SELECT path, CASE WHEN len(path) = 3 AND path[3] % 3 = 0 THEN label END AS href FROM {_TREE})
    SELECT array_to_string(t.path, '/') AS place, coalesce(t.href, (SELECT arg_min(u.href, u.path) FROM t u WHERE u.href IS NOT NULL AND len(u.path) > len(t.path) AND u.path[1:len(t.path)] = t.path)) AS target FROM t""")
def toc_first_reference(s, d):
    nodes = adapters.tree(s, d).withColumn("href", F.when((F.size("path") == 3) & (F.element_at("path", -1) % 3 == 0), F.col("label")))
    return chapters.with_first_reference(nodes).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("place"), "target")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS book_id, n_name AS title, count(*) AS n_chapters FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")
def epub_built(s, d):
    """Books made by tables: a nation is a book, its suppliers are chapters; written and read again."""
    nations, suppliers = adapters.read(s, d, "nation"), adapters.read(s, d, "supplier")
    book = F.col("s_nationkey").cast("string").alias("book_id")
    place = (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("int")
    rows = suppliers.select(book, F.array(place).alias("path"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("href"), F.lit("bodymatter").alias("kind"), F.lit(True).alias("has_content"), F.lit(True).alias("linear"))
    names = suppliers.select(book).distinct().join(nations.select(F.col("n_nationkey").cast("string").alias("book_id"), "n_name"), "book_id")
    again = epub.corpus(sink.write(epub.made(chapters.expanded(rows), names.withColumnRenamed("n_name", "title"), F.lit(b"<p/>")), now="2024-01-02T03:04:05Z"))
    title = metadata.main_title(metadata.ordered(again.meta)).select("book_id", F.col("value").alias("title"))
    return title.join(again.toc.filter("size(path) = 1 and root_version = 3 and root_kind = 'toc'").groupBy("book_id").agg(F.count("*").alias("n_chapters")), "book_id")


@query(
    """WITH b AS (SELECT conv_id, list('t' || turn ORDER BY turn) AS ids FROM conversations GROUP BY 1), b1 AS (SELECT *, ids[2:] AS l FROM b), b2 AS (SELECT conv_id, ids, l[1:1] || ['new'] || l[2:] AS l FROM b1),
    b3 AS (SELECT conv_id, ids, CASE WHEN len(ids) > 1 THEN [ids[-1]] || list_filter(l, lambda x: x <> ids[-1]) ELSE l END || ['end'] AS l FROM b2), rows AS (SELECT conv_id, unnest(l) AS id, generate_subscripts(l, 1) - 1 AS ord FROM b3)
    SELECT r.conv_id AS book_id, r.id, r.ord, CASE r.id WHEN 'new' THEN 'y' ELSE c.role END AS role FROM rows r LEFT JOIN conversations c ON c.conv_id = r.conv_id AND 't' || c.turn = r.id"""
)
def edit_log(s, d):
    """The first turn goes, a new one comes to the second place, the last one to the first, values are set, one more comes at the end."""
    talks = adapters.read(s, d, "conversations")
    entries = talks.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.col("turn").cast("long").alias("ord"), "role")
    ends = entries.groupBy("book_id").agg(F.min_by("id", "ord").alias("first"), F.max_by("id", "ord").alias("last"))
    op = lambda seq, name, key, at=None, role=None: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("op"), key.alias("id"), F.lit(at).cast("long").alias("at"), F.lit(role).cast("string").alias("role"))
    ops = (op(1, "remove", F.col("first")), op(2, "insert", F.lit("new"), 1, "x"), op(3, "move", F.col("last"), 0), op(4, "set", F.lit("new"), None, "y"), op(5, "insert", F.lit("end")), op(6, "remove", F.lit("never")))
    return log.edited(entries, ends.select("book_id", F.explode(F.array(*ops)).alias("o")).select("book_id", "o.*"))


@query("SELECT page_id AS book_id, '/c' AS path, md5(html) AS digest FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, '/b', md5('new' || page_id) FROM pages UNION ALL SELECT page_id, '/kept', md5(url) FROM pages")
def overlay_log(s, d):
    """A chain of moves, over a file that is there, new content where it went through, and removals."""
    pages = adapters.read(s, d, "pages")
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.cast("binary").alias("content"))
    base = pages.select(F.col("page_id").alias("book_id"), F.explode(F.array_compact(F.array(file("/a", F.col("html")), F.when(F.col("page_id") % 2 == 0, file("/b", F.lit("old"))), file("/kept", F.col("url"))))).alias("f")).select("book_id", "f.*")
    op = lambda seq, name, path, to=None, content=None: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("op"), F.lit(path).alias("path"), F.lit(to).cast("string").alias("to"), (content if content is not None else F.lit(None)).cast("binary").alias("content"))
    new = F.concat(F.lit("new"), F.col("page_id").cast("string"))
    ops = F.array_compact(F.array(op(1, "move", "/a", "/b"), op(2, "move", "/b", "/c"), op(3, "put", "/b", None, new), op(4, "move", "/none", "/kept"), F.when(F.col("page_id") % 3 == 0, op(5, "remove", "/c"))))
    edits = pages.select(F.col("page_id").alias("book_id"), F.explode(ops).alias("o")).select("book_id", "o.*")
    return log.overlaid(base, edits).select("book_id", "path", F.md5("content").alias("digest"))


def _two_versions(s, d):
    """Of every four books one is the same but for the order of its attributes, one has another media type, one is gone, one is as it was; new ones have come."""
    m = adapters.manifest(s, d)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("x", "media_type"), ("y", "id"))])
    a = m.withColumn("attributes", pairs)
    kind, turned = F.col("book_id") % 4, F.reverse(pairs)
    b = m.filter(kind != 3).withColumn("attributes", F.when(kind == 0, turned).otherwise(pairs)).withColumn("media_type", F.when((kind == 1) & (F.col("ord") == 3), "text/new").otherwise(F.col("media_type")))
    more = a.filter(kind == 2).withColumn("book_id", -F.col("book_id"))
    return a, b.unionByName(more)


@query(f"""SELECT book_id, CASE WHEN book_id % 4 = 3 THEN 'removed' WHEN book_id % 4 = 1 AND bool_or(ord = 3) THEN 'changed' ELSE 'equal' END AS status, CASE WHEN book_id % 4 = 3 THEN 'manifest,spine' WHEN book_id % 4 = 1 AND bool_or(ord = 3) THEN 'manifest' ELSE '' END AS tables FROM {_MANIFEST} GROUP BY 1
    UNION ALL SELECT DISTINCT -book_id, 'added', 'manifest,spine' FROM {_MANIFEST} WHERE book_id % 4 = 2""")
def books_compared(s, d):
    a, b = _two_versions(s, d)
    tables = lambda m: {"manifest": m, "spine": m.select("book_id", "ord", F.col("id").alias("idref"))}
    return fingerprint.compared(tables(a), tables(b)).select("book_id", "status", F.array_join("tables", ",").alias("tables"))


@query(f"SELECT book_id, ord, 'changed' AS status FROM {_MANIFEST} WHERE book_id % 4 = 1 AND ord = 3 UNION ALL SELECT book_id, ord, 'removed' FROM {_MANIFEST} WHERE book_id % 4 = 3 UNION ALL SELECT -book_id, ord, 'added' FROM {_MANIFEST} WHERE book_id % 4 = 2")
def books_changed_rows(s, d):
    a, b = _two_versions(s, d)
    return fingerprint.changed_rows(a, b, ("ord",))
