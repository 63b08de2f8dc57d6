"""Queries over ebooks made of the driver's tables: written as archives and read again."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..operators.common import Levels
from ..sources import datasource, epub
from ..sources.sink import container_document, package_document
from . import adapters
from .registry import query


def archives(s, d):
    """A zipped book for each conversation: a chapter for each turn, what the system says not linear."""
    talks = adapters.read(s, d, "conversations")
    nested = talks.groupBy(F.col("conv_id").cast("string").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def make(book: str, turns: list) -> bytes:
        package = {"location": "/OPS/p.opf", "directory": "/OPS", "version_raw": "3.0", "unique_identifier": "u", "prefixes": [], "language": "en", "text_direction": "auto", "attributes": [], "page_direction": "default", "ncx_id": None}
        blank = {"refines": None, "language": None, "text_direction": "auto", "attributes": []}
        meta = [blank | {"id": "u", "kind": "dc", "property": "dc:identifier", "value": book, "natural_order": 0}, blank | {"id": None, "kind": "dc", "property": "dc:title", "value": f"Talk {book}", "natural_order": 1}]
        items = [{"ord": k, "id": f"t{t['turn']}", "href": f"/OPS/t{t['turn']}.xhtml", "media_type": "application/xhtml+xml", "fallback": None, "media_overlay": None, "properties": "", "attributes": []} for k, t in enumerate(turns)]
        spine = [{"ord": k, "id": None, "idref": f"t{t['turn']}", "linear": t["role"] != "system", "properties": "", "attributes": []} for k, t in enumerate(turns)]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
            z.writestr("META-INF/container.xml", container_document("/OPS/p.opf"))
            z.writestr("OPS/p.opf", package_document(package, meta, items, spine))
            for t in turns:
                z.writestr(f"OPS/t{t['turn']}.xhtml", t["text"] or "")
        return out.getvalue()

    def made(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                content = make(r["book_id"], r["turns"])
                yield {"book_id": r["book_id"], "content": content}, len(content)

    return nested.mapInArrow(lambda batches: epub.batched(made(batches), epub.ARCHIVES), "book_id string, content binary")


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, 't' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, CAST(role <> 'system' AS INTEGER) AS linear FROM conversations")
def epub_spine(s, d):
    return epub.table(epub.parse(archives(s, d)), "spine").select("book_id", "idref", F.col("ord").cast("long").alias("ord"), F.col("linear").cast("int").alias("linear"))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS book_id, 'Talk ' || conv_id AS title FROM conversations")
def epub_titles(s, d):
    return epub.table(epub.parse(archives(s, d)), "meta").filter("property = 'dc:title'").select("book_id", F.col("value").alias("title"))


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, '/OPS/t' || turn || '.xhtml' AS path, md5(text) AS digest FROM conversations")
def epub_resources(s, d):
    return epub.unzip(archives(s, d)).filter("path like '%.xhtml'").select("book_id", "path", F.md5("content").alias("digest"))


def stored(s, d):
    """A folder of the archives, written through the data source."""
    datasource.register(s)
    made = archives(s, d)
    folder = Levels(made).root
    made.write.format("epub").mode("append").save(folder)
    return folder


def _named():
    return F.regexp_extract("book_id", r"([^/]*)\.epub$", 1).alias("book_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, '/OPS/t' || turn || '.xhtml' AS path, md5(text) AS digest FROM conversations")
def source_entries(s, d):
    read = s.read.format("epub").load(stored(s, d)).filter("path like '/OPS/t%' and path like '%.xhtml'")  # both are pushed: other entries are not inflated
    return read.select(_named(), "path", F.md5("content").alias("digest"))


@query("SELECT CAST(conv_id AS VARCHAR) AS book_id, 't' || turn AS idref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations WHERE CAST(conv_id AS VARCHAR) LIKE '%7'")
def source_spine(s, d):
    read = s.read.format("epub").option("table", "spine").load(stored(s, d)).filter("book_id like '%7.epub'")  # pushed: other files are not opened
    return read.select(_named(), "idref", F.col("ord").cast("long").alias("ord"))
