"""Writing books: tables to archives, one group for each book."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from html import unescape
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import Levels
from .epub import ARCHIVES, Corpus, batched
from .package import resolve
from .xml import decode

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\u00a0", "&#160;"))


def escape(text: str) -> str:
    for raw, safe in _ESCAPES:
        text = text.replace(raw, safe)
    return text


class Markup:
    """Indented XML."""

    def __init__(self) -> None:
        self.lines, self.depth = ['<?xml version="1.0" encoding="utf-8"?>'], 0

    def add(self, name: str, attributes: list[tuple[str, str | None]] = (), text: str | None = None, close: bool = True) -> None:
        shown = "".join(f' {k}="{escape(v.strip())}"' for k, v in attributes if v is not None)
        body = "/>" if close and text is None else ">" if not close else f">{escape(text)}</{name}>"
        self.lines.append("  " * self.depth + f"<{name}{shown}{body}")
        self.depth += not close

    def end(self, name: str) -> None:
        self.depth -= 1
        self.lines.append("  " * self.depth + f"</{name}>")

    def bytes(self) -> bytes:
        return ("\n".join(self.lines) + "\n").encode()


def _pairs(attributes) -> list[tuple[str, str]]:
    return [(a["name"], a["value"]) for a in attributes] if attributes is not None else []


def _relative(directory: str, href: str) -> str:
    return href if "://" in href else posixpath.relpath(href, directory or "/")


def package_document(package: dict, meta: list[dict], manifest: list[dict], spine: list[dict]) -> bytes:
    out = Markup()
    prefix = " ".join(f"{p['name']}: {p['uri']}" for p in package["prefixes"]) or None
    direction = package["text_direction"] if package["text_direction"] != "auto" else None
    out.add("package", [("xmlns", "http://www.idpf.org/2007/opf"), ("version", package["version_raw"]), ("unique-identifier", package["unique_identifier"]), ("prefix", prefix), ("xml:lang", package["language"]), ("dir", direction), *[a for a in _pairs(package["attributes"]) if a[0] != "xmlns"]], close=False)
    out.add("metadata", [("xmlns:dc", "http://purl.org/dc/elements/1.1/"), ("xmlns:opf", "http://www.idpf.org/2007/opf")], close=False)
    for m in sorted(meta, key=lambda m: m["natural_order"]):
        way = m["text_direction"] if m["text_direction"] != "auto" else None
        common = [("id", m["id"]), ("refines", f"#{m['refines']}" if m["refines"] else None), ("xml:lang", m["language"]), ("dir", way), *_pairs(m["attributes"])]
        if m["kind"] == "dc":
            out.add(m["property"], common, m["value"])
        elif m["kind"] == "meta3":
            out.add("meta", [("property", m["property"]), *common], m["value"])
        elif m["kind"] == "meta2":
            out.add("meta", [("name", m["property"]), ("content", m["value"]), *common])
        else:
            out.add("link", common)
    out.end("metadata")
    out.add("manifest", close=False)
    for i in sorted(manifest, key=lambda i: i["ord"]):
        out.add("item", [("id", i["id"]), ("href", _relative(package["directory"], i["href"])), ("media-type", i["media_type"]), ("fallback", i["fallback"]), ("media-overlay", i["media_overlay"]), ("properties", i["properties"] or None), *_pairs(i["attributes"])])
    out.end("manifest")
    pages = package["page_direction"] if package["page_direction"] != "default" else None
    out.add("spine", [("toc", package["ncx_id"]), ("page-progression-direction", pages)], close=False)
    for s in sorted(spine, key=lambda s: s["ord"]):
        out.add("itemref", [("id", s["id"]), ("idref", s["idref"]), ("linear", None if s["linear"] else "no"), ("properties", s["properties"] or None), *_pairs(s["attributes"])])
    out.end("spine")
    out.end("package")
    return out.bytes()


def container_document(location: str) -> bytes:
    out = Markup()
    out.add("container", [("version", "1.0"), ("xmlns", "urn:oasis:names:tc:opendocument:xmlns:container")], close=False)
    out.add("rootfiles", close=False)
    out.add("rootfile", [("full-path", location.lstrip("/")), ("media-type", "application/oebps-package+xml")])
    out.end("rootfiles")
    out.end("container")
    return out.bytes()


def nav_document(rows: list[dict], location: str, title: str, styles: Sequence[str] = ()) -> bytes:
    """All roots of version 3, in order; ``styles`` are hrefs of stylesheets, as they are to stand there."""
    out = Markup()
    out.add("html", [("xmlns", "http://www.w3.org/1999/xhtml"), ("xmlns:epub", "http://www.idpf.org/2007/ops")], close=False)
    out.add("head", close=False)
    out.add("title", (), title)
    for style in styles:
        out.add("link", [("rel", "stylesheet"), ("type", "text/css"), ("href", style)])
    out.end("head")
    out.add("body", close=False)
    directory = posixpath.dirname(location)
    below: dict[tuple, list[dict]] = {}
    for r in rows:
        below.setdefault((r["root_ord"], tuple(r["path"][:-1]) if len(r["path"]) else None), []).append(r)

    def listed(root: int, path: tuple) -> None:
        children = sorted(below.get((root, path), []), key=lambda r: tuple(r["path"]))
        if not children:
            return
        out.add("ol", close=False)
        for c in children:
            out.add("li", _pairs(c["attributes"]), close=False)
            if c["href"] is not None:
                out.add("a", [("id", c["id"]), ("href", _relative(directory, c["href"])), ("epub:type", c["kind"])], c["label"])
            else:
                out.add("span", (), c["label"])
            listed(root, tuple(c["path"]))
            out.end("li")
        out.end("ol")

    for root in sorted((r for r in rows if not len(r["path"])), key=lambda r: r["root_ord"]):
        out.add("nav", [("epub:type", root["root_kind"]), ("id", root["id"]), ("hidden", "hidden" if root["root_kind"] == "page-list" else None), *[a for a in _pairs(root["attributes"]) if a[0] != "hidden"]], close=False)
        if root["label"]:
            out.add("h1", (), root["label"])
        listed(root["root_ord"], ())
        out.end("nav")
    out.end("body")
    out.end("html")
    return out.bytes()


def ncx_document(rows: list[dict], location: str, identifier: str) -> bytes:
    """The toc and page-list roots of version 2; entries without a reference borrow the first one below, or go."""
    out, directory = Markup(), posixpath.dirname(location)
    root = next((r for r in rows if r["root_kind"] == "toc" and not len(r["path"])), None)
    nodes = {tuple(r["path"]): r for r in rows if r["root_kind"] == "toc"}
    out.add("ncx", [("xmlns", "http://www.daisy.org/z3986/2005/ncx/"), ("version", "2005-1")], close=False)
    out.add("head", close=False)
    out.add("meta", [("name", "dtb:uid"), ("content", identifier)])
    out.add("meta", [("name", "dtb:depth"), ("content", str(max((len(p) for p in nodes), default=0)))])
    out.end("head")
    out.add("docTitle", close=False)
    out.add("text", (), root["label"] if root else "")
    out.end("docTitle")
    order = 0

    def first(path: tuple) -> str | None:
        return nodes[path]["href"] or next((h for p in sorted(nodes) if p[: len(path)] == path and p != path and (h := nodes[p]["href"])), None)

    def points(path: tuple, name: str) -> None:
        nonlocal order
        label = "nav-point" if name == "navPoint" else "page-target"
        for p in sorted(x for x in nodes if len(x) == len(path) + 1 and x[:-1] == path):
            ref = first(p)
            if ref is None:
                continue
            order += 1
            n = nodes[p]
            extra = [("type", n["kind"] or "normal")] if name == "pageTarget" else []
            out.add(name, [("id", n["id"] or f"{label}-{order}"), *extra, ("playOrder", str(order)), *[a for a in _pairs(n["attributes"]) if a[0] != "playOrder"]], close=False)
            out.add("navLabel", close=False)
            out.add("text", (), n["label"])
            out.end("navLabel")
            out.add("content", [("src", _relative(directory, ref))])
            points(p, name)
            out.end(name)

    out.add("navMap", close=False)
    points((), "navPoint")
    out.end("navMap")
    pages = {tuple(r["path"]): r for r in rows if r["root_kind"] == "page-list"}
    if pages:
        nodes = pages
        out.add("pageList", close=False)
        points((), "pageTarget")
        out.end("pageList")
    out.end("ncx")
    return out.bytes()


_LINK = re.compile(r"<link\b[^>]*>", re.S)
_PAIR = re.compile(r"([^\s=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def linked_styles(markup: str) -> list[str]:
    """hrefs of the stylesheets that a document links."""
    out = []
    for tag in _LINK.findall(markup):
        pairs = {k.lower(): a or b for k, a, b in _PAIR.findall(tag)}
        if "stylesheet" in pairs.get("rel", "").lower().split() and "href" in pairs:
            out.append(unescape(pairs["href"]))
    return out


def _stamp(text: str) -> tuple[int, int, int, int, int, int]:
    """A zip entry's time: the first date and time of a text, within what zip holds."""
    n = [int(x) for x in re.findall("[0-9]+", text)[:6]]
    year, month, day, *rest = [*n, *[1980, 1, 1][len(n) :]] if len(n) < 3 else n
    hour, minute, second = (rest + [0, 0, 0])[:3]
    if not 1980 <= year <= 2107:
        return (1980, 1, 1, 0, 0, 0)
    return year, min(max(month, 1), 12), min(max(day, 1), 31), min(hour, 23), min(minute, 59), min(second, 59)


def _has_event(m: dict, name: str | None) -> bool:
    return next((v for k, v in _pairs(m["attributes"]) if k == "opf:event"), None) == name


def completed_metadata(meta: list[dict], manifest: list[dict], old: bool, new: bool, now: str) -> list[dict]:
    """With what a written book is to say: dates, the cover for readers of version 2, and, for a book of version 2 only, refinements
    as attributes."""
    roots = [m for m in meta if m["parent_node_id"] is None and m["owner"] == "metadata"]
    blank = {"id": None, "refines": None, "language": None, "text_direction": "auto", "attributes": [], "parent_node_id": None, "owner": "metadata"}
    out, at = list(meta), max((m["natural_order"] for m in meta), default=-1)

    def add(**row) -> None:
        nonlocal at
        at += 1
        out.append(blank | row | {"natural_order": at})

    if not any(m["property"] == "dc:date" and (_has_event(m, "publication") or _has_event(m, None)) for m in roots):
        add(kind="dc", property="dc:date", value=now)
    if new and not any(m["property"] == "dcterms:modified" or m["property"] == "dc:date" and _has_event(m, "modification") for m in roots):
        add(kind="meta3", property="dcterms:modified", value=now)
    if old and not any(m["property"] == "cover" for m in roots):
        cover = next((i for i in manifest if "cover-image" in (i["properties"] or "").split()), None)
        if cover:
            add(kind="meta2", property="cover", value=cover["id"])
    if not new:
        below: dict[str, list[tuple[str, str]]] = {}
        for m in out:
            if m["refines"] and m["property"] in ("file-as", "role", "authority", "term"):
                below.setdefault(m["refines"], []).append((f"opf:{m['property']}", m["value"]))
        kept = []
        for m in out:
            if m["kind"] == "meta3" or m["kind"] == "link":
                continue
            known = {k for k, _ in _pairs(m["attributes"])}
            more = {k: v for k, v in reversed(below.get(m["id"] or "", [])) if k not in known}
            kept.append(m | {"attributes": [*({"name": k, "value": v} for k, v in _pairs(m["attributes"])), *({"name": k, "value": v} for k, v in more.items())]})
        out = kept
    return out


def _free(name: str, used: set[str]) -> str:
    stem, dot, ending = name.rpartition(".")
    k, new = 0, name
    while new in used:
        k += 1
        new = f"{stem}{k}{dot}{ending}" if dot else f"{name}-{k}"
    return new


def keep_container(path: str) -> bool:
    """Resources that no item names are written where they lie in META-INF."""
    return path.startswith("/META-INF/")


def archive(package: dict, meta: list[dict], manifest: list[dict], spine: list[dict], toc: list[dict], resources: dict[str, bytes], compression: int = 6, generate_toc: bool = True, targets: tuple[int, ...] = (2,), now: str = "", keep: Callable[[str], bool] = keep_container, toc_stylesheets: Sequence[str] | None = None) -> bytes:
    """A zipped book; the mimetype is its first entry, stored; all bear the date of the last modification. A nav document keeps those
    stylesheets of the one it replaces that are items, unless ``toc_stylesheets`` names others. Its own version and ``targets`` say which navigation it gets: that of
    version 2 in an NCX, that of version 3 in a nav document, in the items that are there or in new ones."""
    major = package["major"] or 3
    old, new = major == 2 or 2 in targets, major >= 3 or 3 in targets
    files = {unquote(i["href"]) for i in manifest}
    entries = {p: c for p, c in resources.items() if p in files or keep(p)}
    manifest, package = list(manifest), dict(package)
    if generate_toc and toc:
        title = next((m["value"] for m in sorted(meta, key=lambda m: m["natural_order"]) if m["property"] == "dc:title"), "")
        of = lambda version: [r for r in toc if r["root_version"] == version]
        blank = {"fallback": None, "media_overlay": None, "attributes": []}

        def item(key: str, name: str, kind: str, properties: str) -> dict:
            href = _free(f"{package['directory'].rstrip('/')}/{name}", {i["href"] for i in manifest})
            row = blank | {"ord": len(manifest), "id": _free(key, {i["id"] for i in manifest}), "href": href, "media_type": kind, "properties": properties}
            manifest.append(row)
            return row

        if new:
            nav = next((i for i in manifest if "nav" in (i["properties"] or "").split()), None) or item("nav", "toc.xhtml", "application/xhtml+xml", "nav")
            place, folder = unquote(nav["href"]), posixpath.dirname(nav["href"])
            if toc_stylesheets is None:
                known = {i["href"] for i in manifest}
                styles = [x for x in linked_styles(decode(resources[place])) if resolve(folder, x.split("?")[0].split("#")[0]) in known] if place in resources else []
            else:
                styles = [_relative(folder, resolve(package["directory"], x)) for x in toc_stylesheets]
            entries[place] = nav_document(of(3) or of(2), nav["href"], title, styles)
        if old:
            ncx = next((i for i in manifest if i["id"] == package["ncx_id"]), None) or item("ncx", "toc.ncx", "application/x-dtbncx+xml", "")
            package["ncx_id"] = ncx["id"]
            uid = next((m["value"] for m in meta if m["property"] == "dc:identifier" and m["id"] == package["unique_identifier"]), "")
            entries[unquote(ncx["href"])] = ncx_document(of(2) or of(3), ncx["href"], uid)
    entries["/META-INF/container.xml"] = container_document(package["location"])
    complete = completed_metadata(meta, manifest, old, new, now)
    entries[package["location"]] = package_document(package, complete, manifest, spine)
    said = next((m["value"] for m in complete if m["property"] == "dcterms:modified" or m["property"] == "dc:date" and _has_event(m, "modification")), now)
    stamp = _stamp(said or "")
    entries.pop("/mimetype", None)
    out = io.BytesIO()
    method = zipfile.ZIP_DEFLATED if compression else zipfile.ZIP_STORED
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", stamp), b"application/epub+zip", zipfile.ZIP_STORED)
        for path in sorted(entries):
            z.writestr(zipfile.ZipInfo(path.lstrip("/"), stamp), entries[path], method, compression or None)
    return out.getvalue()


def write(corpus: Corpus, compression: int = 6, generate_toc: bool = True, targets: tuple[int, ...] = (2,), now: str | None = None, keep_orphans: bool | Callable[[str], bool] | None = None, toc_stylesheets: Sequence[str] | None = None) -> DataFrame:
    """(book_id, content): an archive for each book, dated ``now`` where it has no dates. ``keep_orphans`` says which resources without an
    item are written: all, none, those a function of the path holds for; without it those in META-INF. Resources and rows of a book meet in one group; a book bounds its size."""
    now = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    nest = lambda df, name: df.groupBy("book_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "book_id"])).alias(name))
    met = corpus.package.select("book_id", F.struct(*[c for c in corpus.package.columns if c != "book_id"]).alias("package"))
    for name in ("meta", "manifest", "spine", "toc", "resources"):
        met = met.join(nest(getattr(corpus, name), name), "book_id", "left")

    keep = keep_container if keep_orphans is None else keep_orphans if callable(keep_orphans) else lambda _: bool(keep_orphans)

    def made(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                content = archive(r["package"], *[r[n] or [] for n in ("meta", "manifest", "spine", "toc")], {x["path"]: x["content"] for x in r["resources"] or []}, compression, generate_toc, targets, now, keep, toc_stylesheets)
                yield {"book_id": r["book_id"], "content": content}, len(content)

    return met.mapInArrow(lambda batches: batched(made(batches), ARCHIVES), "book_id string, content binary")


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of its book's name below ``folder``, which every executor reaches (a mounted path, or a URI that Arrow
    knows), and gives (book_id, file, bytes). A task that runs again writes the same file again, by renaming a finished one."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for book, content in zip(batch["book_id"], batch["content"], strict=True):
                file = f"{root.rstrip('/')}/{quote(str(book), safe='')}.epub"
                part = f"{file}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(bytes(content))
                store.move(part, file)
                out.append((book, file, len(content)))
            yield pd.DataFrame(out, columns=["book_id", "file", "bytes"])

    done = archives.select("book_id", "content").mapInPandas(run, "book_id string, file string, bytes long")
    return Levels(archives).save(done)
