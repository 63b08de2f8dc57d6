"""Decoders of a book's parts: container, package document and navigation documents, as rows. No Spark here."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from .xml import Element, element_text, events

PACKAGE_TYPE = "application/oebps-package+xml"
NCX_TYPE = "application/x-dtbncx+xml"
SAFE = "%./:#?-_~=&"


class BookError(Exception):
    """code: what is wrong; detail: where."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


@dataclass
class Book:
    """Rows of each table, in document order."""

    package: dict = field(default_factory=dict)
    meta: list[dict] = field(default_factory=list)
    manifest: list[dict] = field(default_factory=list)
    spine: list[dict] = field(default_factory=list)
    toc: list[dict] = field(default_factory=list)


def clean_path(path: str) -> str:
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts)


def resolve(directory: str, ref: str) -> str:
    """An absolute path within the container; references with a scheme stay."""
    if ref.startswith("/") or re.match("[A-Za-z][A-Za-z0-9+.-]*:", ref):
        return ref
    return clean_path(f"{directory}/{ref}")


def _others(e: Element, *known: str) -> list[dict]:
    return [{"name": k, "value": v} for k, v in e.attributes if k not in known]


def rootfile(source: str) -> str:
    """Path of the package document: the first rootfile with the package's media type and a path."""
    for e in events(source):
        if e.local == "rootfile" and not e.closing and e.get("media-type") == PACKAGE_TYPE and e.get("full-path"):
            return clean_path(unquote(e.get("full-path")))
    raise BookError("no_opf_reference")


def version_family(raw: str) -> tuple[int | None, int | None, str]:
    parts = raw.strip().split(".")
    if not all(re.fullmatch(r"\+?[0-9]{1,5}", p) and int(p) < 65536 for p in parts[:2]):
        return None, None, "unknown"
    major, minor = int(parts[0]), int(parts[1]) if len(parts) > 1 else 0
    return major, minor, {2: "epub2", 3: "epub3"}.get(major, "unknown")


class PackageDecoder:
    """One pass over a package document."""

    def __init__(self, source: str, location: str, strict: bool = False, skip: frozenset[str] = frozenset()) -> None:
        self.strict, self.location, self.skip = strict, location, skip
        self.directory = posixpath.dirname(location)
        self.book, self.stream = Book(), events(source)
        self.pending: list[dict] = []
        self.guide: list[dict] = []
        self.seen: set[str] = set()

    def need(self, value: str | None, what: str) -> str:
        if value is None and self.strict:
            raise BookError("missing_attribute", what)
        return value or ""

    def href(self, raw: str) -> tuple[str, str]:
        coded = quote(raw, safe=SAFE)
        if coded != raw and self.strict:
            raise BookError("unencoded_href", raw)
        return resolve(self.directory, coded), raw

    def run(self) -> Book:
        sections: dict[str, Callable[[Element], None]] = {"metadata": self.metadata, "manifest": self.manifest, "spine": self.spine, "guide": self.read_guide}
        for e in self.stream:
            if e.closing or not e.name:
                continue
            if e.local == "package":
                self.package(e)
            elif e.local in sections and e.local not in self.seen:
                if not self.book.package:
                    raise BookError("no_package_found")
                self.seen.add(e.local)
                if e.local in self.skip or e.local == "guide" and "toc" in self.skip:
                    self.pass_over(e)
                else:
                    sections[e.local](e)
        if not self.book.package:
            raise BookError("no_package_found")
        if self.strict:
            for name in ("metadata", "manifest", "spine"):
                if name not in self.seen:
                    raise BookError(f"no_{name}_found")
            if "metadata" not in self.skip:
                self.validate()
        return self.book

    def pass_over(self, e: Element) -> None:
        """To the end of a section that is skipped; of the spine only its own attributes are read."""
        if e.local == "spine":
            self.spine_attributes(e)
        if not e.empty:
            for inner in self.stream:
                if inner.closing and inner.local == e.local:
                    return

    def package(self, e: Element) -> None:
        raw = self.need(e.get("version"), "package[*version]")
        major, minor, family = version_family(raw)
        if major is None and self.strict:
            raise BookError("invalid_version", raw)
        direction = e.get("dir")
        self.book.package = {
            "location": self.location, "directory": self.directory, "version_raw": raw, "major": major or 0, "minor": minor or 0, "family": family,
            "unique_identifier": self.need(e.get("unique-identifier"), "package[*unique-identifier]"), "prefixes": self.prefixes(e.get("prefix") or ""), "language": e.get("xml:lang"),
            "text_direction": direction if direction in ("ltr", "rtl") else "auto", "attributes": _others(e, "version", "unique-identifier", "prefix", "xml:lang", "dir"), "page_direction": "default", "ncx_id": None,
        }

    def prefixes(self, raw: str) -> list[dict]:
        out, words, i = [], raw.split(), 0
        while i < len(words):
            name, colon, uri = words[i].partition(":")
            if colon and not uri and i + 1 < len(words):
                uri, i = words[i + 1], i + 1
            if name and colon and uri:
                out.append({"name": name, "uri": uri})
            elif self.strict:
                raise BookError("invalid_prefix", words[min(i, len(words) - 1)])
            i += 1
        return out

    def metadata(self, section: Element) -> None:
        rows: list[dict] = []
        for e in self.stream:
            if e.closing and e.name == section.name:
                break
            if e.closing or not e.name:
                continue
            row = {"id": e.get("id"), "refines": e.get("refines"), "language": e.get("xml:lang"), "text_direction": e.get("dir") if e.get("dir") in ("ltr", "rtl") else "auto"}
            common = ("id", "refines", "xml:lang", "dir")
            if e.prefix == "dc":
                if e.empty and self.strict:
                    raise BookError("missing_value", e.name)
                row |= {"kind": "dc", "property": e.name, "attributes": _others(e, *common), "value": "" if e.empty else element_text(self.stream, e.name)}
            elif e.local == "meta" and e.get("property") is not None:
                if e.empty and self.strict:
                    raise BookError("missing_value", e.get("property"))
                row |= {"kind": "meta3", "property": e.get("property"), "attributes": _others(e, *common, "property", "content"), "value": (e.get("content") or "") if e.empty else element_text(self.stream, e.name)}
            elif e.local == "meta":
                row |= {"kind": "meta2", "property": self.need(e.get("name"), "metadata > meta[*name]"), "attributes": _others(e, *common, "name", "content"), "value": self.need(e.get("content"), "metadata > meta[*content]")}
            elif e.local == "link":
                row |= {"kind": "link", "property": "", "attributes": _others(e, *common), "value": ""}
            else:
                continue
            row["refines"] = row["refines"].removeprefix("#") if row["refines"] else None
            row["natural_order"] = len(rows)
            rows.append(row)
        self.associate(rows)

    def associate(self, rows: list[dict]) -> None:
        """Parents by id; the later of two equal ids replaces the earlier one. Refinements of no entry wait for items."""
        by_id: dict[str, dict] = {}
        for r in rows:
            if r["id"]:
                by_id[r["id"]] = r
        rows = [r for r in rows if not r["id"] or by_id[r["id"]] is r]
        for r in rows:
            chain, at = {id(r)}, by_id.get(r["refines"] or "")
            depth = 0
            while at is not None:
                if id(at) in chain:
                    raise BookError("cyclic_meta", r["id"] or r["refines"] or "")
                chain.add(id(at))
                depth, at = depth + 1, by_id.get(at["refines"] or "")
            parent = by_id.get(r["refines"] or "")
            r |= {"node_id": r["natural_order"], "parent_node_id": parent["natural_order"] if parent else None, "depth": depth, "owner": "metadata", "owner_key": None, "display_seq": None}
        for r in rows:
            if r["property"] == "display-seq" and r["parent_node_id"] is not None and re.fullmatch(r"\+?[0-9]{1,18}", r["value"]):
                parent = next(x for x in rows if x["node_id"] == r["parent_node_id"])
                parent["display_seq"] = int(r["value"]) if parent["display_seq"] is None else parent["display_seq"]
        orphans = {r["node_id"] for r in rows if r["refines"] and r["parent_node_id"] is None}
        while grown := {r["node_id"] for r in rows if r["parent_node_id"] in orphans} - orphans:
            orphans |= grown
        self.pending = [r for r in rows if r["node_id"] in orphans]
        self.book.meta = [r for r in rows if r["node_id"] not in orphans]

    def claim(self, owner: str, key: str | None) -> None:
        if not key:
            return
        tops = {r["node_id"] for r in self.pending if r["refines"] == key and r["parent_node_id"] is None}
        while grown := {r["node_id"] for r in self.pending if r["parent_node_id"] in tops} - tops:
            tops |= grown
        for r in self.pending:
            if r["node_id"] in tops:
                self.book.meta.append(r | {"owner": owner, "owner_key": key})
        self.pending = [r for r in self.pending if r["node_id"] not in tops]

    def manifest(self, section: Element) -> None:
        items: dict[str, dict] = {}
        for e in self.stream:
            if e.closing and e.name == section.name:
                break
            if e.closing or e.local != "item":
                continue
            key = self.need(e.get("id"), "manifest > item[*id]")
            href, raw = self.href(self.need(e.get("href"), "manifest > item[*href]"))
            if key in items and self.strict:
                raise BookError("duplicate_item_id", key)
            fallback = e.get("fallback")
            row = {
                "ord": items[key]["ord"] if key in items else len(items), "id": key, "href": href, "href_raw": raw, "media_type": self.need(e.get("media-type"), "manifest > item[*media-type]"),
                "fallback": fallback, "media_overlay": e.get("media-overlay"), "properties": e.get("properties") or "", "attributes": _others(e, "id", "href", "media-type", "fallback", "media-overlay", "properties"),
            }
            items[key] = row
            self.claim("manifest", key)
        self.book.manifest = list(items.values())

    def spine_attributes(self, section: Element) -> None:
        direction = section.get("page-progression-direction")
        self.book.package |= {"page_direction": direction if direction in ("ltr", "rtl") else "default", "ncx_id": section.get("toc")}

    def spine(self, section: Element) -> None:
        self.spine_attributes(section)
        ids = {r["id"] for r in self.book.manifest}
        for e in self.stream:
            if e.closing and e.name == section.name:
                break
            if e.closing or e.local != "itemref":
                continue
            idref = self.need(e.get("idref"), "spine > itemref[*idref]")
            if self.strict and "manifest" in self.seen - self.skip and idref not in ids:
                raise BookError("invalid_idref", idref)
            self.book.spine.append({"ord": len(self.book.spine), "id": e.get("id"), "idref": idref, "linear": e.get("linear") in (None, "yes"), "properties": e.get("properties") or "", "attributes": _others(e, "id", "idref", "linear", "properties")})
            self.claim("spine", e.get("id"))

    def read_guide(self, section: Element) -> None:
        for e in self.stream:
            if e.closing and e.name == section.name:
                break
            if not e.closing and e.local == "reference":
                href, raw = self.href(self.need(e.get("href"), "guide > reference[*href]"))
                self.guide.append({"label": self.need(e.get("title"), "guide > reference[*title]"), "kind": e.get("type") or "", "href": href, "href_raw": raw, "id": None, "attributes": _others(e, "title", "type", "href"), "children": []})

    def validate(self) -> None:
        roots = [r for r in self.book.meta if r["parent_node_id"] is None and r["owner"] == "metadata"]
        for name, code in (("dc:title", "missing_title"), ("dc:language", "missing_language")):
            if not any(r["property"] == name for r in roots):
                raise BookError(code)
        uid = self.book.package["unique_identifier"]
        if not any(r["property"] == "dc:identifier" and r["id"] == uid for r in roots):
            raise BookError("invalid_unique_identifier", uid)

    def toc_documents(self, preferred: int = 3, retain: bool = False) -> list[dict]:
        """Items of the navigation documents to read, the preferred one first."""
        items, ncx_id = self.book.manifest, self.book.package["ncx_id"]
        ncx = next((i for i in items if i["id"] == ncx_id), None) if ncx_id else None
        if self.strict and ncx_id and ncx is None:
            raise BookError("invalid_ncx_reference", ncx_id)
        nav = next((i for i in items if "nav" in i["properties"].split()), None)
        if self.strict and self.book.package["family"] == "epub2" and not ncx_id:
            raise BookError("no_ncx_reference")
        old_first = self.book.package["family"] == "epub2" or preferred == 2
        found = [i for i in ((ncx, nav) if old_first else (nav, ncx)) if i is not None]
        if self.strict and self.book.package["family"] == "epub3" and not found:
            raise BookError("no_xhtml_toc_reference")
        return found if retain else found[:1]


def _node(label: str = "", kind: str | None = None, href: str | None = None, raw: str | None = None, key: str | None = None, attributes: list | None = None) -> dict:
    return {"label": label, "kind": kind, "href": href, "href_raw": raw, "id": key, "attributes": attributes or [], "children": []}


def ncx_roots(source: str, location: str) -> list[tuple[str, dict]]:
    """navMap as toc and pageList as page-list."""
    directory, stream = posixpath.dirname(location), events(source)
    roots: list[tuple[str, dict]] = []
    stack: list[dict] = []
    title = ""
    for e in stream:
        if not e.name:
            continue
        if e.local in ("navMap", "pageList"):
            if not e.closing:
                stack = [_node(title if e.local == "navMap" else "", key=e.get("id"), attributes=_others(e, "id"))]
                roots.append(("toc" if e.local == "navMap" else "page-list", stack[0]))
            else:
                stack = []
        elif e.local == "docTitle" and not e.closing:
            title = element_text(stream, e.name)
        elif e.local in ("navPoint", "pageTarget") and stack:
            if e.closing:
                stack = stack[:-1] if len(stack) > 1 else stack
            else:
                node = _node(kind=e.get("type"), key=e.get("id"), attributes=_others(e, "id", "type"))
                stack[-1]["children"].append(node)
                stack.append(node)
        elif e.local == "navLabel" and stack and not e.closing:
            stack[-1]["label"] = element_text(stream, e.name)
        elif e.local == "content" and stack and not e.closing and e.get("src") is not None:
            coded = quote(e.get("src"), safe=SAFE)
            stack[-1] |= {"href": resolve(directory, coded), "href_raw": e.get("src")}
    return roots


def _items(stream: Iterator[Element], nav: Element, root: dict, directory: str) -> None:
    stack = [root]
    for e in stream:
        if e.closing and e.name == nav.name:
            return
        if not e.name:
            continue
        if e.local == "li":
            if e.closing:
                stack = stack[:-1] if len(stack) > 1 else stack
            else:
                node = _node(key=e.get("id"), attributes=_others(e, "id"))
                stack[-1]["children"].append(node)
                stack.append(node)
        elif e.closing:
            continue
        elif e.local in ("h1", "h2", "h3", "h4", "h5", "h6") and len(stack) == 1:
            root["label"] = element_text(stream, e.name)
        elif e.local == "span" and len(stack) > 1:
            stack[-1]["label"] = element_text(stream, e.name)
        elif e.local == "a" and len(stack) > 1:
            raw = e.get("href")
            stack[-1] |= {"id": e.get("id"), "kind": e.get("epub:type"), "href_raw": raw, "href": resolve(directory, quote(raw, safe=SAFE)) if raw is not None else None}
            stack[-1]["label"] = "" if e.empty else element_text(stream, e.name)


def nav_roots(source: str, location: str) -> list[tuple[str, dict]]:
    """Each nav with a type."""
    directory, stream, roots = posixpath.dirname(location), events(source), []
    for e in stream:
        if e.name and e.local == "nav" and not e.closing and e.get("epub:type") is not None:
            root = _node(key=e.get("id"), attributes=_others(e, "id", "epub:type"))
            roots.append((e.get("epub:type"), root))
            _items(stream, e, root, directory)
    return roots


def toc_rows(roots: list[tuple[str, int, dict]]) -> list[dict]:
    """Rows of roots (kind, version, tree): later roots of an equal kind and version replace earlier ones in their place."""
    kept: dict[tuple[str, int], dict] = {}
    for kind, version, root in roots:
        kept[kind, version] = root
    out: list[dict] = []
    for order, ((kind, version), root) in enumerate(kept.items()):
        todo = [([], root)]
        while todo:
            path, node = todo.pop()
            out.append({k: node[k] for k in ("id", "label", "kind", "href", "href_raw", "attributes")} | {"root_kind": kind, "root_version": version, "root_ord": order, "path": path, "depth": len(path)})
            todo += [([*path, k], c) for k, c in reversed(list(enumerate(node["children"])))]
    return out


def decode_book(read: Callable[[str], str | None], strict: bool = False, preferred_toc: int = 3, retain: bool = False, skip: frozenset[str] = frozenset()) -> Book:
    """All tables of one book; ``read`` gives the text at a path of the container, or None. Sections to ``skip`` (metadata, manifest, spine,
    toc) are not decoded and stay empty; without a manifest there are no navigation documents to find."""
    container = read("/META-INF/container.xml")
    if container is None:
        raise BookError("invalid_resource", "/META-INF/container.xml")
    location = rootfile(container)
    source = read(location)
    if source is None:
        raise BookError("invalid_resource", location)
    decoder = PackageDecoder(source, location, strict, skip)
    book = decoder.run()
    roots: list[tuple[str, int, dict]] = []
    if decoder.guide:
        guide = _node()
        guide["children"] = decoder.guide
        roots.append(("landmarks", 2, guide))
    for item in () if "toc" in skip or "manifest" in skip else decoder.toc_documents(preferred_toc, retain):
        text = read(unquote(item["href"]))
        if text is None:
            if strict:
                raise BookError("invalid_resource", item["href"])
            continue
        old = item["media_type"].lower() == NCX_TYPE or item["id"] == book.package["ncx_id"]
        found = ncx_roots(text, item["href"]) if old else nav_roots(text, item["href"])
        if strict and not any(k == "toc" for k, _ in found):
            raise BookError("no_toc_found", item["href"])
        roots += [(k, 2 if old else 3, r) for k, r in found]
    if not retain and preferred_toc != 2 and any(k == "landmarks" and v == 3 for k, v, _ in roots):
        roots = [r for r in roots if r[:2] != ("landmarks", 2)]
    book.toc = toc_rows(roots)
    return book
