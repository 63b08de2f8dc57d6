"""Building books: metadata, resources and chapters by name, as the tables of a corpus.

A builder holds one new book on the driver; ``corpus`` makes tables of many. Ids, hrefs and reading order follow from what is
added: a chapter with content is a resource, a spine entry and a navigation entry, in this order, and so are its children.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ..functions.mime import BY_EXTENSION, DEFAULT
from ..sources.epub import SCHEMAS, Corpus
from ..sources.package import SAFE, resolve, toc_rows, version_family

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
XHTML = "application/xhtml+xml"


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.translate(str.maketrans(_UPPER, _LOWER))).strip("-")


def media_type(href: str) -> str:
    name = re.split("[?#]", href)[0].rpartition("/")[2]
    return BY_EXTENSION.get(name.rpartition(".")[2], DEFAULT) if "." in name else DEFAULT


@dataclass
class Meta:
    """An entry with its refinements; attributes as pairs."""

    property: str
    value: str = ""
    id: str | None = None
    language: str | None = None
    text_direction: str = "auto"
    attributes: list[tuple[str, str]] = field(default_factory=list)
    refinements: list[Meta] = field(default_factory=list)
    kind: str = ""

    def refined(self, name: str, value: str, *attributes: tuple[str, str]) -> Meta:
        self.refinements.append(Meta(name, value, attributes=list(attributes)))
        return self

    def file_as(self, value: str) -> Meta:
        return self.refined("file-as", value)

    def role(self, code: str) -> Meta:
        return self.refined("role", code, ("scheme", "marc:relators"))

    def alternate_script(self, value: str, language: str) -> Meta:
        self.refinements.append(Meta("alternate-script", value, language=language))
        return self

    def title_type(self, kind: str) -> Meta:
        return self.refined("title-type", kind)

    def scheme(self, source: str | None, code: str) -> Meta:
        return self.refined("identifier-type", code, *[("scheme", source)] * (source is not None))

    def tagged(self, authority: str, term: str) -> Meta:
        return self.refined("authority", authority).refined("term", term)


@dataclass
class Chapter:
    """A navigation entry (no title: none), with content as bytes, an href, a kind for the landmarks, and children."""

    title: str | None = None
    content: bytes | str | None = None
    href: str | None = None
    kind: str | None = None
    linear: bool = True
    children: list[Chapter] = field(default_factory=list)

    @classmethod
    def body(cls, title: str, markup: str, **more) -> Chapter:
        """``markup`` within a whole document."""
        head = title.replace("&", "&amp;").replace("<", "&lt;")
        return cls(title, f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{head}</title></head><body>{markup}</body></html>', **more)


def _many(x) -> list:
    """One, several or none."""
    return [] if x is None else list(x) if isinstance(x, Iterable) and not isinstance(x, (str, bytes)) else [x]


class BookBuilder:
    def __init__(self, version: str = "3.0", location: str = "/OEBPS/package.opf", generator: str | None = "bindery") -> None:
        self.version, self.location = version, location
        self.entries: list[Meta] = []
        self.items: list[dict] = []
        self.refs: list[dict] = []
        self.roots: dict[tuple[str, int], dict] = {}
        self.files: dict[str, bytes] = {}
        self.unique, self.pages, self.language_of = "", "default", None
        if generator:
            self.meta(Meta("generator", generator, kind="meta2"))

    @property
    def directory(self) -> str:
        return self.location.rpartition("/")[0] or "/"

    @property
    def major(self) -> int:
        return version_family(self.version)[0] or 3

    # metadata

    def meta(self, entries) -> BookBuilder:
        self.entries += _many(entries)
        return self

    def clear_meta(self, name: str) -> BookBuilder:
        self.entries = [m for m in self.entries if m.property != name]
        return self

    def _dc(self, name: str, values, **more) -> BookBuilder:
        return self.meta([v if isinstance(v, Meta) else Meta(f"dc:{name}", v, **more) for v in _many(values)])

    def identifier(self, values) -> BookBuilder:
        """The first one is the book's unique identifier."""
        for v in _many(values):
            m = v if isinstance(v, Meta) else Meta("dc:identifier", v)
            if not self.unique:
                m.id = self.unique = m.id or "unique-identifier"
            self.meta(m)
        return self

    def title(self, values) -> BookBuilder:
        return self._dc("title", values)

    def creator(self, values) -> BookBuilder:
        return self._dc("creator", values)

    def author(self, values) -> BookBuilder:
        return self.meta([(v if isinstance(v, Meta) else Meta("dc:creator", v)).role("aut") for v in _many(values)])

    def contributor(self, values) -> BookBuilder:
        return self._dc("contributor", values)

    def publisher(self, values) -> BookBuilder:
        return self._dc("publisher", values)

    def tag(self, values) -> BookBuilder:
        return self._dc("subject", values)

    def description(self, values) -> BookBuilder:
        return self._dc("description", values)

    def language(self, values) -> BookBuilder:
        return self._dc("language", values)

    def rights(self, values) -> BookBuilder:
        return self._dc("rights", values)

    def published(self, date: str) -> BookBuilder:
        """Replaces a publication date that is there."""
        self.entries = [m for m in self.entries if m.property != "dc:date" or ("opf:event", "modification") in m.attributes]
        return self._dc("date", date)

    def modified(self, date: str | None = None) -> BookBuilder:
        """Replaces a modification date that is there; now, if none is given."""
        self.clear_meta("dcterms:modified")
        return self.meta(Meta("dcterms:modified", date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), kind="meta3"))

    def page_direction(self, direction: str) -> BookBuilder:
        self.pages = direction if direction in ("ltr", "rtl") else "default"
        return self

    # structure

    def _unique_id(self, base: str | None) -> str:
        short = slug(base or "")[:50] or "entry"
        short = f"_{short}" if short[0].isdigit() else short
        used, new, k = {i["id"] for i in self.items}, short, 0
        while new in used:
            k += 1
            new = f"{short}-{k}"
        return new

    def _unique_href(self, name: str) -> str:
        stem, dot, ending = name.rpartition(".")
        used, new, k = {i["href"] for i in self.items}, name, 0
        while resolve(self.directory, new) in used:
            k += 1
            new = f"{stem}{k}{dot}{ending}"
        return new

    def resource(self, href: str, content: bytes | str, key: str | None = None, kind: str | None = None, properties: str = "", fallback: str | None = None, media_overlay: str | None = None) -> str:
        """Adds a resource, or replaces the one of this id in its place; returns the id."""
        raw = quote(href, safe=SAFE)
        path = resolve(self.directory, raw)
        key = key or self._unique_id(raw.split("?")[0].split("#")[0].rpartition("/")[2])
        row = {"id": key, "href": path, "href_raw": raw, "media_type": kind or media_type(raw), "fallback": fallback, "media_overlay": media_overlay, "properties": properties, "attributes": []}
        old = next((n for n, i in enumerate(self.items) if i["id"] == key), None)
        if old is None:
            self.items.append(row)
        else:
            self.files.pop(self.items[old]["href"], None)
            self.items[old] = row
        self.files[path] = content.encode() if isinstance(content, str) else content
        return key

    def cover_image(self, href: str, content: bytes, **more) -> BookBuilder:
        self.resource(href, content, properties="cover-image", **more)
        return self

    def container_resource(self, path: str, content: bytes | str) -> BookBuilder:
        """A file of the container that is not in the manifest."""
        self.files[resolve("/", path)] = content.encode() if isinstance(content, str) else content
        return self

    def _root(self, kind: str, title: str) -> dict:
        return self.roots.setdefault((kind, self.major), {"label": title, "kind": None, "href": None, "href_raw": None, "id": None, "attributes": [], "children": []})

    def toc_title(self, title: str) -> BookBuilder:
        self._root("toc", title)["label"] = title
        return self

    def landmarks_title(self, title: str) -> BookBuilder:
        self._root("landmarks", title)["label"] = title
        return self

    def chapter(self, chapters) -> BookBuilder:
        for c in _many(chapters):
            if (node := self._expand(c)) is not None:
                self._root("toc", "Table of Contents")["children"].append(node)
        return self

    def _expand(self, c: Chapter) -> dict | None:
        href = c.href
        if c.content is not None:
            plain = re.split("[?#]", href)[0] if href else None
            key = self._unique_id(c.title if c.title is not None else plain and plain.rpartition("/")[2])
            href = href or self._unique_href(f"{key}.xhtml")
            self.resource(re.split("[?#]", href)[0], c.content, key=key, kind=XHTML)
            self.refs.append({"ord": len(self.refs), "id": None, "idref": key, "linear": c.linear, "properties": "", "attributes": []})
        node = None
        if c.title is not None:
            raw = quote(href, safe=SAFE) if href else None
            node = {"label": c.title, "kind": c.kind, "href": resolve(self.directory, raw) if raw else None, "href_raw": raw, "id": None, "attributes": [], "children": []}
            if c.kind:
                self._root("landmarks", "Landmarks")["children"].append(node | {"children": []})
        for child in c.children:
            # what hangs on a chapter without an entry has no entry either
            if (below := self._expand(child)) is not None and node is not None:
                node["children"].append(below)
        return node

    # tables

    def _meta_rows(self) -> list[dict]:
        out: list[dict] = []
        used = {m.id for m in self.entries if m.id}

        def add(m: Meta, parent: dict | None, depth: int) -> None:
            key = m.id
            if m.refinements and not key:
                k = 1
                while f"meta-{k}" in used:
                    k += 1
                key = f"meta-{k}"
                used.add(key)
            kind = m.kind or ("dc" if m.property.startswith("dc:") else "meta3" if self.major >= 3 or parent else "meta2")
            row = {
                "node_id": len(out), "parent_node_id": parent["node_id"] if parent else None, "owner": "metadata", "owner_key": None, "depth": depth, "natural_order": len(out), "display_seq": None, "id": key,
                "refines": parent["id"] if parent else None, "property": m.property, "value": m.value, "language": m.language, "text_direction": m.text_direction, "attributes": [{"name": a, "value": b} for a, b in m.attributes], "kind": kind,
            }
            out.append(row)
            for r in m.refinements:
                add(r, row, depth + 1)

        for m in self.entries:
            add(m, None, 0)
        return out

    def rows(self) -> dict[str, list[dict]]:
        major, minor, family = version_family(self.version)
        package = {
            "location": self.location, "directory": self.directory, "version_raw": self.version, "major": major or 0, "minor": minor or 0, "family": family, "unique_identifier": self.unique, "prefixes": [],
            "language": self.language_of, "text_direction": "auto", "attributes": [], "page_direction": self.pages, "ncx_id": None,
        }
        toc = toc_rows([(kind, version, root) for (kind, version), root in self.roots.items()])
        return {"package": [package], "meta": self._meta_rows(), "manifest": [i | {"ord": n} for n, i in enumerate(self.items)], "spine": self.refs, "toc": toc, "resources": [{"path": p, "content": c} for p, c in self.files.items()]}


def corpus(spark: SparkSession, books: dict[str, BookBuilder]) -> Corpus:
    """Tables of new books by their ids."""
    made = {k: b.rows() for k, b in books.items()}

    def frame(name: str, schema: str) -> DataFrame:
        full = f"book_id string, {schema}"
        order = spark.createDataFrame([], full).columns
        return spark.createDataFrame([tuple(({"book_id": k} | r)[c] for c in order) for k, rows in made.items() for r in rows[name]], full)

    tables = [frame(n, s) for n, s in SCHEMAS.items()]
    return Corpus(spark.createDataFrame([(k, None) for k in made], "book_id string, error struct<code string, detail string>"), *tables, frame("resources", "path string, content binary"))
