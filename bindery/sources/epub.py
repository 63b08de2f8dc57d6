"""Corpora of ebooks: zipped or exploded books to the tables of ``SCHEMAS``, one task row for each book.

Only the files that decoders ask for are read out of an archive. ``skip`` names sections that are not decoded at all."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.href import decode as decode_href
from ..operators.common import Levels
from .package import Book, BookError, clean_path, decode_book
from .xml import decode

_ATTRIBUTES = "array<struct<name string, value string>>"
SCHEMAS = {
    "package": "location string, directory string, version_raw string, major int, minor int, family string, unique_identifier string, prefixes array<struct<name string, uri string>>, "
    f"language string, text_direction string, attributes {_ATTRIBUTES}, page_direction string, ncx_id string",
    "meta": "node_id long, parent_node_id long, owner string, owner_key string, depth int, natural_order int, display_seq long, id string, refines string, property string, value string, "
    f"language string, text_direction string, attributes {_ATTRIBUTES}, kind string",
    "manifest": f"ord int, id string, href string, href_raw string, media_type string, fallback string, media_overlay string, properties string, attributes {_ATTRIBUTES}",
    "spine": f"ord int, id string, idref string, linear boolean, properties string, attributes {_ATTRIBUTES}",
    "toc": f"root_kind string, root_version int, root_ord int, path array<int>, depth int, id string, label string, kind string, href string, href_raw string, attributes {_ATTRIBUTES}",
}
#: Sections that need not be decoded.
SECTIONS = {"metadata", "manifest", "spine", "toc"}
#: What a damaged archive raises.
DAMAGED = (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, ValueError, zlib.error)
#: Content of one batch of entries, about.
BATCH_BYTES = 1 << 24
#: Books of one batch, at most.
BATCH_BOOKS = 64
PARSED = "book_id string, error struct<code string, detail string>, " + ", ".join(f"{k} array<struct<{v.replace(' string', ': string').replace(' int', ': int').replace(' long', ': long').replace(' boolean', ': boolean').replace(' array', ': array')}>>" for k, v in SCHEMAS.items())


@dataclass(frozen=True)
class Corpus:
    """Tables of many books, each with book_id."""

    books: DataFrame
    package: DataFrame
    meta: DataFrame
    manifest: DataFrame
    spine: DataFrame
    toc: DataFrame
    resources: DataFrame


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content) of the zipped books below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return files.select(F.col("path").alias("book_id"), "content")


def batched(books: Iterable[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (row, bytes): a task holds few books at a time, however many Spark hands to it at once."""
    held, size = [], 0
    for row, n in books:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= BATCH_BOOKS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


#: Archives as Arrow has them.
ARCHIVES = pa.schema([("book_id", pa.string()), ("content", pa.binary())])


def unzip(archives: DataFrame) -> DataFrame:
    """(book_id, path, content) of every entry; a damaged archive has none, or those before the damage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            books, paths, contents = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(books, pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["book_id", "path", "content"])

        for batch in batches:
            for book, data in zip(batch.column("book_id"), batch.column("content"), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_buffer() or b"")) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                content = z.read(info)
                                held.append((book.as_py(), clean_path(info.filename), content))
                                size += len(content)
                                if size >= BATCH_BYTES:
                                    yield made()
                                    held.clear()
                                    size = 0
                except DAMAGED:
                    continue
        if held:
            yield made()

    return archives.select("book_id", "content").mapInArrow(run, "book_id string, path string, content binary")


def read_directories(spark: SparkSession, path: str, root_of: str = r"^(.*?)/(?:META-INF|mimetype)") -> DataFrame:
    """(book_id, path, content) of exploded books: a book is the directory above META-INF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = files.select(F.col("path").alias("file"))  # no content is read or shuffled to find the books
    roots = names.select(F.regexp_extract("file", root_of, 1).alias("book_id")).filter("book_id <> ''").distinct()
    above = names.withColumn("book_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/")) - 1), lambda k: F.array_join(F.slice(F.split("file", "/"), 1, k), "/"))))
    owner = above.join(roots, "book_id").groupBy("file").agg(F.max_by("book_id", F.length("book_id")).alias("book_id"))  # the innermost book
    met = files.select(F.col("path").alias("file"), "content").join(owner, "file")
    return met.select("book_id", F.expr("substring(file, length(book_id) + 1)").alias("path"), "content")


def _parsed(read: Callable[[str], bytes | None], strict: bool, preferred: int, retain: bool, skip: frozenset[str]) -> tuple[Book, BookError | None]:
    def text(path: str) -> str | None:
        data = read(path)
        return None if data is None else decode(data)

    try:
        return decode_book(text, strict, preferred, retain, skip), None
    except BookError as e:
        return Book(), e
    except ValueError as e:
        return Book(), BookError("undecodable", str(e))


def _row(book_id: str, book: Book, error: BookError | None) -> dict:
    return {
        "book_id": book_id, "error": {"code": error.code, "detail": error.detail} if error else None, "package": [book.package] if book.package else [],
        "meta": book.meta, "manifest": book.manifest, "spine": book.spine, "toc": book.toc,
    }


def _skipped(skip: Iterable[str]) -> frozenset[str]:
    if unknown := set(skip) - SECTIONS:
        raise ValueError(f"no sections: {sorted(unknown)}")
    return frozenset(skip)


def parse_files(files: DataFrame, strict: bool = False, preferred_toc: int = 3, retain_variants: bool = False, skip: Iterable[str] = ()) -> DataFrame:
    """As ``parse``, of (book_id, path, content) rows. Markup alone meets in one group for each book."""
    sections = _skipped(skip)
    markup = files.filter(F.lower("path").rlike(r"\.(opf|xml|ncx|xhtml|html|htm)$"))
    every = files.select("book_id").distinct()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = {p: bytes(c) for p, c in zip(rows["path"], rows["content"], strict=True) if p is not None}
        return pd.DataFrame([_row(rows["book_id"].iloc[0], *_parsed(held.get, strict, preferred_toc, retain_variants, sections))])

    return every.join(markup, "book_id", "left").groupBy("book_id").applyInPandas(run, PARSED)


def parse(archives: DataFrame, strict: bool = False, preferred_toc: int = 3, retain_variants: bool = False, skip: Iterable[str] = ()) -> DataFrame:
    """One row for each book, its tables nested; errors are a column and stop nothing."""
    sections = _skipped(skip)

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for book, data in zip(batch.column("book_id"), batch.column("content"), strict=True):
                book_id = book.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_buffer() or b"")) as z:
                        names = {clean_path(i.filename): i for i in z.infolist()}
                        row = _row(book_id, *_parsed(lambda p, z=z, names=names: z.read(names[p]) if p in names else None, strict, preferred_toc, retain_variants, sections))
                except DAMAGED as e:
                    row = _row(book_id, Book(), BookError("unreadable", str(e)))
                yield row, 0

    return archives.select("book_id", "content").mapInArrow(lambda batches: batched(decoded(batches), schema), PARSED)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One table of parsed books: only the section that is selected leaves the row."""
    return parsed.select("book_id", F.explode(name).alias("_r")).select("book_id", "_r.*")


def _tables(parsed: DataFrame, resources: DataFrame) -> Corpus:
    parsed = Levels(parsed).save(parsed)  # books are decoded once, whatever reads their tables
    return Corpus(parsed.select("book_id", "error"), *[table(parsed, n) for n in SCHEMAS], resources)


def corpus(archives: DataFrame, strict: bool = False, preferred_toc: int = 3, retain_variants: bool = False, skip: Iterable[str] = ()) -> Corpus:
    """Tables of (book_id, content) rows. Archives are read twice, for their tables and for their entries, so that what makes them runs once before."""
    archives = Levels(archives).save(archives.select("book_id", "content"))
    return _tables(parse(archives, strict, preferred_toc, retain_variants, skip), unzip(archives))


def corpus_of_files(files: DataFrame, strict: bool = False, preferred_toc: int = 3, retain_variants: bool = False, skip: Iterable[str] = ()) -> Corpus:
    """Tables of exploded books, (book_id, path, content) rows; no rows are an empty source, whose tables are empty."""
    return _tables(parse_files(files, strict, preferred_toc, retain_variants, skip), files)


def read_corpus(spark: SparkSession, path: str, exploded: bool = False, **options) -> Corpus:
    """Zipped or exploded books below ``path``; options: strict, preferred_toc, retain_variants, skip."""
    if exploded:
        return corpus_of_files(read_directories(spark, path), **options)
    archives = read_archives(spark, path)  # files already
    return _tables(parse(archives, **options), unzip(archives))


def made(chapters, books: DataFrame, content: Column, language: str = "en", directory: str = "/OEBPS") -> Corpus:
    """Version 3 books of expanded chapters (operators.chapters): ``books`` (book_id, title), ``content`` of each item, of the manifest's columns."""
    blank = F.lit(None).cast("string")
    none = F.array().cast(_ATTRIBUTES)

    def shaped(name: str, df: DataFrame, **values: Column) -> DataFrame:
        want = df.sparkSession.createDataFrame([], f"book_id string, {SCHEMAS[name]}").schema
        fill = {"attributes": none, "prefixes": F.array().cast("array<struct<name string, uri string>>"), "text_direction": F.lit("auto"), "properties": F.lit("")}
        pick = lambda f: values.get(f.name, F.col(f.name) if f.name in df.columns else fill.get(f.name, F.lit(None)))
        return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in want])

    package = shaped("package", books, location=F.lit(f"{directory}/package.opf"), directory=F.lit(directory), version_raw=F.lit("3.0"), major=F.lit(3), minor=F.lit(0), family=F.lit("epub3"), unique_identifier=F.lit("unique-identifier"), page_direction=F.lit("default"))
    said = F.posexplode(F.array(*[F.struct(F.lit(p).alias("property"), v.cast("string").alias("value")) for p, v in (("dc:identifier", F.col("book_id")), ("dc:title", F.col("title")), ("dc:language", F.lit(language)))])).alias("k", "m")
    said = books.select("book_id", said).select("book_id", "k", "m.*")
    meta = shaped("meta", said, node_id=F.col("k"), natural_order=F.col("k"), owner=F.lit("metadata"), depth=F.lit(0), kind=F.lit("dc"), id=F.when(F.col("k") == 0, "unique-identifier"))
    kinds = (("toc", "Table of Contents", chapters.toc, F.col("path")), ("landmarks", "Landmarks", chapters.landmarks, F.array("place")))
    trees = []
    for k, (kind, label, nodes, path) in enumerate(kinds):
        root = {"root_kind": F.lit(kind), "root_version": F.lit(3), "root_ord": F.lit(k)}
        trees.append(shaped("toc", nodes.withColumn("_path", path.cast("array<int>")), **root, path=F.col("_path"), depth=F.size("_path"), id=blank))
        trees.append(shaped("toc", nodes.select("book_id").distinct(), **root, path=F.array().cast("array<int>"), depth=F.lit(0), label=F.lit(label)))
    toc = reduce(DataFrame.unionByName, trees)
    resources = chapters.manifest.select("book_id", decode_href(F.col("href")).alias("path"), content.cast("binary").alias("content"))
    return Corpus(books.select("book_id", F.lit(None).cast("struct<code string, detail string>").alias("error")), package, meta, shaped("manifest", chapters.manifest), shaped("spine", chapters.spine), toc, resources)
