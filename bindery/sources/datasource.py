"""Ebooks as a Spark data source, ``spark.read.format("epub")`` and ``df.write.format("epub")``, after ``register(spark)``.

Reading gives one table, by option ``table``:

* ``entries`` (default): book_id, path, bytes, content, error. Tests of book_id leave out files before tasks are made, tests of path leave
  out entries before they are inflated; archives are read by ranges, from their central directory on. With a schema without ``content``
  nothing is inflated. A damaged entry has an error and no content; of an archive that cannot be listed there is one row without a path.
* ``books`` (book_id, error) and the tables of ``epub.SCHEMAS``: only the sections that a table needs are decoded, all of them if ``strict``.

Files (``*.epub`` below ``path``; names that begin with ``_`` or a dot are passed over) are dealt to tasks by size, ``partition_bytes`` each.
Every executor has to reach ``path``: a mounted path, or a URI that Arrow knows.

Writing takes (book_id, content). Tasks write below a hidden folder, each attempt in one of its own; the commit removes attempts that
do not count and renames the folder once, so that readers see all of a run or nothing. ``overwrite`` removes what was there after
that. The file system must be able to rename a folder."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .epub import BATCH_BYTES, DAMAGED, SCHEMAS, SECTIONS, _parsed, _row
from .package import clean_path

ENTRIES = "book_id string, path string, bytes long, content binary, error string"
BOOKS = "book_id string, error struct<code: string, detail: string>"
#: Sections that a table is made of; refinements are claimed by items and itemrefs, navigation documents are items.
NEEDED = {"package": set(), "meta": {"metadata", "manifest", "spine"}, "manifest": {"manifest"}, "spine": {"spine"}, "toc": {"manifest", "toc"}, "books": SECTIONS}
#: What opening a file costs, in bytes, when files are dealt to tasks.
OPEN_BYTES = 1 << 20
#: The largest content of a row.
LARGEST = (1 << 31) - (1 << 16)
_ROWS = 4096


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what makes a URI of such a path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    store, inner = fs.FileSystem.from_uri(path)
    inner = inner.rstrip("/") or "/"
    return store, inner, "file:" if isinstance(store, fs.LocalFileSystem) else path.rstrip("/").removesuffix(inner)


@dataclass
class Files(InputPartition):
    """Names of the files of one task, with the ids of their books."""

    files: list[tuple[str, str]]


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        table = self.options.get("table", "entries")
        if table == "entries":
            return ENTRIES
        if table == "books":
            return BOOKS
        if table not in SCHEMAS:
            raise ValueError(f"no table: {table}; there are entries, books, {', '.join(SCHEMAS)}")
        return f"book_id string, {SCHEMAS[table]}"

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options, schema, overwrite)


class EpubReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.path = options["path"]
        self.table = options.get("table", "entries")
        self.strict, self.retain = (options.get(k, "false").lower() == "true" for k in ("strict", "retain_variants"))
        self.preferred = int(options.get("preferred_toc", 3))
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.schema = schema
        self.tests: dict[str, list[Filter]] = {"book_id": [], "path": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of books for all tables, tests of paths for entries; the others are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith)) and len(f.attribute) == 1 else None
            if column == "book_id" or column == "path" and self.table == "entries":
                self.tests[column].append(f)
            else:
                yield f

    def passes(self, column: str, value: str | None) -> bool:
        """Whether all pushed tests of a column hold; none holds for null."""

        def holds(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return value == f.value
            if isinstance(f, In):
                return value in f.value
            if isinstance(f, StringStartsWith):
                return value.startswith(f.value)
            return value.endswith(f.value) if isinstance(f, StringEndsWith) else True

        return not self.tests[column] or value is not None and all(map(holds, self.tests[column]))

    def partitions(self) -> list[Files]:
        store, root, scheme = _store(self.path)
        top = store.get_file_info(root)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(root) :].split("/"))
        tasks, held, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.endswith(".epub") or hidden(info.path) or not self.passes("book_id", scheme + info.path):
                continue
            held.append((info.path, scheme + info.path))
            size += info.size + OPEN_BYTES
            if size >= self.partition_bytes:
                tasks.append(Files(held))
                held, size = [], 0
        return tasks + [Files(held)] * bool(held or not tasks)  # Spark reads the whole source when there is no partition

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held, size = [], 0
        for row in self._rows(partition):
            held.append(row)
            size += len(row.get("content") or b"")
            if size >= BATCH_BYTES or len(held) >= _ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def _rows(self, partition: Files) -> Iterator[dict]:
        store = _store(self.path)[0]
        for path, book in partition.files:
            with store.open_input_file(path) as file:
                yield from (self._entries if self.table == "entries" else self._decoded)(book, io.BufferedReader(file, 1 << 16))

    def _entries(self, book: str, file) -> Iterator[dict]:
        inflate = "content" in self.schema.names
        try:
            z = zipfile.ZipFile(file)
        except DAMAGED as e:
            if self.passes("path", None):
                yield {"book_id": book, "error": str(e)}
            return
        with z:
            for info in z.infolist():
                name = clean_path(info.filename)
                if info.is_dir() or not self.passes("path", name):
                    continue
                row = {"book_id": book, "path": name, "bytes": info.file_size}
                try:
                    if inflate and info.file_size > LARGEST:
                        raise ValueError(f"more than {LARGEST} bytes")
                    yield row | ({"content": z.read(info)} if inflate else {})
                except DAMAGED as e:
                    yield row | {"error": str(e)}

    def _decoded(self, book: str, file) -> Iterator[dict]:
        skip = frozenset(() if self.strict else SECTIONS - NEEDED[self.table])
        try:
            with zipfile.ZipFile(file) as z:
                names = {clean_path(i.filename): i for i in z.infolist()}
                made = _row(book, *_parsed(lambda p: z.read(names[p]) if p in names else None, self.strict, self.preferred, self.retain, skip))
        except DAMAGED as e:
            made = {"error": {"code": "unreadable", "detail": str(e)}}
        if self.table == "books":
            yield {"book_id": book, "error": made["error"]}
        else:
            yield from ({"book_id": book} | row for row in made.get(self.table, ()))


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt."""

    folder: str


class EpubWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        if sorted(schema.names) != ["book_id", "content"]:
            raise ValueError(f"columns book_id and content are written, not {schema.names}")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        """File system, folder of the data, hidden folder of this run."""
        store, root, _ = _store(self.path)
        return store, root, f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each row is a file named by its id (by a digest, if that is long); an id that repeats in a task gets a number. Nulls are errors."""
        store, _, hidden = self._folders()
        attempt = uuid.uuid4().hex
        store.create_dir(f"{hidden}/{attempt}", recursive=True)
        used: dict[str, int] = {}
        for batch in iterator:
            for book, content in zip(batch.column("book_id"), batch.column("content"), strict=True):
                if not book.is_valid or not content.is_valid:
                    raise ValueError("a book without an id or without content")
                name = quote(str(book.as_py()), safe="")
                name = "%5F" + name[1:] if name[0:1] == "_" else "%2E" + name[1:] if name[0:1] == "." else name  # hidden names are not read
                name = name if 0 < len(name) <= 200 else hashlib.sha256(name.encode()).hexdigest()
                used[name] = used.get(name, 0) + 1
                with store.open_output_stream(f"{hidden}/{attempt}/{name}{f'.{used[name]}' if used[name] > 1 else ''}.epub") as f:
                    f.write(content.as_buffer())
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, hidden = self._folders()
        store.create_dir(hidden, recursive=True)
        counts = {m.folder for m in messages if m is not None}
        for info in store.get_file_info(fs.FileSelector(hidden)):
            if info.base_name not in counts:
                store.delete_dir(info.path)
        before = [i for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("run-") or i.base_name.endswith(".epub")] if self.overwrite else []
        store.move(hidden, f"{root}/run-{self.job}")
        for info in before:
            (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, hidden = self._folders()
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)
