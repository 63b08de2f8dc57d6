"""A folder of books that changes between runs."""

import os

import pytest

from bindery.sources import epub
from bindery.streaming.versions import Library

from tests.books import book


def put(path, content, at):
    path.write_bytes(content)
    os.utime(path, (at, at))


def state(library):
    c = library.corpus()
    name = lambda r: r.book_id.rsplit("/", 1)[-1]
    return {name(r): (r.error.code if r.error else None) for r in c.books.collect()}, sorted({name(r) for r in c.manifest.collect()}), c.spine.count(), c.resources.count()


def test_versions(spark, tmp_path, monkeypatch):
    folder, library = tmp_path / "in", Library(spark, str(tmp_path / "library"))
    folder.mkdir()
    assert library.refresh(str(folder)) is None and library.corpus().books.count() == 0
    put(folder / "a.epub", book(), 1_700_000_000)
    put(folder / "b.epub", book(), 1_700_000_100)
    assert library.refresh(str(folder)) == 0
    first = state(library)
    assert first[:3] == ({"a.epub": None, "b.epub": None}, ["a.epub", "b.epub"], 6)
    assert Library(spark, library.root).refresh(str(folder)) is None  # after a restart, too

    # an older file replaces its book; the other one is not decoded again
    put(folder / "a.epub", b"no archive", 1_600_000_000)
    # a run that stops before its versions are there is not seen, and the next one has its number
    write = Library._write

    def stopped(self, df, name, run):
        if name == "versions":
            raise OSError("stopped")
        return write(self, df, name, run)

    monkeypatch.setattr(Library, "_write", stopped)
    with pytest.raises(OSError):
        library.refresh(str(folder))
    assert state(library) == first
    monkeypatch.setattr(Library, "_write", write)
    assert library.refresh(str(folder)) == 1
    assert state(library)[:3] == ({"a.epub": "unreadable", "b.epub": None}, ["b.epub"], 3)
    assert spark.read.schema(epub.PARSED).parquet(f"{library.root}/parsed/run=1").count() == 1

    (folder / "b.epub").unlink()
    put(folder / "c.epub", book(), 1_700_000_200)
    assert library.refresh(str(folder)) == 2
    assert state(library)[:3] == ({"a.epub": "unreadable", "c.epub": None}, ["c.epub"], 3)
    (folder / "c.epub").unlink()
    assert library.refresh(str(folder)) == 3 and state(library)[:3] == ({"a.epub": "unreadable"}, [], 0)
    put(folder / "c.epub", book(), 1_700_000_200)  # back again
    assert library.refresh(str(folder)) == 4 and library.refresh(str(folder)) is None
    assert state(library)[0] == {"a.epub": "unreadable", "c.epub": None}
