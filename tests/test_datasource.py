"""The data source of ebooks: what is pushed into it, and what a write leaves."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from bindery.sources import datasource, epub

from tests.books import FILES, book

NAME = "substring_index(book_id, '/', -1)"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    top = tmp_path_factory.mktemp("books")
    (top / "sub").mkdir()
    (top / "a.epub").write_bytes(book())
    (top / "sub" / "b.epub").write_bytes(book(**{"OPS/c1.xhtml": "other"}))
    (top / "broken.epub").write_bytes(b"no archive")
    (top / "none.txt").write_bytes(b"no book")
    (top / "_hidden").mkdir()
    (top / "_hidden" / "c.epub").write_bytes(book())
    return str(top)


def read(spark, folder, **options):
    return spark.read.format("epub").options(**options).load(folder)


def test_entries_equal_the_binary_source(spark, folder):
    got = read(spark, folder).filter("path is not null").select("book_id", "path", "content")
    want = epub.unzip(epub.read_archives(spark, folder))
    rows = lambda df: sorted((r.book_id, r.path, bytes(r.content)) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 2 * (len(FILES) + 1)
    odd = read(spark, folder).filter("error is not null").selectExpr(NAME, "path", "content").collect()
    assert [tuple(r) for r in odd] == [("broken.epub", None, None)]


@pytest.mark.parametrize("name", [*epub.SCHEMAS, "books"])
@pytest.mark.parametrize("strict", [False, True])
def test_tables_equal_the_decoder(spark, folder, name, strict):
    parsed = epub.parse(epub.read_archives(spark, folder), strict=strict)
    want = parsed.select("book_id", "error") if name == "books" else epub.table(parsed, name)
    got = read(spark, folder, table=name, strict=strict)
    assert got.schema.names == want.schema.names
    rows = lambda df: sorted(repr(r).split("detail=")[0] if name == "books" else repr(r) for r in df.collect())  # noqa: E731  details of damage differ by what reads
    assert rows(got) == rows(want) and (got.count() > 0 or strict)


def test_pushed_filters_reach_the_reader(spark, folder, capsys):
    df = read(spark, folder).filter((F.col("path") == "/OPS/c1.xhtml") & F.col("book_id").endswith("/b.epub") & F.col("content").isNotNull())
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "path" in plan.split("PushedFilters")[1].split("\n")[0]
    left = [x for x in plan.split("\n") if x.startswith("Condition")]
    assert all("path" not in x and "book_id" not in x for x in left)
    assert [bytes(r.content) for r in df.collect()] == [b"other"]

    reader = datasource.EpubReader({"path": folder}, df.schema)
    kept = list(reader.pushFilters([EqualTo(("path",), "/x"), StringContains(("path",), "x"), In(("book_id",), (f"file:{folder}/a.epub", None)), IsNotNull(("content",))]))
    assert kept == [StringContains(("path",), "x"), IsNotNull(("content",))]
    assert [f for p in reader.partitions() for f in p.files] == [(f"{folder}/a.epub", f"file:{folder}/a.epub")]
    table = datasource.EpubReader({"path": folder, "table": "toc"}, df.schema)
    assert len(list(table.pushFilters([StringStartsWith(("path",), "x"), StringEndsWith(("book_id",), "none")]))) == 1  # a tree's path is another
    assert [p.files for p in table.partitions()] == [[]]


def test_entries_left_out_are_not_inflated(spark, tmp_path):
    data = bytearray(book())
    at = data.index(b"orphan")  # stored, not deflated: its checksum tells
    data[at : at + 6] = b"damage"
    (tmp_path / "d.epub").write_bytes(bytes(data))
    df = read(spark, str(tmp_path))
    bad = df.filter("error is not null").collect()
    assert [(r.path, r.content) for r in bad] == [("/extra.bin", None)] and df.count() == len(FILES) + 1
    assert df.filter("path = '/OPS/i.png' and error is null").count() == 1
    listed = spark.read.format("epub").schema("path string, bytes long, error string").load(str(tmp_path))
    assert listed.filter("error is not null").count() == 0
    assert {r.path: r.bytes for r in listed.collect()}["/extra.bin"] == 6


def test_files_are_dealt_by_size(spark, folder):
    size = os.path.getsize(f"{folder}/a.epub") + datasource.OPEN_BYTES
    reader = lambda n: datasource.EpubReader({"path": folder, "partition_bytes": str(n)}, None)
    assert [len(p.files) for p in reader(1).partitions()] == [1, 1, 1]
    assert [len(p.files) for p in reader(size + 1).partitions()] == [2, 1]
    assert [len(p.files) for p in reader(1 << 40).partitions()] == [3]
    assert read(spark, f"{folder}/a.epub", table="spine").count() == 3  # one file
    with pytest.raises(Exception, match="no table"):
        read(spark, folder, table="odd").count()
    with pytest.raises(Exception):
        read(spark, f"{folder}/nowhere").count()


def written(folder):
    return sorted(os.path.relpath(os.path.join(top, f), folder).split("/", 1)[-1].rsplit("/", 1)[-1] for top, _, names in os.walk(folder) for f in names)


def test_write_commits_once(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    rows = [("a/b", b"1"), (".x", b"2"), ("_y", b"3"), ("z" * 300, b"4"), ("same", b"5"), ("same", b"6")]
    made = spark.createDataFrame(rows, "book_id string, content binary")
    made.coalesce(1).write.format("epub").mode("append").save(out)
    names = written(out)
    assert len(names) == 6 and {"a%2Fb.epub", "%2Ex.epub", "%5Fy.epub", "same.epub", "same.2.epub"} <= set(names)
    assert [x[:4] for x in os.listdir(out)] == ["run-"]
    made.limit(1).write.format("epub").mode("append").save(out)
    assert len(written(out)) == 7 and read(spark, out).count() == 7  # none is an archive: a row each
    made.filter("book_id = '.x'").write.format("epub").mode("overwrite").save(out)
    assert written(out) == ["%2Ex.epub"]
    made.limit(0).write.format("epub").mode("overwrite").save(out)
    assert written(out) == [] and read(spark, out).count() == 0


def test_aborted_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(f"b{k}", b"1") for k in range(20)], "book_id string, content binary")
    good.write.format("epub").mode("append").save(out)
    before = sorted(os.listdir(out))
    bad = good.unionByName(spark.createDataFrame([("bad", None)], good.schema))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="without content"):
            bad.write.format("epub").mode(mode).save(out)
        assert sorted(os.listdir(out)) == before and len(written(out)) == 20
    with pytest.raises(Exception, match="are written"):
        good.withColumn("more", F.lit(1)).write.format("epub").mode("append").save(out)


def test_attempts_that_do_not_count_go(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    writer = datasource.EpubWriter({"path": str(tmp_path)}, StructType().add("book_id", "string").add("content", "binary"), False)
    batch = pa.RecordBatch.from_pydict({"book_id": ["a"], "content": [b"1"]})
    first, second = (writer.write(iter([batch])) for _ in range(2))  # a lost attempt and the one that counts
    writer.commit([second, None])
    assert first.folder != second.folder and written(tmp_path) == ["a.epub"]
