"""Skipped sections, exploded books, reading with rewriting, edits of trees, and what a writer may be told."""

import io
import zipfile

import pytest
from bindery.operators import common, edit, manifest, metadata, reader, toc
from bindery.operators.builder import BookBuilder, Chapter, corpus
from bindery.sources import epub, sink
from pyspark.sql import functions as F

from tests.books import book

TABLES = ("package", "meta", "manifest", "spine", "toc")


def zipped(spark, **books):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "book_id string, content binary")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("skip", [("metadata",), ("manifest",), ("spine",), ("toc",), ("metadata", "manifest", "spine", "toc")])
def test_skipped_sections_stay_empty(spark, skip):
    whole, part = epub.corpus(zipped(spark, a=book())), epub.corpus(zipped(spark, a=book()), skip=skip)
    assert not part.books.first().error
    gone = {"metadata": "meta"} | {s: s for s in ("manifest", "spine", "toc")}
    for section, name in gone.items():
        got = rows(getattr(part, name))
        if section in skip or section == "toc" and "manifest" in skip:
            assert not [r for r in got if "owner='manifest'" not in r and "owner='spine'" not in r and "landmarks" not in r]
        elif section != "metadata":
            assert got == rows(getattr(whole, name))
    assert rows(part.package) == rows(whole.package)
    with pytest.raises(ValueError):
        epub.parse(zipped(spark, a=book()), skip=("guide",))


def test_exploded_and_zipped_books_are_equal(spark, tmp_path):
    data = book()
    for name in ("one", "two/nested"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            z.extractall(tmp_path / name)
    (tmp_path / "loose.txt").write_bytes(b"of no book")
    there = epub.read_corpus(spark, str(tmp_path), exploded=True)
    here = epub.corpus(zipped(spark, a=data))
    assert there.books.count() == 2 and not there.books.filter("error is not null").count()
    for name in TABLES:
        want = rows(getattr(here, name).drop("book_id"))
        for one in [r.book_id for r in there.books.collect()]:
            assert rows(getattr(there, name).filter(F.col("book_id") == one).drop("book_id")) == want
    files = rows(here.resources.select("path", F.md5("content")))
    assert rows(there.resources.filter("book_id like '%/one'").select("path", F.md5("content"))) == files
    empty = epub.corpus_of_files(there.resources.limit(0))
    assert empty.books.isEmpty() and all(getattr(empty, name).isEmpty() for name in TABLES)


def test_reading_with_rewriting(spark):
    x = '<html><head></head><body><a href="other.xhtml#a">o</a><img src="../i.png"/><a href="http://x.y/z">w</a></body></html>'
    made = BookBuilder().identifier("i").title("t").chapter([Chapter("One", x), Chapter("Two", x, linear=False)])
    made.resource("i.png", b"\x89PNG", kind="image/png")
    c = corpus(spark, {"b": made})
    plain = reader.content(reader.reading_order(c.spine), c.manifest, c.resources).orderBy("position").collect()
    assert [r.content for r in plain] == [x, x] and bytes(plain[0].bytes) == x.encode()
    for got in (reader.content(reader.reading_order(c.spine), c.manifest, c.resources, "/read/", "p{}"), manifest.read(c.manifest, c.resources, "/read/", "p{}").filter("media_type like '%xhtml%'")):
        for r in got.collect():
            assert 'href="/read/OEBPS/other.xhtml#a"' in r.content and 'src="/read/i.png"' in r.content and "http://x.y/z" in r.content and "<style>" in r.content
    images = manifest.read(c.manifest, c.resources).filter("media_type = 'image/png'").first()
    assert images.content is None and bytes(images.bytes) == b"\x89PNG" and images.error is None
    lost = manifest.read(c.manifest, c.resources.limit(0)).collect()
    assert {r.error for r in lost} == {"invalid_resource"}


def test_trees_are_edited_in_place(spark):
    nodes = spark.createDataFrame([("b", 0, p, str(p)) for p in ([], [0], [0, 0], [0, 1], [0, 1, 0], [1])], "book_id string, root_ord int, path array<int>, label string")
    new = spark.createDataFrame([("b", 0, [0], "x"), ("b", 0, [0, 0], "y")], "book_id string, root_ord int, path array<int>, label string")
    place = lambda df: {tuple(r.path): r.label for r in df.collect()}
    at = F.array(F.lit(0))
    assert place(toc.inserted(nodes, at, 1, new)) == {(): "[]", (0,): "[0]", (0, 0): "[0, 0]", (0, 1): "x", (0, 1, 0): "y", (0, 2): "[0, 1]", (0, 2, 0): "[0, 1, 0]", (1,): "[1]"}
    assert (0, 2) in place(toc.inserted(nodes, at, 99, new)) and place(toc.inserted(nodes, F.array(F.lit(1)), 5, new))[(1, 0)] == "x"
    assert place(toc.removed(nodes, at, 0)) == {(): "[]", (0,): "[0]", (0, 0): "[0, 1]", (0, 0, 0): "[0, 1, 0]", (1,): "[1]"}
    assert set(place(toc.retained(nodes, F.col("label") != "[0, 1]"))) == {(), (0,), (0, 0), (1,)}


def test_entries_by_id_through_refinements(spark):
    m = metadata.ordered(epub.corpus(zipped(spark, a=book())).meta)
    ids = m.filter("id is not null").select("book_id", "id").distinct()
    found = metadata.by_id(m, ids.unionByName(spark.createDataFrame([("a", "nowhere")], "book_id string, id string"))).collect()
    assert len(found) == ids.filter("id is not null").join(m.filter("owner = 'metadata'"), ["book_id", "id"], "left_semi").distinct().count()


def test_copies_and_renames(spark):
    c = epub.corpus(zipped(spark, a=book()))
    copy = edit.detached(c.manifest, c.resources)
    assert "book_id" not in copy.columns and "ord" not in copy.columns and copy.filter("content is not null").count() > 0
    first, second = [r.id for r in c.manifest.orderBy("ord").limit(2).collect()]
    renames = spark.createDataFrame([("a", first, second), ("a", second, "free")], "book_id string, old string, new string")
    items, _, judged = edit.try_set_ids(c.manifest, c.spine, renames)
    assert {(r.old, r.error) for r in judged.collect()} == {(first, "duplicate_item_id"), (second, None)}
    assert {first, "free"} <= {r.id for r in items.collect()}


def test_writer_options(spark, tmp_path):
    made = BookBuilder().identifier("i").title("t").language("en").modified("2019-08-07T06:05:04Z").chapter(Chapter("One", "x"))
    made.resource("a.css", "p{}", kind="text/css")
    made.container_resource("/extra/notes.txt", "n").container_resource("/META-INF/m.xml", "m")
    c = corpus(spark, {"b/1": made})

    def written(**how):
        data = bytes(sink.write(c, now="2024-01-02T03:04:05Z", **how).first().content)
        return zipfile.ZipFile(io.BytesIO(data))

    names = lambda z: set(z.namelist())
    assert "META-INF/m.xml" in names(written()) and "extra/notes.txt" not in names(written())
    assert "extra/notes.txt" in names(written(keep_orphans=True)) and "META-INF/m.xml" not in names(written(keep_orphans=False))
    assert {"extra/notes.txt", "META-INF/m.xml"} & names(written(keep_orphans=lambda p: p.endswith(".txt"))) == {"extra/notes.txt"}
    z = written(toc_stylesheets=["a.css"])
    assert {i.date_time for i in z.infolist()} == {(2019, 8, 7, 6, 5, 4)} and b'<link rel="stylesheet" type="text/css" href="a.css"/>' in z.read("OEBPS/toc.xhtml")
    again = epub.corpus(sink.write(c, toc_stylesheets=["a.css"], now="2024-01-02T03:04:05Z"))
    kept = zipfile.ZipFile(io.BytesIO(bytes(sink.write(again).first().content)))
    assert b'href="a.css"' in kept.read("OEBPS/toc.xhtml") and b"href" not in zipfile.ZipFile(io.BytesIO(bytes(sink.write(again, toc_stylesheets=[]).first().content))).read("OEBPS/toc.xhtml").split(b"<body>")[0]
    out = sink.save(sink.write(c), str(tmp_path / "out")).collect()
    assert [r.file for r in out] == [str(tmp_path / "out" / "b%2F1.epub")] and zipfile.is_zipfile(out[0].file)


def test_walks_have_no_cap(spark):
    """A chain deeper, and a table of more nodes, than Spark's recursion takes by default."""
    chain = spark.range(300).select(F.lit("b").alias("book_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    assert metadata.tree(chain, "id", "up").agg(F.max("depth")).first()[0] == 299
    many = spark.range(1_500_000).select(F.lit("b").alias("book_id"), "id", F.when(F.col("id") % 3 > 0, F.col("id") - 1).alias("up"))
    assert metadata.tree(many, "id", "up").count() == 1_500_000
    items = spark.range(120).select(F.lit("b").alias("book_id"), F.col("id").cast("string").alias("id"), (F.col("id") + 1).cast("string").alias("fallback"))
    assert manifest.fallback_chain(items.filter("id = '0' or id > ''")).filter("id = '0'").count() == 119


def test_updates_and_positions(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("b", 0, "y")], "book_id string, ord int, v string")
    assert rows(common.updated(df, F.col("v") == "x", v=F.lit("z")).select("v")) == rows(spark.createDataFrame([("z",), (None,), ("y",)], "v string"))
    assert common.at(df, 1).count() == 1 and {(r.book_id, r.ord): r.back for r in common.backwards(df, ["book_id"]).collect()} == {("a", 0): 1, ("a", 1): 0, ("b", 0): 0}
