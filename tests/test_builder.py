from bindery.operators import metadata, toc
from bindery.operators.builder import BookBuilder, Chapter, Meta, corpus
from bindery.sources import epub, sink

XHTML = "application/xhtml+xml"


def _again(spark, builder, **how):
    return epub.corpus(sink.write(corpus(spark, {"b": builder}), now="2024-01-02T03:04:05Z"), **how)


def test_chapters_version_2(spark):
    """A chapter without content borrows the reference of the first one below it; equal titles get ids of their own."""
    page = b"<p/>"
    builder = BookBuilder(version="2.0").chapter(
        [
            Chapter("Prologue", page, "front/prologue.xhtml"),
            Chapter("Winter", children=[Chapter("Snow", page), Chapter("Ice", children=[Chapter("Snow", page, "front/snow again.xhtml"), Chapter("Hail", href="front/prologue.xhtml#hail")])]),
            Chapter(None, page, "../plates.xhtml", children=[Chapter("Never shown", page)]),
            Chapter("Nothing below"),
        ]
    )
    c = _again(spark, builder)
    items = [(r.id, r.href_raw, r.media_type) for r in c.manifest.orderBy("ord").collect()]
    names = [("prologue", "front/prologue.xhtml"), ("snow", "snow.xhtml"), ("snow-1", "front/snow%20again.xhtml"), ("plates-xhtml", "../plates.xhtml"), ("never-shown", "never-shown.xhtml")]
    assert items == [(a, b, XHTML) for a, b in names] + [("ncx", "toc.ncx", "application/x-dtbncx+xml")]
    assert [r.idref for r in c.spine.orderBy("ord").collect()] == [a for a, _ in names]
    root = c.toc.filter("root_kind = 'toc' and size(path) = 0").first()
    assert (root.root_version, root.label) == (2, "Table of Contents")
    flat = toc.flattened(c.toc).orderBy("path").collect()
    want = [(1, "Prologue", "front/prologue.xhtml"), (1, "Winter", "snow.xhtml"), (2, "Snow", "snow.xhtml"), (2, "Ice", "front/snow%20again.xhtml"), (3, "Snow", "front/snow%20again.xhtml"), (3, "Hail", "front/prologue.xhtml#hail")]
    assert [(r.depth, r.label, r.href_raw) for r in flat] == want and len({r.id for r in flat}) == len(want)


def test_metadata_version_3_and_2(spark):
    def made(version):
        return (
            BookBuilder(version=version).identifier("urn:x").title([Meta("dc:title", "Sub").title_type("subtitle"), Meta("dc:title", "Main").title_type("main")]).author(Meta("dc:creator", "Ann <A>").file_as("A, Ann"))
            .tag(Meta("dc:subject", "Fiction").tagged("BISAC", "FIC")).language("en").modified("2023-01-01T00:00:00Z").page_direction("rtl").cover_image("c.png", b"png").chapter(Chapter.body("One", "<p>x</p>", kind="bodymatter"))
        )

    c = _again(spark, made("3.0"))
    m = metadata.ordered(c.meta)
    assert metadata.main_title(m).first().value == "Main" and metadata.unique_identifier(m, c.package).first().value == "urn:x"
    assert metadata.roles(m).first().roles == ["aut"] and metadata.file_as(m).filter("property = 'dc:creator'").first().file_as == "A, Ann"
    assert metadata.tag_scheme(m).first().scheme.asDict() == {"authority": "BISAC", "term": "FIC"}
    assert metadata.modified(m).first().value == "2023-01-01T00:00:00Z" and metadata.published(m).first().value == "2024-01-02T03:04:05Z"
    assert m.filter("property = 'cover'").first().value == c.manifest.filter("properties = 'cover-image'").first().id
    assert {(r.root_kind, r.root_version) for r in c.toc.collect()} == {("toc", 3), ("landmarks", 3)} and c.package.first().ncx_id == "ncx"
    both = _again(spark, made("3.0"), retain_variants=True)
    assert {(r.root_kind, r.root_version) for r in both.toc.collect()} == {("toc", 3), ("landmarks", 3), ("toc", 2)}

    old = metadata.ordered(_again(spark, made("2.0")).meta)
    assert old.filter("kind = 'meta3'").count() == 0
    assert metadata.roles(old).first().roles == ["aut"] and metadata.file_as(old).filter("property = 'dc:creator'").first().file_as == "A, Ann"
    assert metadata.tag_scheme(old).first().scheme.asDict() == {"authority": "BISAC", "term": "FIC"}


def test_strict_reading_of_a_built_book(spark):
    b = BookBuilder().identifier("i").title("t").language("en").chapter([Chapter("Same", b"1"), Chapter("Same", b"2"), Chapter("9 lives", b"3", linear=False)])
    c = _again(spark, b, strict=True)
    assert c.books.first().error is None
    assert [r.id for r in c.manifest.orderBy("ord").collect()][:3] == ["same", "same-1", "_9-lives"]
    assert [r.linear for r in c.spine.orderBy("ord").collect()] == [True, True, False]
    assert not BookBuilder().meta(Meta("x", "1")).clear_meta("x").entries[1:]


def test_resources(spark):
    b = BookBuilder()
    b.resource("a b.css", "x", key="k")
    b.resource("c.css", "y", key="k")
    b.container_resource("/META-INF/extra.xml", "<x/>").container_resource("/other.bin", b"z")
    c = _again(spark, b)
    assert [(r.id, r.href, r.media_type) for r in c.manifest.collect()] == [("k", "/OEBPS/c.css", "text/css")]
    assert {r.path for r in c.resources.collect()} == {"/mimetype", "/META-INF/container.xml", "/META-INF/extra.xml", "/OEBPS/package.opf", "/OEBPS/c.css"}
