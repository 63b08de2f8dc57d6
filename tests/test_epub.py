import pytest

from bindery.functions import civil, href
from bindery.operators import edit, manifest, metadata, reader, rewrite, toc
from bindery.sources import epub, sink
from bindery.sources.xml import add_text
from bindery.streaming import ingest
from pyspark.sql import functions as F

from tests.books import OPF, book


def _archives(spark, **books):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "book_id string, content binary")


@pytest.fixture(scope="module")
def corpus(spark):
    return epub.corpus(_archives(spark, a=book()))


def test_text_runs():
    s = add_text("", " \n \t \r  data1 &amp; data2  \n\r \n  \t ")
    assert s == "data1 &amp; data2 "
    s = add_text(s, "data3 ")
    assert s == "data1 &amp; data2 data3 "
    s = add_text(s, "  data4")
    assert s == "data1 &amp; data2 data3 data4"
    assert add_text(s, "data5") == "data1 &amp; data2 data3 data4data5"


def test_package_manifest_spine(corpus):
    p = corpus.package.first()
    assert (p.location, p.directory, p.family, p.page_direction, p.ncx_id) == ("/OPS/main.opf", "/OPS", "epub3", "rtl", "ncx")
    assert [(x.name, x.uri) for x in p.prefixes] == [("ex", "http://example.org/ns#")]
    assert [r.href for r in corpus.manifest.orderBy("ord").collect()][:3] == ["/OPS/c1.xhtml", "/OPS/sub/c%202.xhtml", "/nav.xhtml"]
    assert [(r.idref, r.linear) for r in corpus.spine.orderBy("ord").collect()] == [("nav", False), ("c1", True), ("c2", True)]


def test_metadata(corpus):
    m = metadata.ordered(corpus.meta)
    assert metadata.main_title(m).first().value == "Main"
    assert metadata.by_property(m, "dc:title").orderBy("ord").first().value == "Second title"
    assert {r.value: r.file_as for r in metadata.file_as(m).filter("property = 'dc:creator'").collect()} == {"Ann & Co": "Co, Ann", "Ill": None}
    assert {r.value: r.roles for r in metadata.roles(m).collect()} == {"Ann & Co": ["aut"], "Ill": ["ill"]}
    assert [r.value for r in metadata.by_property(m, "dc:subject").orderBy("ord").collect()] == ["early", "late"]
    assert metadata.unique_identifier(m, corpus.package).first().value == "urn:x:1"
    date = metadata.published(m).select(civil.show(civil.date_time(F.col("value")))).first()[0]
    assert date == "2020-03-07T00:00:00"
    assert metadata.modified(m).first().value == "2021-05-06T07:08:09Z"
    assert m.filter("property = 'dc:description'").first().value == "one &unknown; twoA"
    assert m.filter("owner = 'manifest'").first().owner_key == "a1"
    assert manifest.cover(corpus.manifest, m).first().id == "img"


def test_reading_order_and_content(corpus):
    order = lambda b: [r.idref for r in reader.reading_order(corpus.spine, b).orderBy("position").collect()]
    assert order("original") == ["nav", "c1", "c2"] and order("linear_only") == ["c1", "c2"] and order("non_linear_only") == ["nav"]
    assert order("append_non_linear") == ["c1", "c2", "nav"] and order("prepend_non_linear") == ["nav", "c1", "c2"]
    c = reader.cursor(reader.reading_order(corpus.spine)).orderBy("position").collect()
    assert [(r.prev_key, r.next_key, r.remaining) for r in c] == [(None, "c1", 2), ("nav", "c2", 1), ("c1", None, 0)]
    text = reader.content(reader.reading_order(corpus.spine), corpus.manifest, corpus.resources).filter("idref = 'c2'").first().content
    assert text.endswith("two</body></html>")


def test_chains_end(corpus):
    assert {(r.id, r.step, r.fallback_id) for r in manifest.fallback_chain(corpus.manifest).collect()} == {("img", 1, "png"), ("png", 1, "img")}


def test_toc(corpus, spark):
    rows = corpus.toc.orderBy("root_ord", "path").collect()
    assert {(r.root_kind, r.root_version) for r in rows} == {("toc", 3), ("landmarks", 3)}
    flat = toc.flattened(corpus.toc.filter("root_kind = 'toc'")).orderBy("path").collect()
    assert [(r.label, r.depth, r.href) for r in flat] == [("One", 1, "/OPS/c1.xhtml#s"), ("Two", 2, "/OPS/sub/c%202.xhtml?q=1#z"), ("Group", 1, None), ("Gone", 2, "/gone.xhtml")]
    assert {tuple(r.path): (r.total_len, r.max_depth) for r in toc.sizes(corpus.toc.filter("root_kind = 'toc'")).collect()}[()] == (4, 2)
    assert [r.label for r in toc.flattened(toc.cleaned(corpus.toc, corpus.manifest).filter("root_kind = 'toc'")).orderBy("path").collect()] == ["One", "Two", "Group"]
    both = epub.corpus(_archives(spark, a=book()), retain_variants=True).toc
    assert {(r.root_kind, r.root_version) for r in both.collect()} == {("toc", 3), ("landmarks", 3), ("landmarks", 2), ("toc", 2), ("page-list", 2)}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"META-INF/container.xml": None}, "invalid_resource"),
        ({"META-INF/container.xml": "<container/>"}, "no_opf_reference"),
        ({"OPS/main.opf": "<x/>"}, "no_package_found"),
        ({"OPS/main.opf": OPF.replace("ns# bad", "ns#").replace('id="w1"', 'id="w1" refines="#w2"').replace('id="w2"', 'id="w2" refines="#w1"')}, "cyclic_meta"),
    ],
)
def test_errors_in_both_modes(spark, change, code):
    for strict in (False, True):
        assert epub.corpus(_archives(spark, a=book(**change)), strict=strict).books.first().error.code == code


@pytest.mark.parametrize(
    ("old", "new", "code"),
    [
        ('version="3.0"', "", "missing_attribute"),
        ('version="3.0"', 'version="x"', "invalid_version"),
        ("http://example.org/ns# bad", "http://example.org/ns#", None),
        ("<dc:language>en</dc:language>", "", "missing_language"),
        ('href="c1.xhtml" media', 'href="c 1.xhtml" media', "unencoded_href"),
        ('idref="c1"', 'idref="zz"', "invalid_idref"),
        ('<item id="c2"', '<item id="c1"', "duplicate_item_id"),
        ('toc="ncx"', 'toc="zz"', "invalid_ncx_reference"),
    ],
)
def test_strict_errors(spark, old, new, code):
    fixed = OPF.replace("http://example.org/ns# bad", "http://example.org/ns#").replace(old, new)
    strict = epub.corpus(_archives(spark, a=book(**{"OPS/main.opf": fixed})), strict=True).books.first().error
    assert (strict.code if strict else None) == code
    assert epub.corpus(_archives(spark, a=book(**{"OPS/main.opf": fixed}))).books.first().error is None


def test_utf16_and_damaged(spark):
    odd = epub.corpus(_archives(spark, a=book(**{"OPS/main.opf": b"\xff\xfe<"}), b=b"no zip", c=book(**{"OPS/main.opf": OPF.encode("utf-16")})))
    assert {r.book_id: r.error.code if r.error else None for r in odd.books.collect()} == {"a": "undecodable", "b": "unreadable", "c": None}


def test_round_trip(spark, corpus):
    for retain in (False, True):
        one = epub.corpus(_archives(spark, a=book()), retain_variants=retain)
        again = epub.corpus(sink.write(one), retain_variants=retain)
        drop = {"manifest": ["href_raw"], "toc": ["href_raw", "attributes", "id", "root_ord"], "package": ["attributes"], "meta": ["natural_order", "node_id", "parent_node_id"]}
        for name in ("package", "manifest", "spine", "meta", "toc"):
            a, b = (getattr(c, name).drop(*drop.get(name, [])) for c in (one, again))
            keep = "root_kind <> 'landmarks' or root_version = 3" if name == "toc" else "true"
            assert sorted(map(repr, a.filter(keep).collect())) == sorted(map(repr, b.filter(keep).collect())), name
        paths = {r.path for r in again.resources.collect()}
        assert "/extra.bin" not in paths and "/OPS/i.png" in paths


def test_exploded_and_stream(spark, tmp_path):
    from tests.books import FILES

    for name, data in FILES.items():
        f = tmp_path / "dirs" / "b1" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data if isinstance(data, bytes) else data.encode())
    paths = {r.path for r in epub.read_directories(spark, str(tmp_path / "dirs")).collect()}
    assert "/OPS/main.opf" in paths and "/extra.bin" in paths
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "one.epub").write_bytes(book())
    assert epub.read_corpus(spark, str(tmp_path / "zips")).manifest.count() == 7
    seen = []
    q = ingest.ingest(spark, str(tmp_path / "zips"), str(tmp_path / "cp"), lambda c, n: seen.append(c.spine.count()))
    q.awaitTermination(60)
    assert seen == [3]


def test_rewriting():
    html = '<html><head></head><body><a href="../x.html?q">a</a><a href="#f">f</a><img src=\'i.png\'/><a href="http://h/">h</a><use href="#u"/><p class="c">&nbsp;</p></body></html>'
    out = rewrite.rewrite_markup(html, "/OPS", "/read/", "b{}")
    assert 'href="/read/x.html?q"' in out and 'href="#f"' in out and "src='/read/OPS/i.png'" in out and 'href="http://h/"' in out and 'href="/read/OPS/#u"' in out
    assert "<style>/*<![CDATA[*/b{}/*]]>*/</style></head>" in out and "&nbsp;" in out
    assert rewrite.rewrite_markup(html, "/OPS", None, None) == html


def test_hrefs(spark):
    rows = [("/EPUB/a/../b.xhtml?x=1#y",), ("a%20b+c%zz",), ("mailto:x@y",), ("",), ("img",), ("/",)]
    x = F.col("x")
    out = spark.createDataFrame(rows, "x string").select(href.path(x), href.name(x), href.extension(x), href.query(x), href.fragment(x), href.has_scheme(x), href.decode(x), href.normalize(href.path(x)), href.encode(x)).collect()
    assert tuple(out[0])[:5] == ("/EPUB/a/../b.xhtml", "b.xhtml", "xhtml", "x=1", "y") and out[0][7] == "/EPUB/b.xhtml"
    assert out[1][6] == "a b+c%zz" and out[2][5] is True and out[1][8] == "a%20b%2Bc%zz"
    pairs = spark.createDataFrame([("/a/b", "/a/b/c.x"), ("/img", "/img2/x"), ("/a/b/c", "/a/d"), ("/a", "/a"), ("/", "/x/y"), ("/a/b", "/a")], "b string, x string")
    assert [r[0] for r in pairs.select(href.relativize(F.col("b"), x)).collect()] == ["c.x", "../img2/x", "../../d", ".", "x/y", ".."]


def test_walks_are_not_capped(spark):
    """More than 100 levels and more than 1,000,000 rows, Spark's limits of recursive queries."""
    links = spark.range(1_000_300).selectExpr("0 AS book_id", "id AS k", "CASE WHEN id = 0 THEN null WHEN id < 300 THEN id - 1 ELSE 0 END AS p")
    out = metadata.tree(links, "k", "p").agg(F.count("*"), F.max("depth"), F.max("root")).first()
    assert tuple(out) == (1_000_300, 299, 0)
    ring = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 2), (0, 4, None), (1, 1, 4)], "book_id int, k int, p int")
    assert sorted(map(tuple, metadata.tree(ring, "k", "p").collect())) == [(0, 4, 0, 4), (1, 1, 0, 1)]
    entries = spark.range(120).selectExpr("0 AS book_id", "cast(id AS string) AS id", "id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_node_id")
    ids = spark.createDataFrame([(0, "3")], "book_id int, id string")
    assert sorted(r.node_id for r in edit.removed_subtrees(entries, ids).collect()) == [0, 1, 2]
    items = entries.selectExpr("book_id", "id", "cast(node_id + 1 AS string) AS fallback")
    chain = manifest.fallback_chain(items).filter("id = '0'").orderBy("step").collect()
    assert [(r.step, r.fallback_id) for r in chain] == [(k, str(k)) for k in range(1, 120)]
