import random
from collections import defaultdict

from pyspark.sql import functions as F

from bindery.operators import chapters, edit, names, toc
from bindery.operators.builder import BookBuilder, Chapter


def _fold(wanted, claims, style):
    """One name after the other; claims (ord or None, name) count from their place on."""
    out, used = {}, {n for o, n in claims if o is None}
    later = sorted((o, n) for o, n in claims if o is not None)
    for o, name in sorted(wanted):
        used |= {n for p, n in later if p <= o}
        cut = name.rfind(".") if style.ending and "." in name else len(name)
        k, new = 0, name
        while new in used:
            k += 1
            new = f"{name[:cut]}{style.sign}{k}{name[cut:]}"
        used.add(new)
        out[o] = new
    return out


def test_unique_names_equal_a_sequential_fold(spark):
    rng = random.Random(11)
    for style, pool in ((names.IDS, ["a", "a-1", "a-2", "a-1-1", "a-01", "b", "b-3", "-1", "c-x"]), (names.HREFS, ["a.xhtml", "a1.xhtml", "a11.xhtml", "a.b/c", "noend", "noend1", "x.y.css", ".x"])):
        wanted, taken, want = [], [], {}
        for book in range(120):
            some = rng.sample(pool, rng.randint(1, 4))
            mine = [(o, rng.choice(some)) for o in range(rng.randint(0, 12))]
            claims = [(rng.choice([None, None, rng.randint(0, 12)]) if book % 2 else None, rng.choice([*pool, "a-3", "a2.xhtml", "a-12"])) for _ in range(rng.randint(0, 5))]
            wanted += [(book, o, n) for o, n in mine]
            taken += [(book, o, n) for o, n in claims]
            want |= {(book, o): n for o, n in _fold(mine, claims, style).items()}
        w = spark.createDataFrame(wanted, "book_id long, ord int, name string")
        t = spark.createDataFrame(taken, "book_id long, ord int, name string")
        assert {(r.book_id, r.ord): r.new_name for r in names.unique(w, t, ["book_id"], style).collect()} == want


def test_unique_names_of_one_large_book(spark):
    """Two hundred thousand names of one book, in as many roots as it has; no group but for roots that meet."""
    n = 200_000
    w = spark.range(n).select(F.lit(1).alias("book_id"), F.col("id").alias("ord"), F.concat(F.lit("n"), (F.col("id") % 50000).cast("string"), F.lit("x")).alias("id"))
    out = edit.unique_ids(w, w.filter("ord < 50000 and ord % 2 = 0").select("book_id", F.concat("id", F.lit("-2")).alias("id")))
    assert out.select("new_id").distinct().count() == n
    assert [r.new_id for r in out.filter("id = 'n4x'").orderBy("ord").collect()] == ["n4x", "n4x-1", "n4x-3", "n4x-4"]
    none = spark.createDataFrame([(1, 0, None), (1, 1, "a")], "book_id int, ord int, id string")
    assert {(r.ord, r.new_id) for r in edit.unique_ids(none, none.limit(0).select("book_id", "id")).collect()} == {(0, None), (1, "a")}
    assert edit.unique_ids(none.limit(0), none.select("book_id", "id")).count() == 0


def _random_tree(rng, size):
    paths, kids = [()], defaultdict(int)
    for _ in range(size):
        p = rng.choice(paths)
        paths.append((*p, kids[p]))
        kids[p] += 1
    return paths


def test_nested_sets(spark):
    rng = random.Random(12)
    rows = [(b, 0, list(p), rng.random() < 0.8, rng.choice([None, f"h{rng.randint(0, 9)}"])) for b in range(30) for p in _random_tree(rng, rng.randint(0, 25))]
    nodes = spark.createDataFrame(rows, "book_id long, root_ord int, path array<int>, good boolean, href string")
    got = {(r.book_id, tuple(r.path)): (r.enter, r.leave) for r in toc.indexed(nodes).collect()}
    by = defaultdict(list)
    for b, _, p, good, h in rows:
        by[b].append((tuple(p), good, h))
    sizes = {(r.book_id, tuple(r.path)): (r.total_len, r.max_depth) for r in toc.sizes(nodes).collect()}
    kept = {(r.book_id, tuple(r.path)) for r in toc.retained(nodes, F.col("good")).collect()}
    target = {(r.book_id, tuple(r.path)): r.target for r in chapters.with_first_reference(nodes).collect()}
    for b, own in by.items():
        own.sort()
        for k, (p, _, h) in enumerate(own):
            below = [(q, g, x) for q, g, x in own if q[: len(p)] == p and q != p]
            assert got[b, p] == (k, k + len(below)) and sizes[b, p] == (len(below), max((len(q) - len(p) for q, _, _ in below), default=0))
            assert ((b, p) in kept) == all(g or not q for q, g, _ in own if p[: len(q)] == q)
            assert target[b, p] == (h or next((x for _, _, x in below if x), None))
    assert toc.sizes(nodes.limit(0)).count() == 0 and toc.retained(nodes.limit(0), F.col("good")).count() == 0


def test_a_chain_of_two_thousand_levels(spark):
    chain = spark.range(2000).select(F.lit(1).alias("book_id"), F.lit(0).alias("root_ord"), F.array_repeat(F.lit(0), F.col("id").cast("int")).alias("path"))
    out = {(len(r.path)): (r.total_len, r.max_depth) for r in toc.sizes(chain).collect()}
    assert out == {d: (1999 - d, 1999 - d) for d in range(2000)}
    assert toc.retained(chain, F.size("path") != 1000).count() == 1000


def _chapters(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        href = rng.choice([None, None, "x/one.xhtml", "one.xhtml", "two words.xhtml", "one1.xhtml"])
        title = rng.choice([None, "One", "One", "One 1", "9 lives", "Two"])
        content = b"<p/>" if href is None or rng.random() < 0.6 else None
        content = content if rng.random() < 0.8 else None
        out.append(Chapter(title, content, href, kind=rng.choice([None, None, "bodymatter"]), linear=rng.random() < 0.8, children=_chapters(rng, depth + 1) if depth < 3 and rng.random() < 0.4 else []))
    return out


def test_chapters_over_tables_equal_the_builder(spark):
    rng = random.Random(13)
    rows, taken, want = [], [], {}
    for book in range(60):
        b = BookBuilder()
        if book % 2:
            b.resource("one.xhtml", b"x", key="one")
            b.resource("two-1.xhtml", b"x", key="two-1")
            taken += [(book, i["id"], i["href"]) for i in b.items]
        had = len(b.items)
        tops = _chapters(rng)
        b.chapter(tops)

        def add(cs, path, book=book):
            for k, c in enumerate(cs):
                rows.append((book, [*path, k], c.title, c.href, c.kind, c.content is not None, c.linear))
                add(c.children, [*path, k])

        add(tops, [])
        want[book] = (b, had)
    table = spark.createDataFrame(rows, "book_id long, path array<int>, title string, href string, kind string, has_content boolean, linear boolean")
    out = chapters.expanded(table, spark.createDataFrame(taken, "book_id long, id string, href string"))
    manifest, spine, nodes, marks = (defaultdict(list) for _ in range(4))
    for r in out.manifest.orderBy("ord").collect():
        manifest[r.book_id].append((r.id, r.href, r.href_raw))
    for r in out.spine.orderBy("ord").collect():
        spine[r.book_id].append((r.idref, r.linear))
    for r in out.toc.orderBy("path").collect():
        nodes[r.book_id].append((len(r.path), r.label, r.href, r.kind))
    for r in out.landmarks.orderBy("place").collect():
        marks[r.book_id].append((r.label, r.href, r.kind))
    for book, (b, had) in want.items():
        assert manifest[book] == [(i["id"], i["href"], i["href_raw"]) for i in b.items[had:]]
        assert spine[book] == [(s["idref"], s["linear"]) for s in b.refs]

        def flat(node, depth):
            for n in node["children"]:
                yield depth, n["label"], n["href"], n["kind"]
                yield from flat(n, depth + 1)

        roots = {kind: root for (kind, _), root in b.roots.items()}
        assert nodes[book] == (list(flat(roots["toc"], 1)) if "toc" in roots else [])
        assert marks[book] == ([(n["label"], n["href"], n["kind"]) for n in roots["landmarks"]["children"]] if "landmarks" in roots else [])
    assert chapters.expanded(table.limit(0)).manifest.count() == 0
