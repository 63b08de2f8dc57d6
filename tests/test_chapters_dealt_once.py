import random
from collections import defaultdict

from bindery.functions import href
from bindery.operators import chapters, common, names
from pyspark.sql import functions as F

ROW = "book_id long, path array<int>, title string, href string, kind string, has_content boolean, linear boolean"
TAKEN = "book_id long, id string, href string"


def test_chapters_are_dealt_out_once(spark, monkeypatch):
    """Numbers and ids of a book's chapters come from one shuffle of them, with what the book had."""
    plans, save = [], common.Levels.save

    def saved(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(common.Levels, "save", saved)
    rows = [(b, [k], "One", None, None, True, True) for b in range(20) for k in range(5)]
    made = chapters.expanded(spark.createDataFrame(rows, ROW), spark.createDataFrame([(b, "one-2", "/OEBPS/one.xhtml") for b in range(0, 20, 2)], TAKEN)).manifest
    assert plans[0].count("Exchange hashpartitioning") == 1 and "Join" not in plans[0]
    got = {r.ord: (r.id, r.href_raw) for r in made.filter("book_id = 4").collect()}
    assert got == {0: ("one", "one1.xhtml"), 1: ("one-1", "one-1.xhtml"), 2: ("one-3", "one-3.xhtml"), 3: ("one-4", "one-4.xhtml"), 4: ("one-5", "one-5.xhtml")}


def _first_free(name, used, sign):
    k, cut = 0, name.rfind(".") if "." in name else len(name)
    while (new := name if not k else f"{name[:cut]}{sign}{k}{name[cut:]}") in used:
        k += 1
    used.add(new)
    return new


def test_few_and_many_taken_names_equal_one_by_one(spark):
    """Books with no, a few and more taken names than go along with a row; given hrefs stand between those that are made."""
    rng = random.Random(21)
    rows, taken, want = [], [], defaultdict(list)
    for book in range(24):
        n = (0, 3, names.FEW + 6)[book % 3]
        ids = {rng.choice(["one", "two", f"one-{rng.randint(1, 90)}", f"one-{rng.randint(1, 9)}-2", "one-01"]) for _ in range(n)} | {f"one-{k}" for k in range(1, n if n > 9 else 0)}
        hrefs = {rng.choice([f"/OEBPS/one{rng.choice(['', '1', '-2'])}.xhtml", "/OEBPS/x/one.xhtml", "/one.xhtml"]) for _ in range(n)} | {f"/OEBPS/two-{k}.xhtml" for k in range(1, n if n > 9 else 0)}
        taken += [(book, i, None) for i in ids] + [(book, None, h) for h in hrefs]
        titles = ["One"] if book % 2 else ["One", "One", "Two", "Two 3", "One 1", "9 é", ""]
        for k in range(40):
            title, said = rng.choice(titles), rng.choice([None] * 6 + ["one.xhtml", "x/../one-3.xhtml?q#f", "two 1.xhtml"])
            rows.append((book, [k], title, said, None, True, True))
            slug = {"One": "one", "Two": "two", "Two 3": "two-3", "One 1": "one-1", "9 é": "_9", "": "entry"}[title]
            id_ = _first_free(slug, ids, "-")
            path = {"one.xhtml": "/OEBPS/one.xhtml", "x/../one-3.xhtml?q#f": "/OEBPS/one-3.xhtml", "two 1.xhtml": "/OEBPS/two%201.xhtml"}.get(said)
            if path:
                hrefs.add(path)
            want[book].append((id_, path or _first_free(f"/OEBPS/{id_}.xhtml", hrefs, "")))
    out = chapters.expanded(spark.createDataFrame(rows, ROW), spark.createDataFrame(taken, TAKEN)).manifest
    got = defaultdict(list)
    for r in out.orderBy("ord").collect():
        got[r.book_id].append((r.id, r.href))
    assert got == want


def test_encoding_and_normal_paths(spark):
    """Native, as urllib has it; paths without dots are not walked."""
    from urllib.parse import quote

    texts = ["a b*c+d%20é~=&\U0001f600", "%2F%zz\"<>", "a-b_c.d/e:f?g#h", "\n", "", None, "x'(),;@$![]{}|^`\\"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", href.encode(F.col("x")).alias("x"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.x for r in df.orderBy("k").collect()] == [None if x is None else quote(x, safe="%./:#?-_~=&") for x in texts]
    paths = {"/a/b": "/a/b", "a//b": "a/b", "./a": "a", "../a": "a", "a/..": "", "/": "/", "": "", "a/": "a", "a/./b": "a/b", "a/...": "a/...", ".a/b.": ".a/b.", "/../a": "/a", "a/.\n": "a/.\n", ".": "", "..": ""}
    got = spark.createDataFrame([(k,) for k in paths], "x string").select("x", href.normalize(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == paths
