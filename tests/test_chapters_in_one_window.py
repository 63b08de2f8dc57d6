from bindery.operators import chapters


def test_tables_of_chapters_need_no_shuffle_of_their_own(spark):
    """Numbers and navigation come from the one window before; the four tables are read from what was saved."""
    rows = [(1, [0], "One", None, "part", True, True), (1, [1], None, None, None, True, False), (1, [1, 0], "Hidden", "a.xhtml#x", "part", False, True), (1, [2], "Two", None, None, False, True)]
    out = chapters.expanded(spark.createDataFrame(rows, "book_id long, path array<int>, title string, href string, kind string, has_content boolean, linear boolean"))
    for table in (out.manifest, out.spine, out.toc, out.landmarks):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert [(r.ord, r.linear) for r in out.spine.orderBy("ord").collect()] == [(0, True), (1, False)]
    assert [(tuple(r.path), r.label, r.href) for r in out.toc.orderBy("path").collect()] == [((0,), "One", "/OEBPS/one.xhtml"), ((2,), "Two", None)]
    assert [(r.place, r.label, r.href) for r in out.landmarks.orderBy("place").collect()] == [(0, "One", "/OEBPS/one.xhtml"), (1, "Hidden", "/OEBPS/a.xhtml#x")]
