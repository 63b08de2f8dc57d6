import random

from bindery.operators import fingerprint

KIND = "book_id long, ord int, label string, attributes array<struct<name string, value string>>, path array<int>"


def test_books_compare_as_their_rows_do(spark):
    rng = random.Random(31)
    a, b, want = [], [], {}
    for book in range(60):
        rows = [(k, rng.choice(["x", "y", None]), [(f"n{j}", rng.choice(["1", None])) for j in range(rng.randint(0, 3))], [k]) for k in range(rng.randint(1, 4))]
        a += [(book, *r) for r in rows]
        kind = rng.choice(["same", "turned", "label", "order", "gone", "twice"])
        other = [(k, n, x[::-1] if kind == "turned" else x, p) for k, n, x, p in rows]
        if kind == "label":
            other[0] = (other[0][0], "z", *other[0][2:])
        elif kind == "order":
            other = [(k, *r[1:]) for k, r in zip(range(len(other)), reversed(other), strict=True)]
        elif kind == "twice":
            other.append(other[0])
        if kind != "gone":
            b += [(book, *r) for r in other]
        bag = lambda rs: sorted((k, str(n), sorted(map(str, x)), p) for k, n, x, p in rs)
        want[book] = "removed" if kind == "gone" else "equal" if bag(rows) == bag(other) else "changed"
    one, two = spark.createDataFrame(a, KIND), spark.createDataFrame([*b, (99, 0, None, None, None)], KIND)
    got = {r.book_id: (r.status, r.tables) for r in fingerprint.compared({"t": one}, {"t": two}).collect()}
    assert {k: s for k, (s, _) in got.items()} == want | {99: "added"} and all(t == ([] if s == "equal" else ["t"]) for s, t in got.values())
    assert {r.book_id for r in fingerprint.changed_rows(one, two.dropDuplicates(["book_id", "ord"]), ("ord",)).collect()} <= {k for k, s in want.items() if s != "equal"} | {99}
    empty = one.limit(0)
    assert fingerprint.compared({"t": empty}, {"t": empty}).count() == 0
