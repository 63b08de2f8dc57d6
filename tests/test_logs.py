import random

from pyspark.sql import functions as F

from bindery.operators import log, manifest, metadata


def test_edit_log_equals_a_replay(spark):
    rng = random.Random(21)
    entries, ops, want = [], [], set()
    for book in range(150):
        rows = [[f"k{k}", f"v{k}", None] for k in range(rng.randint(0, 6))] if book % 10 else []
        entries += [(book, k, n, v, w) for n, (k, v, w) in enumerate(rows)]
        for seq in range(rng.randint(0, 12)):
            op, key = rng.choice(["insert", "insert", "remove", "move", "set", "other"]), rng.choice([f"k{rng.randint(0, 8)}", "new", None])
            at, v, w = rng.choice([None, rng.randint(-1, 9)]), rng.choice([None, f"s{seq}"]), rng.choice([None, f"w{seq}"])
            ops.append((book, seq * 3, op, key, at, v, w))
            if key is None:
                continue
            here = next((r for r in rows if r[0] == key), None)
            if op == "insert" and here:
                here[1:] = [v, w]
            elif op == "insert":
                rows.insert(max(0, min(len(rows) if at is None else at, len(rows))), [key, v, w])
            elif here and op in ("remove", "move"):
                rows.remove(here)
                if op == "move":
                    rows.insert(max(0, min(len(rows) if at is None else at, len(rows))), here)
            elif here and op == "set":
                here[1:] = [v if v is not None else here[1], w if w is not None else here[2]]
        want |= {(book, k, n, v, w) for n, (k, v, w) in enumerate(rows)}
    rng.shuffle(ops)
    e = spark.createDataFrame(entries, "book_id long, id string, ord int, a string, b string")
    o = spark.createDataFrame(ops, "book_id long, seq int, op string, id string, at int, a string, b string")
    assert {tuple(r) for r in log.edited(e, o).collect()} == want
    assert log.edited(e.limit(0), o.limit(0)).count() == 0 and log.edited(e, o.limit(0)).count() == len(entries)


def test_overlay_log_equals_a_replay(spark):
    rng = random.Random(22)
    base, ops, want = [], [], set()
    for book in range(150):
        files = {f"/{p}": f"{p}{book}".encode() for p in rng.sample("abcde", rng.randint(0, 5))}
        base += [(book, p, c) for p, c in files.items()]
        for seq in range(rng.randint(0, 14)):
            op, path, to = rng.choice(["put", "move", "move", "remove", "other"]), rng.choice([f"/{rng.choice('abcdef')}", None]), rng.choice([f"/{rng.choice('abcdef')}", None])
            content = f"new{seq}".encode()
            ops.append((book, seq, op, path, to, content if op == "put" else None))
            if path is None:
                continue
            if op == "put":
                files[path] = content
            elif op == "move" and to is not None and path in files and to != path:
                files[to] = files.pop(path)
            elif op == "remove":
                files.pop(path, None)
        want |= {(book, p, bytes(c)) for p, c in files.items()}
    b = spark.createDataFrame(base, "book_id long, path string, content binary")
    o = spark.createDataFrame(ops, "book_id long, seq int, op string, path string, `to` string, content binary")
    assert {(r.book_id, r.path, bytes(r.content)) for r in log.overlaid(b, o).collect()} == want
    assert log.overlaid(b.limit(0), o.limit(0)).count() == 0


def test_fallback_chains_equal_a_walk(spark):
    rng = random.Random(23)
    rows, want = [], set()
    for book in range(40):
        n = rng.randint(1, 12)
        to = {f"i{k}": rng.choice([None, "gone", *[f"i{x}" for x in range(n)]]) for k in range(n)}
        rows += [(book, a, b) for a, b in to.items()]
        for a in to:
            seen, at = [a], to[a]
            while at in to and at not in seen:
                seen.append(at)
                want.add((book, a, len(seen) - 1, at))
                at = to[at]
    rows += [(99, f"c{k}", f"c{k + 1}") for k in range(300)]
    want |= {(99, f"c{k}", j, f"c{k + j}") for k in range(300) for j in range(1, 300 - k)}
    items = spark.createDataFrame(rows, "book_id long, id string, fallback string")
    assert {tuple(r) for r in manifest.fallback_chain(items).collect()} == want


def test_by_id_ends_on_a_ring_of_parents(spark):
    rows = [(1, 1, 2, "a"), (1, 2, 1, "b"), (1, 3, 1, "below"), (1, 4, None, "root"), (1, 5, 4, "leaf"), (1, 6, 5, "leaf"), (1, 7, 7, "self")]
    e = spark.createDataFrame(rows, "book_id long, node_id long, parent_node_id long, id string").withColumns({"owner": F.lit("metadata"), "group_ord": F.lit(0), "ord": F.col("node_id").cast("int")})
    assert {(r.id, r.node_id) for r in metadata.by_id(e, e.select("book_id", "id")).collect()} == {("root", 4), ("leaf", 5)}
