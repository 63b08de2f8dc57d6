"""Cases beside the brute-force comparisons: damaged input, very many matches, hidden spans, ids that repeat, both ways of line recall."""

import collections
import itertools
import random
import re
import struct
import time
import types
import zlib

import numpy as np
import pytest

from bindery.llm import line_dedup, media, near_dedup, pii, queries, scratch, secrets
from tests.llm.test_llm import brute_components, shingles

SF = "/root/testdata/sf0.001"


def png(head, lines, *chunks):
    return media.SIGNATURE + media._chunk(b"IHDR", head) + b"".join(chunks) + media._chunk(b"IDAT", zlib.compress(lines)) + media._chunk(b"IEND", b"")


def test_damaged_media_are_errors_of_their_row(spark):
    good = media.encode_png(np.arange(1152, dtype=np.uint8).reshape(2, 576))
    head = lambda w, h, colour: struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    bad = [good[:-4], good[:30] + b"x" + good[31:], b"", b"no picture", media.SIGNATURE + media._chunk(b"IHDR", b"short"), png(head(4, 4, 0), bytes(10_000_000)), png(head(2, 1, 3), bytes([0, 0, 9]), media._chunk(b"PLTE", bytes(6)))]
    rows = [(0, 1152, good), (None, 1152, good), (0, 1152, good), *[(k, 0, x) for k, x in enumerate(bad, 1)], (99, 0, None)]
    out = media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out if r.error} == {*range(1, len(bad) + 1), 99}
    whole = [r for r in out if not r.error]
    assert len(whole) == 3 and len({r[2:] for r in whole}) == 1 and all(r.payload_sha256 is None and r.feature is None for r in out if r.error)


def test_palette_and_alpha_are_no_brightness():
    r = np.random.default_rng(3)
    grey = r.integers(0, 255, (40, 40), dtype=np.uint8)
    head = lambda colour: struct.pack(">IIBBBBB", 40, 40, 8, colour, 0, 0, 0)
    order = r.permutation(256).astype(np.uint8)  # where each brightness stands in the palette
    palette = np.repeat(np.argsort(order).astype(np.uint8), 3).tobytes()
    lines = lambda x: b"".join(b"\0" + row.tobytes() for row in x)
    shown = [media.decode_png(png(head(0), lines(grey)), shown=True), media.decode_png(png(head(3), lines(order[grey]), media._chunk(b"PLTE", palette)), shown=True)]
    shown.append(media.decode_png(png(head(4), lines(np.stack([grey, r.integers(0, 255, grey.shape, dtype=np.uint8)], axis=2).reshape(40, -1))), shown=True))
    assert len({media.cosine_hash(x) for x in shown}) == 1


HIDDEN = {
    "phone": ["(212) 555-0187", "415.555.0142", "0049 711 5550147", "030 55 50 14 72", "646-555-0199"],
    "email": ["maria.lopez [at] example [dot] org", "k_weber(at)posteo(dot)de", "jan @ uni-bonn.example", "a.smith[at]mail[dot]com"],
    "ip": ["192[.]168[.]14[.]3", "10(.)20(.)30(.)40", "172 dot 16 dot 254 dot 1", "fe80:1:22b:8a2e:370:7334:1:9", "2001:db8:0::1f"],
    "card": ["4539.1488.0343.6467", "4539/1488/0343/6467"],
}
LEAD = {"phone": "you may call", "email": "do contact", "ip": "from host", "card": "paid by card"}
HARMLESS = ["order 2023-11-04", "version 3.14.15", "isbn 978-3-16-148410-0", "at 12:30:45", "ratio 16:9:4:3", "page 1200 of 3400", "ids 81723645 and 99812", "they met @ noon. then left", "rooms 12 13 14 15 16 17", "part 300.400.500.600"]


def test_hidden_personal_data(spark):
    """Spans planted by hand, apart from the examples that the trees learn from; and what must not be one."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(r.randint(2, 8)))
    rows, want = [], {}
    for k, (kind, span) in enumerate(itertools.chain(*[[(kind, s) for s in spans] * 6 for kind, spans in HIDDEN.items()])):
        before = " ".join(word() for _ in range(r.randint(3, 40))) + f" {LEAD[kind]} "
        rows.append((k, before + span + " " + " ".join(word() for _ in range(5))))
        want[k] = (kind, len(before), len(before) + len(span))
    rows += [(1000 + k, f"{word()} {x} {word()}") for k, x in enumerate(HARMLESS * 6)]
    out = {x.doc_id: [(s.kind, s.start, s.end) for s in x.added] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(want[k] in out[k] for k in want)
    wrong = sum(len(v) for k, v in out.items() if k >= 1000)
    print("hidden spans found", found, "of", len(want), "; added in harmless rows", wrong, "of", len(HARMLESS) * 6)
    assert found >= 0.8 * len(want) and wrong <= 0.1 * len(HARMLESS) * 6


def test_very_many_matches(spark):
    """One text with very many spans takes time in proportion; columns may have the names of the operator's own."""
    n = 20_000
    rows = [(1, "a.b@c.de " * n, "x", "y"), (2, "call 523-555-1055 " * (n // 4), "x", "y"), (3, "9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS " * n, "x", "y"), (4, "deadbeefdeadbeef01 " * n, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, _more string")
    pii.redacted(pii.find(df.limit(0))).count()
    began = time.time()
    out = {r.doc_id: r for r in pii.redacted(pii.find(df)).collect()}
    assert len(out[1].base) == n and out[1].redacted == "[email] " * n and len(out[2].added) == n // 4 and out[2].redacted == "call [phone] " * (n // 4)
    assert [(s.start, s.end) for s in out[1].base[-2:]] == [(9 * n - 18, 9 * n - 10), (9 * n - 9, 9 * n - 1)]
    found = {r.doc_id: r for r in secrets.find(df).collect()}
    assert len(found[3].added) == n and len(found[4].base) == n and not found[4].added
    assert time.time() - began < 90


def test_overlaps_are_hidden_once(spark):
    row = (1, "é call +1 (523) 555-1055 or 4111 1111 1111 1111 ü")
    out = pii.redacted(pii.find(spark.createDataFrame([row], "doc_id long, text string"))).first()
    assert out.redacted == "é call [phone] or [card] ü"


def test_running_sums(spark):
    r = random.Random(5)
    for n in (0, 1, 2, 3, 10, 101):
        xs = [r.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(xs,)], "xs array<int>")
        out = df.select(pii._running(df.xs).alias("s"), pii._running(df.xs, join="greatest").alias("m")).first()
        assert out.s == list(itertools.accumulate(xs)) and out.m == list(itertools.accumulate(xs, max))


def test_secrets_inside_runs():
    """Credentials under other names, short ones, and beside base spans; words, paths and dates are none."""
    m = secrets.model()
    at = lambda text: [text[a:b] for a, b, _ in secrets.likely(text.encode(), secrets.base_spans(text.encode()), m)]
    assert at("session=9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS") in (["9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS"], ["session=9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS"])
    assert at("x/deadbeefdeadbeef01/9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS/y") == ["9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS"]
    assert at("QmZxTvBnRkLwCyHjDgSpAeFuIoTrWq") == ["QmZxTvBnRkLwCyHjDgSpAeFuIoTrWq"]
    for harmless in ("Donaudampfschifffahrtsgesellschaft", "src/main/resources/index2.html", "2024-11-05T10.30", "some-plain-words-here-12", "SomeCamelCaseName", "MAX_RETRY_COUNT_10"):
        assert not at(harmless), harmless
    found = [w for w in secrets.examples(11)["signed"] if m.score(w)[0] > m.threshold]
    assert len(found) >= 0.9 * secrets.EXAMPLES


def test_a_cluster_needs_a_shared_folder():
    def session(master, named=None, context=None):
        conf = types.SimpleNamespace(get=lambda k, d=None: named)
        sc = types.SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: context)
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: None), sparkContext=sc)

    assert scratch.shared_dir(session("local[8]")) == scratch.LOCAL_DEFAULT
    assert scratch.shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x" and scratch.shared_dir(session("yarn", None, "hdfs:///y")) == "hdfs:///y"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master))


def test_one_id_with_different_texts(spark):
    import corpus_pipeline

    words = lambda r, n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    r = random.Random(6)
    a, b, c = words(r, 60), words(r, 60), words(r, 60)
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "t"), (2, b, "s"), (3, c, "s"), (3, c, "s"), (None, a, "s"), (None, a, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = set()
    for parts in (1, 3, 7):
        out = corpus_pipeline.near_duplicates(spark, df.repartition(parts), SF).collect()
        assert sorted(str(x.doc_id) for x in out if x.doc_id not in (2,)) == ["1", "3", "None", "None"]
        seen.add(tuple(sorted(map(str, out))))
    assert len(seen) == 1


def test_near_dedup_recall(spark):
    """Of all rows whose id is divisible by 50, every link at 0.8 or more lies within one component."""
    df = queries.documents(spark, "/root/testdata/sf0.01")
    sets = {r.doc_id: shingles(r.text, 2) for r in df.collect()}
    comp = {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, params=near_dedup.NearDedup(shingle=2)).collect()}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and all(comp[a] == comp[b] for a, b in links)


def brute_recurring(rows, p):
    """Lines (white space as one space) in ``documents`` documents of which each pair is no near copy, by the exact sets of word pairs."""
    squeeze = lambda x: re.sub(r"[\s]+", " ", x).strip(" ")
    places, pairs = collections.defaultdict(set), {}
    for i, t in rows:
        for line in t.split("\n"):
            if squeeze(line):
                places[squeeze(line)].add(i)

    def words_without(i, line):
        text = dict(rows)[i]
        own = [squeeze(x) for x in text.split("\n")]
        if 2 * len(line.encode()) > len(text.encode()):
            own = [x for x in own if x != line]
        w = " ".join(own).split(" ")
        return len(" ".join(own)), frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)])

    out, open_ = set(), set()
    for line, ids in places.items():
        if len(ids) < p.documents:
            continue
        chosen = []
        scores = []
        for i in sorted(ids):
            size, own = words_without(i, line)
            alike = [len(own & o) / len(own | o) for s, o in chosen if 0.3 < (size + 1) / (s + 1) < 3.4]
            scores += alike
            if all(x < 1 - p.distinct for x in alike):
                chosen.append((size, own))
        (out if len(chosen) >= p.documents else open_).add(line)
    return out, {x for x in places if x not in out and x not in open_}, places


def test_line_dedup_both_ways(spark):
    """Against brute force on the driver's table: recurring lines go from all but their first place, lines of fewer documents stay."""
    p = line_dedup.Templates()
    df = queries.documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in df.collect() if r.text]
    often, never, places = brute_recurring(rows, p)
    squeeze = lambda x: re.sub(r"[\s]+", " ", x).strip(" ")
    left = collections.Counter()
    for r in line_dedup.line_dedup(df, params=line_dedup.Templates(constant=2.0)).collect():
        left.update({squeeze(x) for x in (r.text or "").split("\n")})
    digits = re.compile("[0-9]")
    due = sum(len(places[x]) - 1 for x in often)
    done = sum(len(places[x]) - left[x] for x in often if not digits.search(x))
    due_plain = sum(len(places[x]) - 1 for x in often if not digits.search(x))
    lost = sum(left[x] < len(places[x]) for x in never if not digits.search(x))
    print("recurring lines", len(often), "places due", due, "share done", done / due_plain, "; lines of few documents touched", lost, "of", len(never))
    assert done >= 0.9 * due_plain and lost == 0


def test_line_dedup_odd_rows(spark):
    """Null ids come last, repeated rows lose the same lines, ties go to the least id, very long texts and names that clash."""
    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    shared = "this passage stands in many documents of the table"
    rows = [(k, f"{words(40)}\n{shared}\n{words(20 + k)}") for k in (5, 3, 9)]
    rows += [(None, f"{shared}\n{words(30)}"), rows[0], (7, None), (8, ""), (2, " ".join(["é a", "b ü"] * 150_000) + "\n" + shared), (11, "\n" * 50_000), (12, "\n".join(f"{shared} {words(2)}" for _ in range(3000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _key string, n_lines int")
    out = line_dedup.line_dedup(df).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "text", "_key", "n_lines", "n_dropped"]
    text = collections.defaultdict(list)
    for x in out:
        text[x.doc_id].append(x.text)
    assert shared in text[2][0].split("\n") and all(shared not in t[0].split("\n") for k, t in text.items() if k in (3, 5, 9, None))
    assert len(text[5]) == 2 and text[5][0] == text[5][1] and text[7] == [None] and text[8] == [""] and text[11] == ["\n" * 50_000]


def test_components_of_a_hub(spark):
    """A node with very many links, a long chain and a pair."""
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(200)] + [(9000, 9001)]
    found = near_dedup.components(scratch.Scratch(spark, "hub"), spark.createDataFrame(edges, "a long, b long"))
    comp = {r.id: r.comp for r in found.collect()}
    assert set(comp.values()) == {0, 5000, 9000} and all(comp[k] == 0 for k in range(3000)) and comp[5200] == 5000 and comp[9001] == 9000


def test_brute_components_agree_with_links():
    rows = [(1, "a b c"), (2, "a b c"), (3, "x y z"), (4, "")]
    assert {k: v for k, (_, v) in brute_components(rows, 2).items()} == {1: 1, 2: 1, 3: 3, 4: 4}
