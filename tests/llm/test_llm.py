"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns with clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from bindery.llm import exact_dedup, line_dedup, media, mixing, near_dedup, packing, pii, quality, queries, secrets, token_counts
from tests import compare

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key int, _text string, n_lines int, copies int, size string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return queries.documents(spark, SF)


@pytest.fixture(scope="module")
def odd_rows():
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdeéß"), 4))
    base = [word() for _ in range(60)]
    near = [base[:k] + [word()] + base[k + 1 :] for k in range(0, 60, 4)]
    texts = [None, "", " \t\n", "a", "a", "A", "one two", "One two", "x" * 50_000, "a@b." + "c." * 20_000 + "d", " ".join(base), *(" ".join(x) for x in near), " ".join(base).upper(), "\n".join(["é ü " + word() * 3] * 5), "<|endoftext|> plain", "a<|endoftext|>b <|endoftext|><|endoftext|>"]
    rows = [(k, t, "en", ["s1", "s2", None][k % 3], len(t or ""), "clash", 1, "t", 2, 3, "z") for k, t in enumerate(texts)]
    return [*rows, rows[10], (None, "no id", "en", "s1", 5, "", 0, "", 0, 0, "")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = re.findall(WORD, fold(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("table", ["docs", "odd"])
@pytest.mark.parametrize("block", [256, 2])
def test_near_dedup(request, table, block):
    df = request.getfixturevalue(table)
    want = brute_components([(r.doc_id, r.text) for r in df.collect()], 2)
    out = near_dedup.near_dedup(df, params=near_dedup.NearDedup(shingle=2, block=block)).collect()
    assert len(out) == df.count()
    for r in out:
        if r.doc_id is not None:
            assert ((r.n_shingles, r.component_id), r.kept) == (want[r.doc_id], r.component_id == r.doc_id), r
        else:
            assert r.component_id is None and r.kept


def test_near_dedup_links_beyond_the_centre(spark):
    """Chains: each text is near the next one only, so that no single centre reaches all."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 100])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(df, params=near_dedup.NearDedup(shingle=2)).collect()}
    assert got == {k: v for k, (_, v) in brute_components(rows, 2).items()} and len(set(got.values())) < 10


def test_posterior_bounds():
    p = near_dedup.NearDedup(miss=1e-6)
    least = p.least_matches()
    assert [n for n, _ in least] == [32, 64, 96, 128, 160]
    r = np.random.default_rng(1)
    lost = sum(len(near_dedup._alive(r.random((10_000, 160)) < 0.8, least)) for _ in range(5))
    assert lost == 50_000 and len(near_dedup._alive(r.random((10_000, 160)) < 0.4, least)) == 0


def test_minhash_estimates():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**64, 1000, dtype=np.uint64)
    errors = []
    for share in (500, 800, 900):
        b = np.concatenate((a[:share], r.integers(0, 2**64, 1000 - share, dtype=np.uint64)))
        sig = near_dedup.minhash([np.sort(a), np.sort(b)], near_dedup.NearDedup())
        errors.append(abs((sig[0] == sig[1]).mean() - share / (2000 - share)))
    assert max(errors) < 0.13


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_token_counts(request, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    df = request.getfixturevalue(table)
    want = collections.Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, block=100).collect()) == want
    assert collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df).collect()) == want


def test_token_files(spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 9, 1, 2, 3]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(np.array([9], "<u2").tobytes())
    for block in (1, 2, 3, 100):
        out = token_counts.scan(token_counts.read_files(spark, str(tmp_path), block=block), end=9).collect()
        assert sorted((r.file[-5], r.ordinal, r.start, r.n_tokens, r.ended) for r in out) == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True), ("a", 3, 6, 3, False), ("c", 0, 0, 0, True)]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mixing(request, table):
    df = request.getfixturevalue(table)
    rows = df.collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    total = collections.Counter()
    for r in rows:
        total[r.source] += size(r.text)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(total), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        open_ -= full
    out = mixing.mix(df).collect()
    source = {r.doc_id: r.source for r in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (total[s], pytest.approx(target[s])) and r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in total)
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, out))
    again = mixing.repeated(df.dropDuplicates(["doc_id"]), mixing.mix(df.dropDuplicates(["doc_id"])))
    assert again.columns == df.columns


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and pii._luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m[0])]


PERSONAL = [
    "ü a.b@c.de, a@b.c._x@d.e x@y@d.com @ a@b a@-.b.c 1.2.3.4.5 999.1.1.1 0001.02.3.255 1.2.3 +1 (523) 555-1055 +1 2 + +12345678 4111 1111 1111 1111 41111111111111112 4111-1111-1111-1111-",
    "call 523-555-1055 now; jane [at] mail [dot] com; version 3.1; order 2024-01-25",
    "+" + "1" * 40_000,
    "1." * 30_000,
]


def test_pii(spark, docs, odd):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(PERSONAL)], "doc_id long, text string")
    rows = docs.selectExpr("doc_id + 500 AS doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    out = pii.find(rows).select("doc_id", "text", pii.joined("base").alias("base"), pii.joined("added").alias("added")).collect()
    assert len(out) == rows.count()
    for r in out:
        assert r.base == ",".join(brute_pii(r.text)), r.doc_id
    added = {r.doc_id: r.added for r in out}
    assert "phone:5:17" in added[1001] and "email:23:47" in added[1001] and "2024" not in added[1001]
    assert not any(added[r.doc_id + 500] for r in docs.collect())
    hidden = pii.redacted(pii.find(extra.filter("doc_id = 1001"))).first().redacted
    assert hidden == "call [phone] now; [email]; version 3.1; order 2024-01-25"


def test_pii_models_hold_out():
    for kind, (model, threshold) in pii.models().items():
        rows, labels = pii._examples(kind, 3)
        said = [model.score(r) > threshold for r in rows]
        right = sum(a and b for a, b in zip(said, labels, strict=True))
        assert right >= 0.97 * sum(said) and right >= 0.6 * sum(labels), kind


SECRET = {"assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def test_secrets(spark, docs, odd):
    texts = ["é PassWord = 'abcdefghijklmnop' token: short password=token\" : abcdefghijklmnop AKIAABCDEFGHIJKLMN AKIA12 deadbeefdeadbeef01 ſecret=abcdefghijklmn", "key 9fK2mQ7xT4vB8nR1zL6wC3yH5jD0gS and some-plain-words-here-12"]
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.selectExpr("doc_id + 500 AS doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    least = {"assign": 12, "access": 18, "hex": 16}
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in secrets.find(rows).collect():
        want = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(SECRET.items()) for m in re.finditer(p, text[r.doc_id], re.A) if len(m[1] if k == "assign" else m[0]) >= least[k])
        assert [(s.start, s.end, s.kind) for s in r.base] == [(a, b, k) for a, _, b, k in want], r.doc_id
        if r.doc_id == 1001:
            assert [(s.start, s.end) for s in r.added] == [(4, 34)]


def test_secrets_model_holds_out():
    m, held = secrets.model(), secrets.examples(7)
    assert sum(m.score(w)[0] > m.threshold for w in held["ordinary"]) <= 6
    for kind in ("access", "hex", "key", "prefixed", "signed", "base64"):
        assert sum(m.score(w)[0] > m.threshold for w in held[kind]) >= 0.9 * len(held[kind]), kind


@pytest.mark.parametrize("table", ["docs", "odd"])
@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(request, table, digest):
    df = request.getfixturevalue(table)
    rows = df.collect()
    same = collections.defaultdict(list)
    for r in rows:
        same[fold(r.text)].append(r.doc_id)
    want = []
    for r in rows:
        ids = same[fold(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append(str((r.doc_id, keep, len(ids), keep == r.doc_id, *[hashlib.sha256(fold(r.text).encode()).hexdigest()] * digest)))
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_dedup(df, digest=digest).collect()) == sorted(want)


def test_media(docs, odd):
    rows = docs.selectExpr("doc_id + 500 AS doc_id", "text").unionByName(odd.select("doc_id", "text"))
    text = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    same = {}
    for r in media.describe(media.to_media(rows)).collect():
        data = text[r.doc_id] if r.doc_id is not None else b"no id"
        full = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert same.setdefault(data, r[2:]) == r[2:]


def test_png_filters_and_damage():
    r = np.random.default_rng(4)
    raw = r.integers(0, 256, (5, 12), dtype=np.uint8)
    for unit in (1, 3):
        lines, above = [], np.zeros(12, int)
        for y, row in enumerate(raw.astype(int)):
            left = np.concatenate((np.zeros(unit, int), row[:-unit]))
            corner = np.concatenate((np.zeros(unit, int), above[:-unit]))
            p = left + above - corner
            paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            guess = [0, left, above, (left + above) // 2, paeth][y]
            lines.append(np.concatenate(([y], (row - guess) % 256)))
            above = row
        assert (media._unfilter(np.array(lines, np.uint8), unit) == raw).all()
    png = media.encode_png(raw)
    assert (media.decode_png(png)[:, :, 0] == raw).all()
    for at in (0, 20, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-4])


def brute_lines(rows, p):
    """Exact lines only; for tables in which no lines differ in variable fields."""
    mask = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in line.strip(" ").split(" "))
    seen = collections.defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if len(mask(line)) >= p.least:
                seen[mask(line)].add(i)
    return {k for k, v in seen.items() if len(v) >= p.documents}


def test_line_dedup(spark):
    r = np.random.default_rng(6)
    words = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows = []
    for k in range(40):
        own = [words(8), words(9), words(30)]
        if k % 2:
            own.insert(1, f"Page {k} of 99 printed at host{k}")
        if k % 4 == 0:
            own.append(f"Job started by user {words(1)} on the main queue today")
        if k % 5 == 0:
            own.append("All rights reserved by the owner")
        rows.append((k, "\n".join(own)))
    copy = "\n".join(words(12) for _ in range(4))
    rows += [(100 + k, copy) for k in range(30)] + [(200, None), (201, ""), (202, "short\nshort")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_dropped int, _id string")
    out = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert len(out) == len(rows) and set(df.columns) <= set(out[0].__fields__)
    assert sum("Page" in (x.text or "") for x in out.values()) == sum("rights" in (x.text or "") for x in out.values()) == 1
    assert sum("Job started" in (x.text or "") for x in out.values()) == 1  # a general template: the name varies
    assert out[1].text and "Page" in out[1].text and all(out[100 + k].text == copy for k in range(30))
    assert out[200].text is None and out[201].text == "" and out[202].text == "short\nshort"
    for i, t in rows[:40]:
        own = [x for x in t.split("\n") if not x.startswith(("Page", "Job", "All"))]
        assert [x for x in out[i].text.split("\n") if x in own] == own


def brute_templates(rows, p):
    """What stays of each row's text (of each id and text), by the tree's rules with variable fields, where copies are documents."""
    lines, leaves = [], collections.defaultdict(set)
    for i, t in set(rows):
        for at, line in enumerate(re.sub(line_dedup.BLANKS, " ", t or "").split("\n")):
            words = line.strip(" ").split(" ")
            many = len(words) >= p.general
            masked = tuple("<*>" if many and re.search("[0-9]", w) else w for w in words)
            if masked != ("",):
                lines.append((i, t, at, masked))
                if many:
                    leaves[len(masked), masked[: p.depth]].add(masked)
    template = {}
    for leaf, kinds in leaves.items():
        often = collections.Counter((k, w) for m in kinds for k, w in enumerate(m))
        for m in kinds:
            counts = sorted((often[k, w] for k, w in enumerate(m) if often[k, w] > 1), reverse=True)
            needed = max(-int(-p.constant * len(m) // 1), p.depth + 1)
            if len(counts) >= needed:
                fixed = tuple((k, w) for k, w in enumerate(m) if often[k, w] >= counts[needed - 1])
                if any(k >= p.depth and w != "<*>" for k, w in fixed):
                    template[m] = (leaf, fixed)
    places = collections.defaultdict(list)
    for i, t, at, m in lines:
        places[template.get(m, m)].append((i is None, i, at, t))
    gone = set()
    for met in places.values():
        if len({(i, t) for _, i, _, t in met}) >= p.documents:
            gone |= set(met) - {min(met, key=lambda x: (x[0], x[1] or 0, x[2]))}
    return {(i, t): t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i is None, i, at, t) not in gone) for i, t in rows}


def test_line_dedup_where_copies_are_documents(spark, docs, odd):
    """Every recurring template of the query's rule, digits and free fields among them, against brute force; and the odd rows."""
    p = line_dedup.Templates(copies=True)
    names = [f"Job {k} started by user {'abcdefgh'[k % 8] * 3} on the main queue today" for k in range(9)]
    made = spark.createDataFrame([(k, f"own {'xyz'[k % 3] * (k + 1)}\n{n}\ncopy of a line\tthat 12 had") for k, n in enumerate(names)], "doc_id long, text string")
    for df in (docs, odd, made):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = brute_templates(rows, p)
        out = line_dedup.line_dedup(df.selectExpr("*", "text AS _before"), params=p).collect()
        assert len(out) == len(rows) and {(r.doc_id, r._before): r.text for r in out} == want
    assert sum("Job" in t for t in want.values()) == sum("copy of" in t for t in want.values()) == 1


def test_line_dedup_exact_lines(docs):
    p = line_dedup.Templates(distinct=0.0)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    often = brute_lines(rows, p)
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs, params=line_dedup.Templates(distinct=0.0, constant=2.0)).collect()}
    # sketches of copies are equal, so that only lines of different documents go
    for i, t in rows:
        gone = collections.Counter(t.split("\n")) - collections.Counter(out[i].text.split("\n"))
        assert sum(gone.values()) == out[i].n_dropped
        assert all(tuple("<*>" if re.search("[0-9]", w) else w for w in x.strip(" ").split(" ")) in often for x in gone)


def shared_line(n, copies, r, edits=0, own=80):
    """A passage of 60 words in ``n`` different documents and in a group of near copies; and the passage."""
    words = lambda k: ["".join(r.choice(list("abcdefghijklm"), int(r.integers(2, 12)))) for _ in range(k)]
    passage, base, rows = " ".join(words(60)), words(300), []
    for k in range(n):
        rows.append((k, "\n".join([" ".join(words(own)), passage])))
    for k in range(copies):
        text = list(base)
        for at in r.choice(300, edits, replace=False):
            text[at] = words(1)[0]
        rows.append((n + k, "\n".join([*(" ".join(text[i : i + 50]) for i in range(0, 300, 50)), passage])))
    return rows, passage


@pytest.mark.parametrize("n,copies,edits", [(10, 60, 0), (10, 60, 6), (30, 400, 3), (2, 40, 3)])
def test_line_dedup_recall_beside_copies(spark, n, copies, edits):
    """Production parameters: the passage goes wherever different documents have it, and no other line of the copies does."""
    rows, passage = shared_line(n, copies, np.random.default_rng(11), edits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    assert [i for i, t in rows if passage in out[i].split("\n")] == [0]
    assert all(out[i] == "\n".join(x for x in t.split("\n") if x != passage) for i, t in rows if i)


@pytest.mark.parametrize("n", [3, 4, 5])
@pytest.mark.parametrize("own", [4, 15, 40])
def test_line_dedup_recall_in_short_documents(spark, n, own):
    """A passage that is most of each document, in few documents; its copies with a word changed elsewhere are no documents."""
    rows, passage = shared_line(n, 0, np.random.default_rng(n + own), own=own)
    rest = " ".join(f"w{k}" for k in range(40))
    rows += [(100 + k, f"{passage} in copies\n{rest}{'' if k % 2 else ' end'}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    assert [i for i, _ in rows if passage in out[i].split("\n")] == [0]
    assert all(out[i] == t for i, t in rows if i >= 100)


def test_line_dedup_lines_of_few_tokens(spark):
    """Exact lines of 1 to 3 tokens go, digits and all; tabs separate tokens, and white space does not tell lines apart."""
    r = np.random.default_rng(12)
    words = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))
    often = ["Les.", "All rights reserved.", "目录没有空格的一行文字12", "name\tsize\tkind\towner", "see  the\u00a0index of names\r"]
    rows = [(k, "\n".join([words(30), *often, f"Page {k}", "", f"{k}", f"row\t{k}\tof\tall", words(20)])) for k in range(6)]
    rows.append((6, "\n".join([words(30), "name size kind owner", "see the index of names"])))
    out = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[6].text == rows[6][1].split("\n")[0]
    for k in range(1, 6):
        own = rows[k][1].split("\n")
        assert out[k].text.split("\n") == [own[0], f"Page {k}", "", f"{k}", own[-1]] and out[k].n_dropped == 6


def test_line_dedup_templates_among_other_lines(spark):
    """Two templates with a free field in one leaf, among ten times as many other lines of it; lines that share only what leads stay."""
    r = np.random.default_rng(13)
    words = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 7)) for _ in range(n))
    rows = []
    for k in range(12):
        many = [f"This is a {words(7)}" for _ in range(10)]
        rows.append((k, "\n".join([words(30), *many, f"This is a file kept by {words(1)} for the archive", f"This is a copy of {words(1)} sent with all notes", f"This is a {words(1)}"])))
    out = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    for k in range(1, 12):
        own = rows[k][1].split("\n")
        assert out[k].text.split("\n") == [*own[:11], own[13]]


def test_quality(spark, odd):
    big = queries.documents(spark, "/root/testdata/sf0.01")
    out = quality.classify(big).withColumnRenamed("kept", "k").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r.k for r in out if r.quality == 1], [r.k for r in out if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
    rows = {r.doc_id: r for r in quality.classify(odd).collect()}
    assert len(rows) == len({r.doc_id for r in odd.collect()})
    assert rows[0].score == rows[1].score == rows[2].score == 0.0 and not rows[0].kept and rows[3].score == rows[4].score
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality.classify(odd).collect())


def test_quality_sample_is_bounded_and_stable(spark):
    """One id on all rows neither enlarges the sample nor multiplies it; row order and partitions do not matter."""
    p = quality.Quality(sample=20, bits=8)
    rows = [(7, f"the river number {i} flows past a quiet town and its old mill" if i % 3 else f"@@ ## {i} $$ && !! ~~ %% ^^") for i in range(90)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.classify(one, params=p).count() == 90
    least = sorted(t for _, t in rows)[:20]
    same = spark.createDataFrame([(7, t) for t in least], "doc_id long, text string")
    weak = quality.WeakModel(0.5, np.full((2, len(quality.LABELLERS), 3), 1 / 3))
    want = quality.fit_linear([t.encode() for t in least], np.full(20, 0.5), p)
    got = same.selectExpr("cast(text as binary) AS text").coalesce(1).mapInArrow(quality._fitter(p, weak), "weights array<double>").collect()
    assert np.allclose(got[0].weights, want)
    a, b = quality.fit(one, params=p), quality.fit(one.repartition(5), params=p)
    assert np.array_equal(a, b)


def test_expectation_maximisation():
    r = np.random.default_rng(8)
    n, good = len(quality.LABELLERS), r.random(20_000) < 0.8
    accuracy = np.linspace(0.7, 0.95, n)
    right = r.random((20_000, n)) < accuracy
    seen = np.where(r.random((20_000, n)) < 0.3, 0, np.where(right == good[:, None], 2, 1))
    pattern = (seen * 3 ** np.arange(n - 1, -1, -1)).sum(axis=1)
    model = quality.maximise(dict(collections.Counter(pattern.tolist())), 100)
    assert abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(pattern) > 0.5) == good).mean() > 0.97


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    df = request.getfixturevalue(table)
    want = collections.Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first + 1024 * k
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    out = packing.pack(df).collect()
    assert collections.Counter(tuple(r[:5]) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in out) // 1024) * 1.02 + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_capacity(rule):
    r = np.random.default_rng(9)
    histogram = {int(k): int(v) for k, v in zip(r.choice(np.arange(1, 101), 40, replace=False), r.integers(1, 500, 40), strict=True)}
    p = packing.Packing(capacity=100, documents=3, attention=6000, rule=rule)
    histogram = {k: v for k, v in histogram.items() if k * k <= 6000}
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, count, first, offset in packing.plan(histogram, p):
        ranks[length] += range(rank, rank + count)
        for b in range(first, first + count):
            used[b].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for spans in used.values():
        assert len(spans) <= 3 and sum(n for _, n in spans) <= 100 and sum(n * n for _, n in spans) <= 6000
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]


def test_empty_tables(empty):
    frames = [near_dedup.near_dedup(empty), token_counts.token_counts(empty), mixing.mix(empty), pii.redacted(pii.find(empty)), exact_dedup.exact_dedup(empty), exact_dedup.exact_dedup(empty, digest=True)]
    frames += [media.describe(media.to_media(empty)), secrets.find(empty), line_dedup.line_dedup(empty), quality.classify(empty), packing.pack(empty)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark, odd, empty, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    for name, df in (("odd", odd), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        n = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (n > 0) == (name == "odd")


def test_pipeline_stages(spark, docs):
    """Each stage's decisions against its operator's own answer on the same input."""
    import corpus_pipeline

    first = corpus_pipeline.quality_classifier(spark, docs, SF)
    kept = {r.doc_id for r in quality.classify(docs).filter("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    lines = corpus_pipeline.line_templates(spark, first, SF)
    near = corpus_pipeline.near_duplicates(spark, lines, SF)
    want = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5)
    assert sorted(r.doc_id for r in near.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    mixed = corpus_pipeline.mixing_sources(spark, near, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert not compare.differences(queries.queries()[name](spark, SF), queries.ORACLE_SQL[name], compare.connection(SF))
