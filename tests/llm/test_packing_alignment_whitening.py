"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bindery.llm import bin_slack, cross_tokens, queries, whitening
from bindery.llm.packing import vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "a", "x" * 50000, "It's DON'T ''s a<|endoftext|>b <|startoftext|>", "▁ piece", "É é İ Σς 　日本語 🙂\x1c\x00", "a\n\n\n  b\t\r\n", "=" * 3000, "<0x41> <s> </s> <unk>"]


def odd_table(spark):
    rows = [(k if k != 3 else None, t, "z", 1) for k, t in enumerate(ODD)] + [(7, "twice", "z", 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, length string, _key int")


# 11


def _windows(runs, capacity):
    """Windows with their totals; every piece is covered once, without gaps."""
    seen, spans = Counter(), defaultdict(list)
    for r in runs:
        assert [s for s, *_ in r.parts] == list(np.cumsum([0] + [n for _, n, _, _ in r.parts])[:-1]) and sum(n for _, n, _, _ in r.parts) == r.length
        for k in range(r.count):
            seen[r.length, r.lo + k] += 1
            for _, n, w, o in r.parts:
                spans[w + k].append((o, n))
    assert set(seen.values()) <= {1} and sorted(spans) == list(range(len(spans)))
    totals = []
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
        totals.append(at)
    return Counter(n for n, _ in seen), totals


def _subset_best(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    return max(sums)


def test_closest_multiset_is_the_best_one():
    rng = random.Random(5)
    for _ in range(300):
        counts, room = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 12))), rng.randint(0, 60)
        best, used = bin_slack.closest(counts, room)
        assert best == sum(n * k for n, k in used.items()) == _subset_best(counts, room)
        assert all(k <= counts[n] for n, k in used.items())


def test_plans_cover_all_pieces_and_leave_no_padding():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice((7, 16, 33, 64, 2048))
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 80)))
        seen, totals = _windows(bin_slack.plan(dict(counts), bin_slack.BinSlack(capacity)), capacity)
        assert seen == counts and all(t == capacity or t & (t - 1) == 0 for t in totals)
        assert sum(t != capacity for t in totals) <= capacity.bit_length()
        seen, totals = _windows(bin_slack.plan(dict(counts), bin_slack.BinSlack(capacity, cut=False)), capacity)
        assert seen == counts


def test_plan_is_small_for_many_pieces():
    counts = {n: 10**9 // n for n in range(1, 2049)}
    assert len(bin_slack.plan(counts, bin_slack.BinSlack())) < bin_slack.FEW_ROWS


def _packed_right(rows, texts, capacity=2048, end=1):
    tokenizer, spans, by = bin_slack.encoder(vocabulary_path(bin_slack.VOCABULARY)).tokenizer, defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == capacity or at & (at - 1) == 0
    want = defaultdict(Counter)
    for doc, text in texts:
        want[doc][tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, end])] += 1
    for doc, lists in want.items():
        if sum(lists.values()) == 1:
            (ids,), at = lists, 0
            for start, n, crc, total in sorted(by[doc]):
                assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + n], "<u4"))
                at += n
            assert at == len(ids)
        else:
            assert sum(n for _, n, _, _ in by[doc]) == sum(len(ids) * k for ids, k in lists.items())


def test_op11_query(spark):
    df = queries.documents(spark, SF)
    _packed_right(queries.op11_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in df.collect()])


def test_op11_odd_and_empty(spark):
    df = odd_table(spark)
    rows = bin_slack.pack(df, ids=True).collect()
    _packed_right(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    small = bin_slack.BinSlack(capacity=16)
    _packed_right(bin_slack.pack(df, params=small).collect(), [(r.doc_id, r.text) for r in df.collect()], 16)
    assert bin_slack.pack(df.limit(0)).count() == 0


def test_op11_encoder_forgets(monkeypatch):
    monkeypatch.setattr(bin_slack, "KNOWN", 50)
    e = bin_slack.Encoder(vocabulary_path(bin_slack.VOCABULARY))
    rng = random.Random(8)
    pool = "abcXYZ'sSdm019.,!-<|>éÉßİIıſ×÷ΣσЖ中🙂 \t\n\x1c\x1f\x7f\x85'lL're…½"
    for _ in range(60):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(8)] + ["the same words the <|endoftext|>"]
        ids, n = e.encode([t.encode() for t in texts])
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# 12


def _aligned(texts):
    a, b = cross_tokens.sides(vocabulary_path(cross_tokens.RANKS), vocabulary_path(cross_tokens.PIECES))
    docs = []
    for text in texts:
        ia, ib = (side.encode(text) if text else [] for side in (a, b))
        whole = f" {text}".encode()
        if not text or a.spell(ia) != whole or b.spell(ib) != whole:
            docs.append(([], [], []))
            continue
        cut = lambda side, ids: np.cumsum([len(side.spelled[i]) for i in ids]).tolist()
        ea, eb = cut(a, ia), cut(b, ib)
        groups, i, j = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            ga, gb = [], []
            while i < len(ia) and ea[i] <= c:
                ga.append(ia[i])
                i += 1
            while j < len(ib) and eb[j] <= c:
                gb.append(ib[j])
                j += 1
            groups.append((ga, gb))
        docs.append((ia, ib, groups))
    count, top = Counter(), defaultdict(int)
    for _, _, groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for ia, ib, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if ia else "", shown))
    return out


def test_op12_query(spark):
    docs = queries.documents(spark, SF).collect()
    want = sorted((r.doc_id, *x[:-1]) for r, x in zip(docs, _aligned([r.text for r in docs]), strict=True))
    assert sorted(map(tuple, queries.op12_alignment(spark, SF).collect())) == want


@pytest.mark.parametrize("params", [cross_tokens.CrossTokens(), cross_tokens.CrossTokens(pairs=20, links=7, heavy=2, salts=2)])
def test_op12_odd_and_empty(spark, params):
    df = odd_table(spark)
    rows = df.collect()
    key = lambda r: (r[0] is None, r)
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, _aligned([r.text for r in rows]), strict=True)), key=key)
    got = sorted((tuple(r) for r in cross_tokens.cross_align(df, params=params, groups=True).collect()), key=key)
    assert [(*g[:-1], g[-1] or "") for g in got] == want
    assert cross_tokens.cross_align(df.limit(0), params=params).count() == 0


def test_op12_a_heavy_group_counts_all_its_links():
    """Ten thousand tokens against as many in one group: no link is made one by one."""
    n = 10_000
    group = np.zeros(n, np.int64)
    x = cross_tokens.Aligned((np.arange(n) % 3, np.arange(n) % 2), (group, group), (np.array([n]), np.array([n])), np.zeros(1, np.int64))
    text, pair, many = cross_tokens.links(x, cross_tokens.CrossTokens())
    assert len(pair) == 6 and many.sum() == n * n and set(text) == {0}


# 13


def _whitened_right(rows, vectors, kept=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, d = x.shape
    v = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    e = np.linalg.eigvalsh(v)[::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == n * min(kept, d)
    w = np.array([[by[i, k + 1].whitened for k in range(min(kept, d))] for i in range(n)])
    # w = (x - mean) u / sqrt(e): u from it by least squares must be a unit eigenvector
    u = np.linalg.lstsq(x - x.mean(0), w * np.sqrt(e[: w.shape[1]]), rcond=None)[0]
    assert np.allclose(np.linalg.norm(u, axis=0), 1, atol=1e-9) and np.allclose(v @ u, u * e[: w.shape[1]], rtol=1e-7, atol=1e-6 * e[0])
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-9
    sums = [int(s) for s in x.sum(0)]
    for i in range(n):
        r = by[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True)) and r.identity_error < 1e-9
        assert all(abs(by[i, k + 1].explained - e[k] / np.trace(v)) < 1e-12 for k in range(min(kept, d)))


def test_op13_query(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    _whitened_right(queries.op13_whitening(spark, SF).collect(), vectors)


def test_op13_odd_and_empty(spark):
    kind = "vec_id long, embedding array<float>, d int, x string"
    rng = np.random.default_rng(4)
    good = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 1, "y") for k, v in enumerate(good + bad)], kind)
    _whitened_right(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id >= 40 and vec_id < 45")).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1, "y")] * 3, kind)).collect()
    assert len(same) == 6 and {(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(None, 3, 0, None, 0.0, 0.0)}
    huge = whitening.whiten(spark.createDataFrame([(0, [3e38, 1.0], 1, "y"), (1, [-3e38, 2.0], 1, "y")], kind)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(0, None), (1, None)} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge if r.component == 1)
