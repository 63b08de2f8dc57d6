"""Alignment of two tokenizers over the same bytes, and counts of the id pairs that it links.

Texts of a slice are laid one after the other, so that the ends of all their tokens are two sums of byte lengths; where an A and a B token both end
is a cut, and every text ends at one. Tokens between two cuts are a group, and each of its A tokens is linked with each of its B tokens. Links are made by
repeating, in parts of bounded size; of a group with very many links (a long run of one character, where both
vocabularies keep missing each other) the distinct ids with their numbers stand for all, so that memory follows ids and not links.

A slice of documents keeps each document's distinct pairs as places in the slice's list of pairs, which has the number of its documents
with the pair. These lists are the map-side sums: pairs are added up in two stages, by (pair, salt) and by pair, so that a pair that every
document has is never a hot key, and go back to the slices by an equal join, in which a pair has one row for each slice. A last
co-grouping by slice, bounded as slices are, gives each document its sums. No table of pairs is broadcast or collected.

Defined results: a null or empty text, or one whose A or B tokens do not spell it (it holds U+2581, say), has zeros and an empty digest. Spellings of
special tokens are plain text. Repeated rows count as documents of their own, a null id is an id. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .packing import vocabulary_path
from .scratch import Scratch

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A pair is the A id and, in the low bits, the B id.
LOW = 24


@dataclass(frozen=True)
class CrossTokens:
    """pairs: a slice ends at so many (document, pair); links: made at once; heavy: links of a group from which ids are counted
    first; salts: of a pair in the first sum."""

    pairs: int = 400_000
    links: int = 2_000_000
    heavy: int = 4_096
    salts: int = 8


class Side:
    """A vocabulary: ids of texts, and of each id its bytes, their number, and its decimal form with a free place after it."""

    def __init__(self, encode, spelled: list[bytes]) -> None:
        self.encode, self.spelled = encode, spelled
        self.size = np.array([len(x) for x in spelled], np.int64)
        shown = np.array([str(i) for i in range(len(spelled))], "S")
        self.digits = np.char.str_len(shown).astype(np.int64)
        self.shown = np.zeros((len(spelled), shown.dtype.itemsize + 1), np.uint8)
        self.shown[:, :-1] = shown.view(np.uint8).reshape(len(spelled), -1)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


@cache
def sides(ranks: str, pieces: str) -> tuple[Side, Side]:
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    spelled = [b""] * (max(known.values()) + 1)
    for data, i in known.items():
        spelled[i] = data
    second = sentencepiece.SentencePieceProcessor(model_file=pieces)
    shown = [second.id_to_piece(i) for i in range(second.get_piece_size())]
    as_bytes = [b"" if second.is_control(i) or second.is_unknown(i) else bytes([int(x[1:-1], 16)]) if second.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(shown)]
    return Side(lambda text: first.encode_ordinary(" " + text), spelled), Side(lambda text: second.encode(text, num_threads=1), as_bytes)


def _tokens(side: Side, texts: list[bytes]) -> list[list[int]]:
    """Ids of each text, none where they do not spell it."""
    out = []
    for data in texts:
        ids = side.encode(data.decode()) if data else []
        out.append(ids if ids and side.spell(ids) == b" " + data else [])
    return out


@dataclass
class Aligned:
    """Ids, group and text of each token of both sides; tokens of each group on both sides; the text of each group."""

    ids: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    many: tuple[np.ndarray, np.ndarray]
    text_of: np.ndarray


def align(a: Side, b: Side, texts: list[bytes]) -> tuple[Aligned, np.ndarray, np.ndarray]:
    """The groups of all texts, and each text's numbers of A and B tokens."""
    lists = [_tokens(a, texts), _tokens(b, texts)]
    lists = [[x if x and y else [] for x, y in zip(p, q, strict=True)] for p, q in (lists, lists[::-1])]
    ids = [np.fromiter((i for x in part for i in x), np.int64, sum(map(len, part))) for part in lists]
    n = [np.array([len(x) for x in part], np.int64) for part in lists]
    ends = [np.cumsum(side.size[x]) for side, x in zip((a, b), ids, strict=True)]
    cuts = np.intersect1d(*ends, assume_unique=True)
    group = [np.searchsorted(cuts, e) for e in ends]
    many = [np.bincount(g, minlength=len(cuts)) for g in group]
    owner = np.repeat(np.arange(len(texts)), n[0])
    text_of = np.empty(len(cuts), np.int64)
    text_of[group[0]] = owner  # every group has a token of either side
    return Aligned(tuple(ids), tuple(group), tuple(many), text_of), n[0], n[1]


def _expanded(ga: np.ndarray, a: np.ndarray, ma: np.ndarray, gb: np.ndarray, b: np.ndarray, mb: np.ndarray, text_of: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, links) of all combinations within groups; ``ga`` and ``gb`` rise, and ``ma`` and ``mb`` say how often an id is there."""
    many = np.bincount(gb, minlength=len(text_of))
    first = np.cumsum(many) - many
    each = many[ga]
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(np.cumsum(each[at:]), most, side="right")) + at)
        rep = each[at:to]
        left = np.repeat(np.arange(at, to), rep)
        right = np.arange(len(left)) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(first[ga[at:to]], rep)
        yield text_of[ga[left]], a[left] << LOW | b[right], ma[left] * mb[right]
        at = to


def _merged(text: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each (text, pair), by text."""
    order = np.lexsort((pair, text))
    text, pair, links = text[order], pair[order], links[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))) if len(text) else np.zeros(0, np.int64)
    return text[new], pair[new], np.add.reduceat(links, new) if len(new) else links


def links(x: Aligned, p: CrossTokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) with the number of its links."""
    heavy = x.many[0] * x.many[1] > p.heavy
    out = []
    for which in (False, True):
        if which and not heavy.any():
            continue
        sides_ = []
        for group, ids in zip(x.group, x.ids, strict=True):
            keep = heavy[group] == which
            g, i = group[keep], ids[keep]
            m = np.ones(len(g), np.int64)
            if which:
                g, i, m = _merged(g, i, m)
            sides_ += [g, i, m]
        out += [_merged(*part) for part in _expanded(*sides_, x.text_of, p.links)]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return _merged(*(np.concatenate(c) for c in zip(*out, strict=True))) if len(out) > 1 else out[0]


def shown(a: Side, b: Side, x: Aligned, texts: int) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    total = len(x.ids[0]) + len(x.ids[1])
    wide = max(a.shown.shape[1], b.shown.shape[1])
    before = [np.concatenate(([0], np.cumsum(m))) for m in x.many]
    table, size, owner = np.zeros((total, wide), np.uint8), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for k, side in enumerate((a, b)):
        g = x.group[k]
        place = np.arange(len(g)) + (before[1][g] if k == 0 else before[0][g + 1])  # those of the other side that stand before it
        rows, digits = side.shown[x.ids[k]], side.digits[x.ids[k]]
        last = np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.zeros(0, bool)
        rows[np.arange(len(g)), digits] = np.where(last, ord("|" if k == 0 else ";"), ord(","))
        table[place, : rows.shape[1]], size[place], owner[place] = rows, digits + 1, x.text_of[g]
    data = table[np.arange(wide) < size[:, None]].tobytes()
    ends = np.cumsum(np.bincount(owner, weights=size, minlength=texts)).astype(np.int64)
    return [data[s : max(s, e - 1)] for s, e in zip([0, *ends[:-1]], ends, strict=True)]  # without the last separator


_MADE = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, place binary, links binary, at int, a int, b int, docs long"


def _slices(p: CrossTokens, ranks: str, pieces: str, keep: bool):
    """Rows of two kinds: documents with their places in the slice's list of pairs, and that list."""
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.int32()] * 3 + [pa.int64()]
    names = [c.split()[0] for c in _MADE.split(", ")]

    def batch(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = sides(ranks, pieces)
        number, docs, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pair, place, many = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True, return_counts=True)
            weight, text = np.concatenate([h[2] for h in held]), np.concatenate([h[0] for h in held])
            cuts = np.searchsorted(text, np.arange(len(docs) + 1))
            place, weight = place.astype("<i4"), weight.astype("<i8")
            spans = list(zip(cuts, cuts[1:], strict=False))
            for at in range(0, len(docs), 512):
                own = docs[at : at + 512]
                columns = dict(zip(names[1:8], zip(*own, strict=True), strict=True))
                yield batch(slice=[number] * len(own), **columns, place=[place[s:e].tobytes() for s, e in spans[at : at + 512]], links=[weight[s:e].tobytes() for s, e in spans[at : at + 512]])
            for at in range(0, len(pair), 65536):
                own = pair[at : at + 65536]
                yield batch(slice=np.full(len(own), number), at=np.arange(at, at + len(own)), a=own >> LOW, b=own & ((1 << LOW) - 1), docs=many[at : at + 65536])

        for part in batches:
            for first, texts in slices(part.column(1)):
                x, n_a, n_b = align(a, b, texts)
                text, pair, weight = links(x, p)
                groups = np.bincount(x.text_of, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, x.text_of, x.many[0] * x.many[1])
                ids = part.column(0).slice(first, len(texts)).to_pylist()
                for k, data in enumerate(shown(a, b, x, len(texts))):
                    docs.append((ids[k], int(n_a[k]), int(n_b[k]), int(groups[k]), int(total[k]), hashlib.sha256(data).hexdigest() if n_a[k] else "", data.decode() if keep else None))
                held.append((text + (len(docs) - len(texts)), pair, weight))
                size += len(pair)
                if size >= p.pairs or len(docs) >= 1 << 16:
                    yield from flush()
                    number, docs, held, size = number + 1, [], [], 0
        if docs:
            yield from flush()

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a slice with the sums of its pairs' counts over their links."""
    order = np.argsort(pairs.column("at").to_numpy())
    count = pairs.column("n").to_numpy()[order]
    best = pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_best, count_sum = [], []
    for place, weight in zip(docs.column("place"), docs.column("links"), strict=True):
        at, m = np.frombuffer(place.as_buffer(), "<i4"), np.frombuffer(weight.as_buffer(), "<i8")
        n_best.append(int(best[at] @ m))
        count_sum.append(int(count[at] @ m))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256")).append_column("groups", docs.column("groups"))


def pair_counts(lists: DataFrame, salts: int) -> DataFrame:
    """a, b, n (documents with the pair linked), best (no pair of the A id has more) from the slices' lists."""
    salt = F.pmod(F.xxhash64("slice"), F.lit(salts)).alias("salt")
    part = lists.groupBy("a", "b", salt).agg(F.sum("docs").alias("n"))
    whole = part.groupBy("a", "b").agg(F.sum("n").alias("n"))
    # an A id has at most as many pairs as the B vocabulary has ids
    return whole.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def cross_align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: CrossTokens = CrossTokens(), ranks: str | None = None, pieces: str | None = None, groups: bool = False
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``df``; ``groups``: with the groups themselves."""
    spark, p = df.sparkSession, params
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scratch = Scratch(spark, "cross")
    made = scratch.save(docs.mapInArrow(_slices(p, ranks or vocabulary_path(RANKS), pieces or vocabulary_path(PIECES), groups), _MADE), compression="zstd")
    lists = made.filter("at is not null").select("slice", "at", "a", "b", "docs")
    counts = scratch.save(pair_counts(lists, p.salts))
    answers = lists.join(counts.hint("merge"), ["a", "b"]).select("slice", "at", "n", "best")
    rows = made.filter("at is null").select(F.col("slice").alias("own"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "place", "links")
    out = rows.groupBy("own").cogroup(answers.groupBy("slice")).applyInArrow(_summed, _OUT)
    return out if groups else out.drop("groups")
