"""Minimum-bin-slack packing of tokenised documents into training windows.

Documents are cut into pieces of the window's length, the last piece being the rest. Pieces of equal length are equal for the packer, so
it plans on the histogram of lengths, which has at most ``capacity`` rows at any size of the corpus and holds every piece. A window takes the
longest piece left and then the multiset of lengths, out of all that are left, whose sum comes closest to the room: a subset-sum dynamic
programme over a bitset of reachable sums (one shift for each power of two of a length's count), which stops once the room is
met exactly and is walked backwards for the counts. The multiset is used for as many windows as the counts allow. Where some room stays, no piece left is as
short as it; a piece is cut to fill it. What is left at the very end is cut into windows of powers of two, which need no padding.

Pieces take ranks within their length, in cells of bounded size, so that a length with a third of all pieces is no hot key, and look their
places up in the plan. Only lengths, ids and checksums are shuffled for that; tokens stay in the written table of pieces, which the
pieces that were cut read again by their keys.

Ids are those of the tokenizers library's call with its default settings, in which a text that spells a special token has that token.
The vocabulary ignores white space, so that runs of other characters have the same ids wherever they stand: each worker keeps the
ids of the runs it has met (about ``KNOWN``) and asks the library for new words only.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as rows, a null id is an id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import U, slices, word_hashes
from .packing import vocabulary_path
from .scratch import Scratch

VOCABULARY = "word_bpe_49k.json"
#: Runs and words whose ids a worker keeps; words longer than LONG are not kept.
KNOWN, LONG = 1 << 18, 64
#: Visible ASCII and Latin letters that no normalisation but lower case changes (so not the capital I with a dot).
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile(f"[!-~{LATIN}]+")
#: Fixed value: the vocabulary's words, of plain runs in lower case.
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}\\n]+|\\n")
#: Rows of one (length, cell).
CELL_ROWS = 1_000
#: Largest tables that are sent to every task; larger ones are joined by a shuffle.
FEW_ROWS = 50_000


@dataclass(frozen=True)
class BinSlack:
    """capacity: tokens of a window; end: the id after each document; cut: fill what room stays by cutting pieces."""

    capacity: int = 2048
    end: int = 1
    cut: bool = True


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible bytes themselves, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(seen)))}


class Encoder:
    """Ids of texts by the ids of their runs of characters other than ASCII white space, and of the words of these runs. Runs are told
    apart by 64-bit hashes.

    The library's own parts do the work: its model makes the ids of each new word, and its normaliser and pre-tokenizer find the words of
    runs that are not plain. A run that spells a special token is given to its whole call."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.words: dict[str, list[int]] = {"\n": [-1]}
        self._hold(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)

    def _hold(self, keys: np.ndarray, first: np.ndarray, many: np.ndarray, met: np.ndarray, ids: np.ndarray) -> None:
        """The runs kept: hashes in order, places of their ids, how often they were met."""
        self.keys, self.first, self.many, self.met, self.ids = keys, first, many, met, ids

    def _trim(self) -> None:
        """Only what was met again stays; nothing, if that is most of it."""
        if len(self.words) > KNOWN:
            self.words = {"\n": [-1]}
        if len(self.keys) > KNOWN:
            keep = np.flatnonzero(self.met > 1)
            keep = keep if len(keep) <= KNOWN // 2 else keep[:0]
            many = self.many[keep]
            ids = self.ids[np.repeat(self.first[keep] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            self._hold(self.keys[keep], np.cumsum(many) - many, many, self.met[keep] * 0, ids)

    def _ids(self, word: str) -> list[int]:
        if word[0] == "\n":
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, keys: np.ndarray, runs: list[str]) -> None:
        """Keeps the ids of new runs. A new line stands after each run's words, as no word has one."""
        known = [PLAIN.fullmatch(r) is not None for r in runs]
        joined = "\n".join([*runs, ""])
        if self.marks.search(joined) or not all(known):
            flat: list[str] = []
            for run, plain in zip(runs, known, strict=True):
                if self.marks.search(run):
                    flat.append(f"\n{run}")
                elif plain:
                    flat += WORDS.findall(run.lower())
                else:  # their words are in the letters of bytes already
                    shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run))
                    flat += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in shown]
                flat.append("\n")
        else:
            flat = WORDS.findall(joined.lower())
        new = set(flat).difference(self.words)
        for word in new:
            self.words[word] = self._ids(word)
        ids = np.fromiter(chain.from_iterable(map(self.words.__getitem__, flat)), np.int64)
        for word in new:
            if len(word) > LONG:
                del self.words[word]
        stops = np.flatnonzero(ids < 0) - np.arange(len(runs))
        many = np.diff(np.concatenate(([0], stops)))
        first = np.concatenate((self.first, len(self.ids) + stops - many))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        met = np.concatenate((self.met, np.zeros(len(runs), np.int64)))
        self._hold(keys[order], first[order], np.concatenate((self.many, many))[order], met[order], np.concatenate((self.ids, ids[ids >= 0])))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        self._trim()
        data = b"\n".join([*texts, b""])
        hashes, start, end = word_hashes(np.frombuffer(data, np.uint8))
        long = np.flatnonzero(end - start > LONG)
        hashes[long] = [xxhash.xxh64_intdigest(data[start[k] : end[k]]) for k in long]
        key, one, run = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        new = np.flatnonzero((at == len(self.keys)) | (np.append(self.keys, U(0))[at] != key))
        if len(new):
            self._learn(key[new], [data[s:e].decode() for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, key)
        self.met[at] += np.bincount(run, minlength=len(key))
        at = at[run]
        many = self.many[at]
        before = np.concatenate(([0], np.cumsum(many)))
        out = self.ids[np.repeat(self.first[at] - before[:-1], many) + np.arange(before[-1])]
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))
        return out, np.diff(np.concatenate(([0], before[ends])))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"


def _tokenise(p: BinSlack, path: str):
    """Pieces of each document; ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, sizes = encoder(path).encode(texts)
                ids, stops = ids.astype("<u4"), np.cumsum(sizes)
                docs, out = batch.column(0).slice(first, len(texts)).to_pylist(), []
                for doc, a, b in zip(docs, stops - sizes, stops, strict=True):
                    own = np.append(ids[a:b], np.uint32(p.end)).astype("<u4")
                    for start in range(0, len(own), p.capacity):
                        data = own[start : start + p.capacity].tobytes()
                        out.append((doc, start, len(data) // 4, len(own), zlib.crc32(data), data))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return run


def closest(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of a multiset out of ``counts``, and how often each length is in it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return best, used


@dataclass(frozen=True)
class Run:
    """Pieces of one original length with consecutive ranks, their parts placed so far (start, length, first window, offset)."""

    length: int
    lo: int
    count: int
    parts: tuple[tuple[int, int, int, int], ...] = ()

    def split(self, count: int) -> tuple[Run, Run]:
        later = tuple((s, n, w + count, o) for s, n, w, o in self.parts)
        return Run(self.length, self.lo, count, self.parts), Run(self.length, self.lo + count, self.count - count, later)

    def placed(self, length: int, window: int, offset: int) -> Run:
        start = sum(n for _, n, _, _ in self.parts)
        return Run(self.length, self.lo, self.count, (*self.parts, (start, length, window, offset)))


def plan(histogram: dict[int, int], p: BinSlack) -> list[Run]:
    """Every piece of every length with its places; a run's k-th piece goes to the k-th window after each part's first."""
    left = dict(histogram)
    runs: dict[int, list[Run]] = {n: [Run(n, 0, c)] for n, c in histogram.items()}
    done: list[Run] = []
    window = 0

    def take(length: int, count: int) -> Iterator[Run]:
        left[length] -= count
        if not left[length]:
            del left[length]
        while count:
            run = runs[length].pop()
            if run.count > count:
                run, rest = run.split(count)
                runs[length].append(rest)
            count -= run.count
            yield run

    def put(length: int, times: int, part: int, offset: int, windows: int) -> None:
        """``times`` pieces in each of the windows, of each the first ``part`` tokens; what is cut off stays to be placed."""
        for t in range(times):
            first = window
            for run in list(take(length, windows)):
                run = run.placed(part, first, offset + t * part)
                first += run.count
                if part == length:
                    done.append(run)
                else:
                    left[length - part] = left.get(length - part, 0) + run.count
                    runs.setdefault(length - part, []).append(run)

    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if n != longest or c > 1}
        best, used = closest(rest, p.capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        room = p.capacity - longest - best
        donor = max((n for n, c in left.items() if n > room and c > used.get(n, 0)), default=None) if room and p.cut else None
        need = used | ({donor: used.get(donor, 0) + 1} if donor else {})
        windows = min(left[n] // k for n, k in need.items())
        if room and p.cut and donor is None:
            break  # the last window: all that is left is in it
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            put(n, k, n, offset, windows)
            offset += n * k
        if donor:
            put(donor, 1, room, offset, windows)
        window += windows
    # powers of two, the largest first
    total, filled, size = sum(n * c for n, c in left.items()), 0, 0
    while left:
        if filled == size:
            window, total = window + (size > 0), total - size
            size, filled = 1 << (total.bit_length() - 1), 0
        longest = max(left)
        part = min(longest, size - filled)
        put(longest, 1, part, filled, 1)
        filled += part
    return done


def place(pieces: DataFrame, p: BinSlack) -> DataFrame:
    """``pieces`` (a written table with a column ``length``; other columns stay) as parts with part_start, part_length, sequence_id
    and offset: a piece that is cut has several."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = [(r.length, r.lo, r.lo + r.count, list(r.parts)) for r in plan(histogram, p)]
    kind = "array<struct<start: long, length: long, window: long, offset: long>>"
    table = spark.createDataFrame(rows, f"_length long, _lo long, _hi long, _parts {kind}")
    cells = spark.createDataFrame([(k, max(1, -(-n // CELL_ROWS))) for k, n in histogram.items()], "length long, _cells long")
    rows_ = pieces.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64("_key"), F.col("_cells")))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows_.groupBy("length", "_cell").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_cell").orderBy("_key")
    ranked = rows_.join(sums, ["length", "_cell"]).withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)
    table = F.broadcast(table) if len(rows) <= FEW_ROWS else table.hint("merge")
    met = ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    one = met.withColumn("_part", F.explode("_parts"))
    out = one.withColumn("part_start", F.col("_part.start")).withColumn("part_length", F.col("_part.length"))
    out = out.withColumn("sequence_id", F.col("_part.window") + F.col("_rank") - F.col("_lo")).withColumn("offset", F.col("_part.offset"))
    return out.drop("_cells", "_cell", "_base", "_rank", "_length", "_lo", "_hi", "_parts", "_part")


def with_ids(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Parts with their own ids, by the key of the piece they are of."""
    met = parts.join(pieces.select("_key", "ids"), "_key")
    return met.withColumn("ids", F.substring("ids", F.col("part_start") * 4 + 1, F.col("part_length") * 4))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: BinSlack = BinSlack(), vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of ``df``; ``ids``: with the
    tokens as little-endian 32-bit numbers, for which they are shuffled."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = docs.mapInArrow(_tokenise(params, vocabulary or vocabulary_path(VOCABULARY)), _PIECES)
    pieces = Scratch(spark, "slack").save(made.withColumn("_key", F.monotonically_increasing_id()), compression="zstd")
    parts = place(pieces.drop("ids"), params)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    moved = {"start": F.col("start") + F.col("part_start"), "length": F.col("part_length")}
    if ids:
        return with_ids(parts, pieces).withColumns(moved | {"ids_crc32": F.crc32("ids")}).select(*names, "ids")
    parts = Scratch(spark, "slack").save(parts)
    whole, cut = parts.filter("part_length = length"), parts.filter("part_length < length")
    many = cut.count()
    again = with_ids(F.broadcast(cut) if many <= FEW_ROWS else cut, pieces)
    return whole.withColumns(moved).select(*names).unionByName(again.withColumns(moved | {"ids_crc32": F.crc32("ids")}).select(*names))
