"""Best-fit packing of tokenised documents under several capacities at once.

A piece of n tokens uses n tokens, one document and n * n of attention cost. Pieces of equal length are equal for the packer, so
it plans on the histogram of lengths, which has at most ``capacity`` rows at any size of the corpus and holds every piece: longest
first, each length goes to the open kind of bin that leaves the least, by weighted dot-product or by residual norm, among the kinds
in which no capacity is exceeded. Bins with equal contents are one kind with a count, so that the plan has a few rows for each
length. A row says: pieces of this length with ranks from lo go to the bins from b, at this offset. Pieces then take ranks within
their length (in cells of bounded size, so that a length with a third of all pieces is no hot key) and look their bin up.

Ids come from a byte-level vocabulary of ranks and its one added token, which counts as one id wherever a text holds its spelling; it
is the same vocabulary as the JSON file of the tokenizers library, and tests hold the ids against that library's call, which needs
four times the CPU.

With the default capacities only the tokens bind, as no bin of 1024 tokens exceeds 1024 documents or an attention cost of 1024 squared;
the other two capacities then only order bins in which the tokens leave the same.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are packed as rows. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's added token.
ADDED, ADDED_ID = "<|endoftext|>", 50256
CELL_ROWS = 1_000


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a bin; documents and attention: its other capacities (None: as many as fit the tokens); end: the id
    after each document; rule: "norm" or "dot"; weights: of tokens, documents and attention cost in that rule."""

    capacity: int = 1024
    documents: int | None = None
    attention: int | None = None
    end: int = 2
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)

    @property
    def limits(self) -> tuple[int, int, int]:
        return self.capacity, self.documents or self.capacity, self.attention or self.capacity**2


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: ADDED_ID})


def ids_of(path: str):
    """Ids of a text, the added token's spelling as its id."""
    made = encoder(path)
    return lambda text: made.encode(text, allowed_special={ADDED}, disallowed_special=()) if ADDED in text else made.encode_ordinary(text)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenise(p: Packing, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for doc, text in zip(docs, batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), p.end], "<u4")
                first = len(ids) % p.capacity or p.capacity
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), p.capacity)], range(first, len(ids) + 1, p.capacity), strict=True)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b])))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], p: Packing) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first bin, offset): where pieces of each length go."""
    limits, scale = p.limits, [w / c**2 for w, c in zip(p.weights, p.limits, strict=True)]
    kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> runs of equal bins (first, count)
    out, bins = [], 0
    for length in sorted(histogram, reverse=True):
        need, rank, left = (length, 1, length * length), 0, histogram[length]
        if any(n > c for n, c in zip(need, limits, strict=True)):
            raise ValueError(f"a piece of {length} tokens exceeds a bin")
        while left:
            best, score = None, 0.0
            for kind in kinds:
                if all(n <= r for n, r in zip(need, kind, strict=True)):
                    rest = sum(s * (r - n) ** 2 for s, r, n in zip(scale, kind, need, strict=True))
                    now = -rest if p.rule == "norm" else sum(s * r * n for s, r, n in zip(scale, kind, need, strict=True))
                    if best is None or now > score:
                        best, score = kind, now
            if best is None:
                # all that are left of this length open bins of their own, as many to a bin as fit
                fit = min(c // n for c, n in zip(limits, need, strict=True))
                whole, odd = divmod(left, fit)
                for count, each in ((whole, fit), (1 if odd else 0, odd)):
                    if count:
                        for k in range(each):
                            out.append((length, rank, count, bins, k * length))
                            rank += count
                        kinds.setdefault(tuple(c - each * n for c, n in zip(limits, need, strict=True)), []).append((bins, count))
                        bins += count
                break
            first, count = kinds[best].pop()
            if not kinds[best]:
                del kinds[best]
            used = min(left, count)
            out.append((length, rank, used, first, limits[0] - best[0]))
            if used < count:
                kinds.setdefault(best, []).append((first + used, count - used))
            kinds.setdefault(tuple(r - n for r, n in zip(best, need, strict=True)), []).append((first, used))
            rank, left = rank + used, left - used
        # full bins take nothing more
        kinds = {k: v for k, v in kinds.items() if k[0] > 0 and k[1] > 0 and k[2] > 0}
    return out


def assign(spark: SparkSession, pieces: DataFrame, p: Packing) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a column length); pieces must be a written table."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = plan(histogram, p)
    schema = "length long, lo long, many long, bin long, offset long"
    table = F.broadcast(spark.createDataFrame(rows, schema))  # a few rows for each of capacity lengths
    cells = spark.createDataFrame([(k, max(1, -(-n // CELL_ROWS))) for k, n in histogram.items()], "length long, _cells long")
    pieces = pieces.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_cells")))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("length", "_cell").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece")
    rank = F.col("_base") + F.row_number().over(within) - 1
    ranked = pieces.join(sums, ["length", "_cell"]).withColumn("_rank", rank)
    met = ranked.join(table.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("lo") + F.col("many")))
    return met.withColumn("sequence_id", F.col("bin") + F.col("_rank") - F.col("lo")).drop("_length", "_cells", "_cell", "_base", "_rank", "lo", "many", "bin")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Packing = Packing(), vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = Scratch(spark, "pack").save(docs.mapInArrow(_tokenise(params, vocabulary or vocabulary_path()), _PIECES))
    return assign(spark, pieces, params).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
