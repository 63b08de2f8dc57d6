"""Token counts of documents in flat, unindexed token files.

A token file is nothing but the ids of one document after the other, each ended by the end-of-document id. The scan gets files as
blocks of bytes that are cut anywhere between ids. In each block one vectorised comparison finds all end ids. A document whose end
is in a block has begun at the last end before it, which may lie any number of blocks back: a prefix maximum and a prefix count
over the blocks' last ends and numbers of ends (a few numbers for each block) stitch them.

Defined results: tokens after a file's last end are a document that is not ended (``ended`` false); two adjacent ends make an empty
document with 0 tokens; an empty file has no documents. For ``documents`` a null or empty text has 0 tokens, and a text that spells the end-of-document token has it as ordinary
ids, so that no text ends a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import encoder, vocabulary_path
from .scratch import Scratch

#: Ids of one block.
BLOCK = 1 << 16
END = 50256
_BLOCKS = "file string, block long, payload binary"


def read_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, payload) of the files below ``path``; Spark reads a file whole, so shards are to stay below 2 GB."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    many = F.ceil(F.col("length") / (block * width)).cast("int")
    cut = files.filter("length > 0").withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    return cut.select("file", F.col("block").cast("long"), F.substring("content", F.col("block") * (block * width) + 1, F.lit(block * width)).alias("payload"))


def _scan(end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ends = [], []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), kind)
                size.append(len(ids))
                ends.append(np.flatnonzero(ids == end))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"]
            )

    return run


def scan(blocks: DataFrame, end: int = END, kind: str = "<u2") -> DataFrame:
    """file, ordinal, start, n_tokens (without the end), ended: one row for each document of each file."""
    found = blocks.select("file", "block", "payload").mapInArrow(_scan(end, kind), "file string, block long, size long, ends array<long>")
    found = Scratch(blocks.sparkSession, "tokens").save(found)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a file's blocks, a few numbers each
    sums = found.select("file", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    sums = sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    sums = sums.withColumn("ordinal0", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("start0", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    is_last = F.lead("block").over(order).isNull()
    sums = sums.withColumn("is_last", is_last)
    met = found.select("file", "block", "ends").join(sums, ["file", "block"])
    absolute = F.transform("ends", lambda e: e + F.col("base"))
    begins = F.concat(F.array("start0"), F.transform(absolute, lambda e: e + 1))
    open_end = F.when(F.col("is_last") & (F.element_at(begins, -1) < F.col("base") + F.col("size")), F.array(F.col("base") + F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    stops = F.concat(absolute, open_end)
    one = met.select("file", "n", "ordinal0", F.posexplode(F.arrays_zip(F.slice(begins, F.lit(1), F.size(stops)).alias("a"), stops.alias("b"))).alias("k", "span"))
    a, b = F.col("span").getField("a"), F.col("span").getField("b")
    return one.select("file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), a.alias("start"), (b - a).alias("n_tokens"), (F.col("k") < F.col("n")).alias("ended"))


def _flatten(path: str, end: int, kind: str, block: int):
    """A file for each partition: tokens in blocks, ids of the documents by ordinal beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        held, size, n, ordinal = [], 0, 0, 0

        def rows(blocks: list[bytes], docs: list[int | None], first: int, number: int) -> pa.RecordBatch:
            none = [None]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*range(first, first + len(blocks)), *none * len(docs)], pa.int64()),
                    pa.array([*blocks, *none * len(docs)], pa.binary()),
                    pa.array([*none * len(blocks), *range(number, number + len(docs))], pa.int64()),
                    pa.array([*none * len(blocks), *docs], pa.int64()),
                ],
                names=["block", "payload", "ordinal", "doc_id"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text in part.column(1):
                    ids = np.array([*encode(text.as_py() or ""), end], kind)
                    held.append(ids)
                    size += len(ids)
                flat = np.concatenate(held)
                whole = size // block
                yield rows([flat[k * block : (k + 1) * block].tobytes() for k in range(whole)], part.column(0).to_pylist(), n, ordinal)
                held, size, n, ordinal = [flat[whole * block :]], size - whole * block, n + whole, ordinal + part.num_rows
        if size:
            yield rows([held[0].tobytes()] if len(held) == 1 else [np.concatenate(held).tobytes()], [], n, ordinal)

    return run


def flatten(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END, kind: str = "<u2", block: int = BLOCK, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Token files of ``df``'s documents as blocks, and the documents' places (file, ordinal, doc_id)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = docs.mapInArrow(_flatten(vocabulary or vocabulary_path(), end, kind, block), "block long, payload binary, ordinal long, doc_id long")
    made = Scratch(df.sparkSession, "flat").save(made.withColumn("file", F.spark_partition_id().cast("string")))
    return made.filter("block is not null").select("file", "block", "payload"), made.filter("ordinal is not null").select("file", "ordinal", "doc_id")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_tokens, file, start: the counts come from the scan of the flat files."""
    blocks, places = flatten(df, id_col, text_col, **how)
    scanned = scan(blocks, how.get("end", END), how.get("kind", "<u2"))
    return places.join(scanned, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
