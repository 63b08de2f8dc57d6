"""Books as they arrive: the binary source as a stream, decoded batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import epub

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content) of zipped books as they are added below ``path``."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("book_id"), "content")


def ingest(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[epub.Corpus, int], None], **options) -> StreamingQuery:
    """Runs ``sink`` on each batch's tables, once for each batch id; all that is there is read, then the query ends."""
    return (
        arriving(spark, path)
        .writeStream.foreachBatch(lambda batch, number: sink(epub.corpus(batch, **options), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
