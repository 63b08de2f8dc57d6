"""A library that follows a folder of books: new, changed and vanished files, each taken over once.

Each run compares the folder's listing (path and time of modification; contents are not read for it) with the versions that are known and
decodes only what differs. A run writes decoded books and resources first and the versions last, under its number; versions whose
write is complete make the run valid. A run that was stopped leaves rows that nobody sees, and the next one has the same number and replaces
them. Readers join the written tables with each book's latest version.

Defined results: a file with any other time of modification than the known one counts as changed, an older one too; a file that changes while
it is read waits for the next run; damaged books are rows with an error, as everywhere; an empty folder is an empty library.
One run at a time may write to a library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import epub

_VERSIONS = "book_id string, modified timestamp, gone boolean"


@dataclass(frozen=True)
class Library:
    spark: SparkSession
    root: str

    def runs(self) -> list[int]:
        """Numbers of the valid runs."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/run=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().removeprefix("run=")) for f in found or [])

    def _read(self, name: str, schema: str) -> DataFrame:
        schema, runs = f"{schema}, run int", self.runs()
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/run={k}" for k in runs])

    def _write(self, df: DataFrame, name: str, run: int) -> DataFrame:
        path = f"{self.root}/{name}/run={run}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def versions(self) -> DataFrame:
        """(book_id, modified, run) of the books that are there."""
        latest = self._read("versions", _VERSIONS).groupBy("book_id").agg(F.max_by(F.struct("modified", "gone"), "run").alias("_v"), F.max("run").alias("run"))
        return latest.filter("not _v.gone").select("book_id", "_v.modified", "run")

    def refresh(self, path: str, **options) -> int | None:
        """Takes over what differs below ``path``; the run's number, or None if nothing does. Options as of epub.corpus."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
        files = files.select(F.col("path").alias("book_id"), F.col("modificationTime").alias("modified"), "content")
        listed, known = files.drop("content"), self.versions().drop("run")
        changed = listed.join(known, ["book_id", "modified"], "left_anti")
        gone = known.join(listed, "book_id", "left_anti").select("book_id", F.lit(None).cast("timestamp").alias("modified"), F.lit(True).alias("gone"))
        least, n = changed.agg(F.min("modified"), F.count("*")).first()
        if not n and gone.isEmpty():
            return None
        run = max(self.runs(), default=-1) + 1
        changed = self._write(changed, "changed", run)
        # files before the first change are not read: the filter reaches the source
        fresh = files.filter(F.col("modified") >= F.lit(least)) if n else files.limit(0)
        archives = fresh.join(changed, ["book_id", "modified"], "left_semi").select("book_id", "content")
        parsed = self._write(epub.parse(archives, **options), "parsed", run)
        self._write(epub.unzip(archives), "resources", run)
        taken = changed.join(parsed.select("book_id"), "book_id", "left_semi").withColumn("gone", F.lit(False))
        self._write(taken.unionByName(gone), "versions", run)
        return run

    def corpus(self) -> epub.Corpus:
        """The tables of the books as they are now."""
        now = self.versions().select("book_id", "run")
        parsed = self._read("parsed", epub.PARSED).join(now, ["book_id", "run"], "left_semi").drop("run")
        resources = self._read("resources", "book_id string, path string, content binary").join(now, ["book_id", "run"], "left_semi").drop("run")
        return epub.Corpus(parsed.select("book_id", "error"), *[epub.table(parsed, n) for n in epub.SCHEMAS], resources)
