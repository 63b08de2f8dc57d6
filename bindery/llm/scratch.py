"""Written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only used in local sessions without ``spark.checkpoint.dir``, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/bindery"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. On a cluster without one there is no shared folder to guess: an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
    return LOCAL_DEFAULT


class Scratch:
    """A folder of intermediate Parquet tables: they cut lineage and survive lost executors.

    ``save`` writes a table and returns a frame that reads it; ``drop`` deletes tables that nothing reads any more. What a
    returned frame still reads has to stay until its consumer is done, so the folder's owner deletes it with the checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.written = 0

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/{self.written}"
        self.written += 1
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
