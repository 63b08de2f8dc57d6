"""First rows, ordinals and upserts: what the collections of a book have in common."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the least by order; a pre-aggregated minimum, so that a key's rows are never sorted together."""
    rest = [c for c in df.columns if c not in keys]
    low = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return low.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ord") -> DataFrame:
    """Positions from 0 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def upserted(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Ordered-map insertion: of rows with equal keys the last one's values stay, at the first one's position."""
    rest = [c for c in df.columns if c not in (*keys, position)]
    out = df.groupBy(*keys).agg(F.min(position).alias(position), F.max_by(F.struct(*rest), position).alias("_row"))
    return out.select(*keys, position, *[F.col("_row")[c].alias(c) for c in rest])


def inserted(df: DataFrame, new: DataFrame, keys: Sequence[str], at: int, position: str = "ord", clamp: bool = True) -> DataFrame:
    """``new`` (its rows numbered from 0 within each key) at a position; where the position lies beyond the end it is the end."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = new.groupBy(*keys).agg(F.count("*").alias("_m"))
    place = F.least(F.lit(at), F.coalesce("_n", F.lit(0))) if clamp else F.lit(at)
    moved = df.join(counts, list(keys), "left").withColumn(position, F.when(F.col(position) >= at, F.col(position) + F.coalesce("_m", F.lit(0))).otherwise(F.col(position)))
    put = new.join(sizes, list(keys), "left").withColumn(position, F.col(position) + place)
    return moved.select(*df.columns).unionByName(put.select(*df.columns))


def retained(df: DataFrame, keep: Column, keys: Sequence[str], position: str = "ord") -> DataFrame:
    """Rows for which ``keep`` holds, numbered anew."""
    return numbered(df.filter(F.coalesce(keep, F.lit(False))), keys, [F.col(position)], position)


def counted(books: DataFrame, df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Number of rows of each book, 0 where it has none."""
    return books.select(key).join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def at(df: DataFrame, position: int | Column, name: str = "ord") -> DataFrame:
    """The row at a position of each book; none where the book ends before it or the position is null."""
    return df.filter(F.col(name) == position)


def backwards(df: DataFrame, keys: Sequence[str], position: str = "ord", name: str = "back") -> DataFrame:
    """Positions counted from the end of each key, from 0: the order of reverse iteration."""
    return numbered(df, keys, [F.col(position).desc()], name)


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows for which ``where`` holds with new values; others, and those where it is null, as they are."""
    rows = df.withColumn("__hit", F.coalesce(where, F.lit(False)))
    return rows.withColumns({k: F.when(F.col("__hit"), v).otherwise(F.col(k)) for k, v in values.items()}).drop("__hit")


def max_suffix(df: DataFrame, keys: Sequence[str], column: str, prefix: str = "") -> DataFrame:
    """The largest number that follows ``prefix`` at the end of an id; null where no id has this form."""
    number = F.regexp_extract(column, ("^" + re.escape(prefix) if prefix else "") + "([0-9]+)$", 1).try_cast("long")
    return df.groupBy(*keys).agg(F.max(number).alias("top"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as bags."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class Levels:
    """Tables of the rounds of a walk, written to the shared folder, so that neither plans nor memory grow with the rounds."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        context = self.spark.sparkContext
        top = self.spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not top and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        top = top or "/tmp/checkpoints/bindery"  # local sessions, as in tests
        self.root, self.paths = f"{top.rstrip('/')}/walk-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.root}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def all(self, df: DataFrame) -> DataFrame:
        """All tables so far, of the schema of ``df``."""
        return self.spark.read.schema(df.schema).parquet(*self.paths)
