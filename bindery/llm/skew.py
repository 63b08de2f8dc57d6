"""Joins whose hot keys are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: A key with more than this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001
#: Rows that are never too many for one task, so that small tables have few hot keys.
FEW = 100


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and is repeated for each salt. Rows of one key go to as many
    tasks as there are salts, by ``by``; a grouping by the keys that follows shuffles sums, as the salted partitioning cannot
    serve it."""
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")


def salted_semi(rows: DataFrame, kept: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows whose keys are in ``kept``."""
    return salted_join(rows, kept.select(*keys), keys, by, "left_semi")


def weighted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, weight: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """Join with a ``table`` of one row for each key, whose ``weight`` says how many of the ``total`` rows
    a key has, or nearly so (total: the sum of the weights, if not given). Only hot keys are salted, so that the table is not repeated for
    the others; the set of hot keys is bounded at any size."""
    total = total if total is not None else table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) > max(FEW, HOT_SHARE * total))
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")  # at most 1 / HOT_SHARE keys
    marked = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    salts = F.when(F.col(weight) > max(FEW, HOT_SHARE * total), F.lit(SALTS - 1)).otherwise(0)
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts)))
    return marked.join(many, [*keys, "_salt"], how).drop("_salt")
