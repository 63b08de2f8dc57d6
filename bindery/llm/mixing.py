"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies: its source's target over its source's size. In each source the expected copies
are prefix-summed, one random offset is added, and a document is emitted once for each integer boundary that its interval
crosses. Sums are of fixed-point integers, so that intervals join exactly and reruns agree.

The order within a source is by size, so that the words taken stay near the target. The prefix sum has three levels: sources are
cut into classes of size (powers of two), classes into cells of bounded row counts, and only a cell is ever sorted in one task;
cells are summed before they are shuffled, so that a source with a third of all rows is no hot key.

Defined results: a null text has size 0; a null source is a source, the last one; a source of size 0 has target 0 and takes
nothing, and so do all where all sizes are 0. Repeated rows are rows. An empty table gives an empty result. Other columns are ignored by
``mix``; ``systematic`` keeps them, and they may have any names but those that begin with ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import weighted_join

WORDS = r"[^\x20\x09-\x0D]+"
#: Expected copies are whole numbers of 2^-24.
BITS = 24
ONE = 1 << BITS
#: Rows of a cell, on average at most.
CELL_ROWS = 1_000


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size -> with target (sources are sorted in one task, a row each: meant for up to some millions of them): weights by code point, repeating, null last; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight. The table has one row for each source.

    With the level L, targets are min(most * size, L * weight) and sum up to all sizes. Sources in the order of
    most * size / weight reach their stop one after the other, so that prefix sums give L."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.withColumn("at", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    by_stop = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("weight", weight).withColumn("stop", most * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("stop").over(by_stop), F.lit(0.0))
    heavy = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0))
    ordered = ordered.withColumn("level", left / heavy)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))).over(all_rows)["level"]
    return ordered.select("source", "source_size", F.least("stop", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def systematic(df: DataFrame, id_col: str, source_col: str, size_col: str, expected_col: str, seed: int = 0) -> DataFrame:
    """Adds ``copies``. ``expected_col`` is the expected copies, fixed-point (times ONE)."""
    rows = df.withColumn("__mix_class", F.when(F.col(size_col) > 0, F.floor(F.log2(F.col(size_col).cast("double")))).otherwise(-1))
    key, lost = F.coalesce(source_col, F.lit("")), F.col(source_col).isNull()
    rows = rows.withColumn("__mix_source", key).withColumn("__mix_null", lost)
    group = ["__mix_source", "__mix_null", "__mix_class"]
    counts = Scratch(df.sparkSession, "classes").save(rows.groupBy(*group).agg(F.count("*").alias("__mix_rows"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("__mix_cells")))
    rows = weighted_join(rows, counts, group, id_col, "__mix_rows").drop("__mix_rows").withColumn("__mix_cell", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.col("__mix_cells")).cast("int"))
    cell = [*group, "__mix_cell"]
    before = Window.partitionBy("__mix_source", "__mix_null").orderBy("__mix_class", "__mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*cell).agg(F.sum(expected_col).alias("__mix_sum")).withColumn("__mix_base", F.coalesce(F.sum("__mix_sum").over(before), F.lit(0))).drop("__mix_sum")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__mix_source")), 1, 6), 16, 10).cast("long")  # uniform in [0, ONE)
    within = Window.partitionBy(*cell).orderBy(size_col, id_col).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__mix_base") + F.sum(expected_col).over(within) + offset
    rows = rows.join(sums, cell).withColumn("__mix_end", end)
    copies = F.shiftright("__mix_end", BITS) - F.shiftright(F.col("__mix_end") - F.col(expected_col), BITS)
    return rows.withColumn("copies", copies).drop(*cell, "__mix_cells", "__mix_base", "__mix_end")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``df``."""
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(text_col, F.lit(WORDS))).cast("long")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    docs = Scratch(df.sparkSession, "mix").save(docs)  # the texts are read once
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumnRenamed("source", "_name")
    docs = docs.join(goal, docs.source.eqNullSafe(goal._name)).drop("_name")
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    out = systematic(docs.withColumn("_expected", expected), "doc_id", "source", "size", "_expected", seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long"))


def repeated(df: DataFrame, copies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as often as ``copies`` (doc_id, copies) says. ``df`` has one row for each id; a row without an id cannot be
    looked up and stays once."""
    counts = copies.select(F.col("doc_id").alias("__mix_id"), F.col("copies").alias("__mix_copies"))
    met = df.join(counts, F.col(id_col) == F.col("__mix_id"), "left").withColumn("__mix_copies", F.when(F.col(id_col).isNull(), 1).otherwise(F.col("__mix_copies")))
    met = met.filter("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return met.select(*[F.col(f"`{c}`") for c in df.columns])
