"""Exact duplicates by progressive refinement.

Rows are grouped by length, then what shares a length by the hash of a prefix, then what shares both by the hash of the whole
text. Each level only gets the rows that the level before could not tell apart. What is shuffled is an id, a length and hashes,
never a text; groups are counted before the shuffle, so that a group with a third of all rows is no hot key.

With ``digest`` the SHA-256 of every text is part of the result and is made in the one scan. Without it, only rows that share
length and prefix with another are hashed in full, in a second scan.

Defined results: null counts as the empty text; of equal texts the largest id stays, a null id only where all are null; repeated
rows (the largest id twice) all count, and all of them are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join, salted_semi

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the prefix.
PREFIX = 128


def normalised(text: str | Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does that much faster where every character is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys another row has too."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return salted_semi(rows, counts, keys, "doc_id")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept (and text_sha256) for every row of ``df``."""
    text = normalised(F.col(text_col))
    first = [F.col(id_col).alias("doc_id"), F.octet_length(text).alias("_length"), F.xxhash64(F.substring(text, 1, prefix)).alias("_prefix")]
    full = F.sha2(text, 256).alias("text_sha256")
    rows = Scratch(df.sparkSession, "exact").save(df.select(*first, *[full] * digest))
    open_ = _shared(_shared(rows, ["_length"]), ["_length", "_prefix"])
    if not digest:
        keys = open_.select("_length", "_prefix").distinct()
        open_ = df.select(*first, text.alias("_text")).join(keys, ["_length", "_prefix"], "left_semi").select("doc_id", "_length", "_prefix", F.sha2("_text", 256).alias("text_sha256"))
    same = open_.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    if not digest:
        same = salted_join(open_, same, ["text_sha256"], "doc_id", "inner").select("doc_id", "_length", "_prefix", "keep_id", "group_size").distinct()
    out = salted_join(rows, same, ["text_sha256"], "doc_id", "left") if digest else rows.join(same, ["doc_id", "_length", "_prefix"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *["text_sha256"] * digest)
