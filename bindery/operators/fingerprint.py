"""Fingerprints of books: two corpora are compared by joining a digest for each book, and only rows of differing books are looked at.

A row's digest is that of its values as JSON, with the pairs of attributes and prefixes in one order, as these are bags. A table's digest for a
book is the sum of its rows' digests, in eight parts: rows carry their places, so that order counts where it is a column, and sums are
added up before any shuffle, so that a large book is no large group.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOK = "book_id"
#: Columns whose values are bags.
BAGS = ("attributes", "prefixes")
#: Numbers that a reader gives; they say nothing of a book.
GIVEN = ("node_id", "parent_node_id")


def row_digest(df: DataFrame, skip: tuple[str, ...] = (BOOK, *GIVEN)) -> Column:
    """Of all columns but ``skip``, by name; null values count."""
    names = sorted(c for c in df.columns if c not in skip)
    shown = lambda c: F.array_sort(f"`{c}`") if c in BAGS else F.hex(f"`{c}`") if dict(df.dtypes)[c] == "binary" else F.col(f"`{c}`")
    return F.sha2(F.to_json(F.struct(*[shown(c).alias(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """book_id and ``name``, the digest of each book's rows as a bag."""
    parts = [F.sum(F.conv(F.substr("_d", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")).cast("string") for k in range(8)]
    rows = df.select(BOOK, row_digest(df).alias("_d"))
    return rows.groupBy(BOOK).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias(name))


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """book_id, a digest for each table (null: no rows of it) and ``fingerprint`` of all; one row for each book that any table has."""
    digests = [table_digest(df, name) for name, df in tables.items()]
    out = reduce(lambda a, b: a.join(b, BOOK, "full"), digests)
    return out.withColumn("fingerprint", F.sha2(F.concat_ws(",", *[F.coalesce(n, F.lit("-")) for n in tables]), 256))


def compared(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame]) -> DataFrame:
    """book_id, status (equal, changed, removed: only in a, added: only in b) and ``tables``, those that differ, in the order of ``a``."""
    one, two = fingerprints(a), fingerprints(b)
    two = two.select(BOOK, *[F.col(c).alias(f"_{c}") for c in two.columns if c != BOOK])
    met = one.join(two, BOOK, "full")
    status = F.when(F.col("_fingerprint").isNull(), "removed").when(F.col("fingerprint").isNull(), "added").when(F.col("fingerprint") == F.col("_fingerprint"), "equal").otherwise("changed")
    differ = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"_{n}")), n) for n in a]))
    return met.select(BOOK, status.alias("status"), differ.alias("tables"))


def changed_rows(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """book_id, keys and status (changed, removed, added) of rows that differ, where ``keys`` are a row's within its book. Only books whose digests
    differ are compared row by row."""
    digests = table_digest(a, "_a").join(table_digest(b, "_b"), BOOK, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(BOOK)
    rows = lambda df, name: df.join(digests, BOOK, "left_semi").select(BOOK, *keys, row_digest(df).alias(name))
    met = rows(a, "_one").join(rows(b, "_two"), [BOOK, *keys], "full").filter(~F.col("_one").eqNullSafe(F.col("_two")))
    return met.select(BOOK, *keys, F.when(F.col("_two").isNull(), "removed").when(F.col("_one").isNull(), "added").otherwise("changed").alias("status"))
