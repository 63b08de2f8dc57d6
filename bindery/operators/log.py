"""Logs of edits, applied to the tables of all books in one pass: what a sequence of edits leaves, without a join for each edit.

A book's keys and the edits that move them are folded in one native expression (a book and its log are one row of keys, never of contents);
values and bytes follow by joins on keys, as each key needs only the last edits that concern it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOK = "book_id"


def _folded(state: DataFrame, log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Books with ``_state`` and their edits in order."""
    ops = log.groupBy(BOOK).agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("_ops"))
    return state.join(ops, BOOK, "full")


def edited(entries: DataFrame, log: DataFrame, key: str = "id", position: str = "ord") -> DataFrame:
    """``entries`` (book_id, key, position, values) after ``log`` (book_id, seq, op, key, at, values), positions from 0.

    ``insert`` puts a new key at a place (null or beyond the end: the end); of a key that is there it replaces the values, in its place.
    ``remove`` takes a key out, ``move`` puts it at a place of the others, ``set`` replaces the values that are not null; all three do nothing for
    a key that is not there. Keys differ within a book, seqs within a book's log; null keys and other ops do nothing. A book may have entries or edits only."""
    log = log.filter(F.col(key).isNotNull())
    values = [c for c in entries.columns if c not in (BOOK, key, position)]
    keys = entries.groupBy(BOOK).agg(F.array_sort(F.collect_list(F.struct(position, key))).alias("_state"))
    none = F.array().cast(f"array<{dict(entries.dtypes)[key]}>")
    keys = keys.select(BOOK, F.transform("_state", lambda e: e[key]).alias("_state"))

    def step(acc: Column, o: Column) -> Column:
        there = F.array_contains(acc, o[key])
        rest = F.when(o["op"].isin("remove", "move"), F.filter(acc, lambda k: k != o[key])).otherwise(acc)
        place = F.greatest(F.least(F.coalesce(o["at"], F.size(rest)), F.size(rest)), F.lit(0)).cast("int")
        put = F.concat(F.slice(rest, F.lit(1), place), F.array(o[key]), F.slice(rest, place + 1, F.size(rest)))
        return F.when(((o["op"] == "insert") & ~there) | ((o["op"] == "move") & there), put).otherwise(rest)

    moves = log.filter(F.col("op").isin("insert", "remove", "move"))
    left = F.aggregate(F.coalesce("_ops", F.array().cast(f"array<struct<seq: long, op: string, at: long, {key}: {dict(entries.dtypes)[key]}>>")), F.coalesce("_state", none), step)
    moves = moves.withColumns({"seq": F.col("seq").cast("long"), "at": F.col("at").cast("long")})
    order = _folded(keys, moves, ("op", "at", key)).select(BOOK, F.posexplode(left).alias("_at", key))

    # values: those of the last time a key came, and what was set since
    born = entries.select(BOOK, key, F.lit(None).cast("long").alias("seq"), F.lit(True).alias("_born"), *values)
    later = log.filter(F.col("op").isin("insert", "set")).select(BOOK, key, F.col("seq").cast("long").alias("seq"), (F.col("op") == "insert").alias("_born"), *values)
    events = born.unionByName(later).withColumn("seq", F.coalesce("seq", F.lit(-(1 << 62))))
    events = events.withColumn("_since", F.max(F.when(F.col("_born"), F.col("seq"))).over(Window.partitionBy(BOOK, key))).filter("seq >= _since")
    last = events.groupBy(BOOK, key).agg(F.max("seq").alias("_last"), *[F.max_by(v, F.when(F.col("_born") | F.col(v).isNotNull(), F.col("seq"))).alias(v) for v in values])
    out = order.join(last.drop("_last"), [BOOK, key]).withColumn(position, F.col("_at").cast(dict(entries.dtypes)[position]))
    return out.select(*entries.columns)


def overlaid(base: DataFrame, log: DataFrame) -> DataFrame:
    """Resources (book_id, path, content) after ``log`` (book_id, seq, op, path, to, content).

    ``put`` writes a path, ``move`` takes what is at path to another one, over what may be there, ``remove`` takes it away. Moves and removals of paths that
    are not there do nothing, nor does a move to itself. Chains (a to b, b to c, then new content at b) are composed in order; contents are joined once."""
    kind = "struct<put: long, path: string>"
    paths = base.groupBy(BOOK).agg(F.collect_set("path").alias("_paths"))
    origin = lambda put, path: F.struct(put.cast("long").alias("put"), path.cast("string").alias("path"))
    nothing = F.lit(None)
    state = paths.select(BOOK, F.map_from_entries(F.transform("_paths", lambda p: F.struct(p.alias("key"), origin(nothing, p).alias("value")))).alias("_state"))

    def without(acc: Column, *names: Column) -> Column:
        return F.map_filter(acc, lambda k, _: ~k.isin(*names))

    def step(acc: Column, o: Column) -> Column:
        there = F.map_contains_key(acc, o["path"])
        written = F.map_concat(without(acc, o["path"]), F.create_map(o["path"], origin(o["seq"], nothing)))
        moved = F.map_concat(without(acc, o["path"], o["to"]), F.create_map(o["to"], F.try_element_at(acc, o["path"])))
        moves = (o["op"] == "move") & there & (o["path"] != o["to"])
        return F.when(o["op"] == "put", written).when(moves, moved).when((o["op"] == "remove") & there, without(acc, o["path"])).otherwise(acc)

    log = log.filter("path is not null").withColumn("seq", F.col("seq").cast("long"))
    folded = _folded(state, log.filter("op <> 'move' or `to` is not null"), ("op", "path", "to"))
    start = F.coalesce("_state", F.map_from_entries(F.array().cast(f"array<struct<key: string, value: {kind}>>")))
    left = F.aggregate(F.coalesce("_ops", F.array().cast("array<struct<seq: long, op: string, path: string, to: string>>")), start, step)
    found = folded.select(BOOK, F.explode(left).alias("path", "_from"))
    kept = found.filter("_from.put is null").select(BOOK, "path", F.col("_from.path").alias("_old")).join(base.select(BOOK, F.col("path").alias("_old"), "content"), [BOOK, "_old"])
    new = found.filter("_from.put is not null").select(BOOK, "path", F.col("_from.put").alias("seq")).join(log.select(BOOK, "seq", "content"), [BOOK, "seq"])
    return kept.select(BOOK, "path", "content").unionByName(new.select(BOOK, "path", "content"))
