"""Navigation trees as rows with paths: flattening, sizes, choice among versions, merging and pruning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import href
from . import manifest
from .common import Levels, first_of, upserted

BOOK = "book_id"
#: Ranges of the preorder that nodes are dealt into, at least.
CHUNKS = 64
#: Roots for which a preferred version counts.
PREFERRED_KINDS = ("toc", "landmarks", "page-list")


def flattened(nodes: DataFrame) -> DataFrame:
    """All entries without the roots; ordering by (root_ord, path) is depth-first."""
    return nodes.filter(F.size("path") > 0)


def children(nodes: DataFrame, parent: Column) -> DataFrame:
    """Direct children of the node at ``parent`` (an array)."""
    return nodes.filter((F.size("path") == F.size(parent) + 1) & (F.slice("path", 1, F.size(parent)) == parent))


def end(nodes: DataFrame) -> Column:
    """What stands behind all that is below a node, and before what comes after."""
    kind = dict(nodes.dtypes)["path"][6:-1]
    return F.concat("path", F.array(F.lit(2**31 - 1 if kind == "int" else 2**63 - 1).cast(kind)))


def _ranged(nodes: DataFrame, keys: Sequence[str], at: str = "path") -> DataFrame:
    """In ranges of the preorder, so that a tree of any size is dealt over many tasks."""
    n = max(CHUNKS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return nodes.repartitionByRange(n, *keys, at)


def _chunked(nodes: DataFrame, keys: Sequence[str], at: str = "path") -> DataFrame:
    """With ``_chunk``, the number of a node's range; written once, so that every reader has the same ranges."""
    return Levels(nodes).save(_ranged(nodes, keys, at).withColumn("_chunk", F.spark_partition_id()))


def _met(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with what its chunk has from the others."""
    renamed = carry.select(*[F.col(k).alias(f"_at_{k}") for k in (*keys, "_chunk")], "_carry")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, "_chunk")])
    return rows.join(renamed, same, "left").drop(*[f"_at_{k}" for k in (*keys, "_chunk")])


def _so_far(keys: Sequence[str], backwards: bool = False) -> Window:
    """The nodes of a chunk up to each, or down to each from its end."""
    return Window.partitionBy(*keys, "_chunk").orderBy(F.col("path").desc() if backwards else F.col("path")).rowsBetween(Window.unboundedPreceding, 0)


def indexed(nodes: DataFrame, keys: tuple[str, ...] = (BOOK, "root_ord")) -> DataFrame:
    """Nested sets: ``enter`` (place in preorder from 0, the root's if it is there), ``leave`` (the largest enter below a node, its own if
    there is none) and ``depth``. What stands below a node has enters up to its leave, so that subtrees are ranges. A node is two events, the
    second one after all that begins with its path; events are counted chunk by chunk, each from what the chunks before it have."""
    events = nodes.withColumn("_event", F.explode(F.array(F.struct(F.col("path").alias("at"), F.lit(True).alias("opens")), F.struct(end(nodes).alias("at"), F.lit(False).alias("opens")))))
    events = _chunked(events.withColumn("_at", F.col("_event.at")).withColumn("_opens", F.col("_event.opens")).drop("_event"), keys, "_at")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = events.groupBy(*keys, "_chunk").agg(F.count_if("_opens").alias("_n")).select(*keys, "_chunk", F.sum("_n").over(before).alias("_carry")).filter("_carry > 0")
    so_far = Window.partitionBy(*keys, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = _met(events, carry, keys).withColumn("_opened", F.count_if("_opens").over(so_far) + F.coalesce("_carry", F.lit(0)) - 1)
    both = met.withColumn("_leave", F.lead("_opened").over(Window.partitionBy(*keys, "path").orderBy("_at")))
    return both.filter("_opens").withColumnRenamed("_opened", "enter").withColumnRenamed("_leave", "leave").withColumn("depth", F.size("path")).drop("_at", "_opens", "_chunk", "_carry")


def _measured(keys: list[str]):
    """Entries and greatest depth below each node, of rows in preorder: only the nodes that have not ended are held. What stands above a task's
    first node belongs to tasks before it; for these places there are rows that are not ``_own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, open_, out = None, None, [], []  # open_: path, entries below, greatest depth, whether it is a row

        def close() -> None:
            path, n, deep, own = open_.pop()
            out.append((*now, path, n, deep, own))
            if open_:
                above = open_[-1]
                above[1] += n + own
                above[2] = max(above[2], deep)

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([*[batch.schema.field(k) for k in keys], batch.schema.field("path"), pa.field("_n", pa.int64()), pa.field("_deep", pa.int32()), pa.field("_own", pa.bool_())])
            for *key, path in zip(*[batch.column(k).to_pylist() for k in (*keys, "path")], strict=True):
                if key != now:
                    while open_:
                        close()
                    if now is None:
                        open_.extend([path[:k], 0, k, False] for k in range(len(path)))
                    now = key
                while open_ and not (len(open_[-1][0]) < len(path) and path[: len(open_[-1][0])] == open_[-1][0]):
                    close()
                open_.append([path, 0, len(path), True])
                if len(out) >= 10_000:
                    yield made()
        while open_:
            close()
        if out:
            yield made()

    return run


def sizes(nodes: DataFrame, keys: tuple[str, ...] = (BOOK, "root_ord")) -> DataFrame:
    """total_len (entries below) and max_depth (levels below) of every node. A range of the preorder is one walk; a tree that
    spans ranges has from each the sums for the nodes that it stands below, at most one for each level."""
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "path")) + ", _n long, _deep int, _own boolean"
    walked = _ranged(nodes.select(*keys, "path"), keys).sortWithinPartitions(*keys, "path").mapInArrow(_measured(list(keys)), schema)
    walked = Levels(nodes).save(walked)
    above = walked.filter("not _own and _n > 0").groupBy(*keys, "path").agg(F.sum("_n").alias("_more"), F.max("_deep").alias("_lower"))
    above = above.select(*[F.col(k).alias(f"_at_{k}") for k in (*keys, "path")], "_more", "_lower")
    met = walked.filter("_own").join(above, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, "path")]), "left")
    return met.select(*keys, "path", (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("total_len"), (F.greatest("_deep", "_lower") - F.size("path")).alias("max_depth"))


def chosen(roots: DataFrame, kind: str, preferred: int = 3) -> DataFrame:
    """For each book the root of a kind: the preferred version, then 2, then 3; others have no preference."""
    attempts = [2, 3] if kind not in PREFERRED_KINDS else list(dict.fromkeys([preferred, 2, 3]))
    rank = F.array_position(F.array(*map(F.lit, attempts)), F.col("root_version").cast("int"))
    return first_of(roots.filter((F.col("root_kind") == kind) & (rank > 0)), [BOOK], [rank, F.col("root_ord")])


def by_kind_version(roots: DataFrame, kind: str, version: int) -> DataFrame:
    """The roots of exactly this kind and major version."""
    return roots.filter((F.col("root_kind") == kind) & (F.col("root_version").cast("int") == version))


def _below(parent: Column) -> Column:
    return (F.size("path") > F.size(parent)) & (F.slice("path", 1, F.size(parent)) == parent)


def _moved(nodes: DataFrame, parent: Column, new_place: Column) -> DataFrame:
    """Entries below ``parent`` whose place among its children is ``new_place``."""
    place = F.size(parent)
    shifted = F.concat(F.slice("path", 1, place), F.array(new_place.cast(dict(nodes.dtypes)["path"][6:-1])), F.slice("path", place + 2, F.size("path")))
    return nodes.withColumn("path", F.when(_below(parent), shifted).otherwise(F.col("path")))


def inserted(nodes: DataFrame, parent: Column, place: int, new: DataFrame) -> DataFrame:
    """``new`` subtrees (their paths begin with 0, 1, ... for each new child) as children of the node at ``parent``, from ``place`` on, or at
    the end if it has fewer children. ``nodes`` is one tree of each book."""
    kids = nodes.filter(_below(parent) & (F.size("path") == F.size(parent) + 1)).groupBy(BOOK).agg(F.count("*").alias("_n"))
    count = new.filter(F.size("path") == 1).groupBy(BOOK).agg(F.count("*").alias("_m"))
    books = nodes.select(BOOK).distinct().join(kids, BOOK, "left").join(count, BOOK, "left")
    books = books.select(BOOK, F.least(F.lit(place), F.coalesce("_n", F.lit(0))).alias("_at"), F.coalesce("_m", F.lit(0)).alias("_m"))
    own = F.get("path", F.size(parent))
    rows = _moved(nodes.join(books, BOOK), parent, F.when(own >= F.col("_at"), own + F.col("_m")).otherwise(own)).drop("_at", "_m")
    kind = dict(nodes.dtypes)["path"]
    more = new.join(books, BOOK).withColumn("path", F.concat(parent.cast(kind), F.array((F.get("path", F.lit(0)) + F.col("_at")).cast(kind[6:-1])), F.slice("path", 2, F.size("path")).cast(kind))).drop("_at", "_m")
    return rows.unionByName(more, allowMissingColumns=True)


def removed(nodes: DataFrame, parent: Column, place: int) -> DataFrame:
    """Without the child at ``place`` of the node at ``parent`` and all below it; later children move up."""
    own = F.get("path", F.size(parent))
    kept = nodes.filter(~(_below(parent) & (own == place)))
    return _moved(kept, parent, F.when(own > place, own - 1).otherwise(own))


def retained(nodes: DataFrame, keep: Column, keys: tuple[str, ...] = (BOOK, "root_ord")) -> DataFrame:
    """Without the nodes for which ``keep`` does not hold and all below them; roots stay, and places are as they were. A node goes
    if of those that began before it one ends after it; a chunk begins with the last end of the chunks before it."""
    bad = ~F.coalesce(keep, F.lit(False)) & (F.size("path") > 0)
    rows = _chunked(nodes.withColumn("_ends", F.when(bad, end(nodes))), keys)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_chunk").agg(F.max("_ends").alias("_e")).select(*keys, "_chunk", F.max("_e").over(before).alias("_carry")).filter("_carry is not null")
    met = _met(rows, carry, keys).withColumn("_last", F.greatest(F.max("_ends").over(_so_far(keys)), "_carry"))
    return met.filter(F.col("_last").isNull() | (F.col("_last") <= F.col("path"))).select(*nodes.columns)


def first_below(nodes: DataFrame, value: Column, keys: tuple[str, ...] = (BOOK, "root_ord")) -> DataFrame:
    """``_first``: a node's own value, else that of the first node below it that has one; null without any. The next value from a node on is its
    own or stands below it if it comes before the node's end; a chunk ends with the first value of the chunks after it."""
    rows = _chunked(nodes.withColumn("_value", value), keys)
    has = F.when(F.col("_value").isNotNull(), F.struct("path", "_value"))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_chunk").agg(F.min(has).alias("_v")).select(*keys, "_chunk", F.last("_v", ignorenulls=True).over(later).alias("_carry")).filter("_carry is not null")
    # from the last node to the first: a frame that grows at its end is summed up once, one that shrinks at its start once for each row
    met = _met(rows, carry, keys).withColumn("_next", F.coalesce(F.last(has, ignorenulls=True).over(_so_far(keys, True)), "_carry"))
    return met.withColumn("_first", F.when(F.col("_next.path") < end(nodes), F.col("_next._value"))).select(*nodes.columns, "_first")


def merged(*parts: DataFrame) -> DataFrame:
    """Roots of several documents: of an equal kind and version the later one's, at the first one's place."""
    out = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("_part", F.lit(k)))
    out = out.withColumn("_at", F.struct("_part", "root_ord"))
    return upserted(out.drop("_part"), [BOOK, "root_kind", "root_version"], "_at").drop("_at")


def without_redundant_guide(roots: DataFrame) -> DataFrame:
    """Landmarks of version 2 go where there are landmarks of version 3."""
    newer = roots.filter((F.col("root_kind") == "landmarks") & (F.col("root_version").cast("int") == 3)).select(BOOK).distinct().withColumn("_newer", F.lit(True))
    met = roots.join(newer, BOOK, "left")
    return met.filter(~((F.col("root_kind") == "landmarks") & (F.col("root_version").cast("int") == 2) & F.coalesce("_newer", F.lit(False)))).drop("_newer")


def resolved(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes with the id of the item that their href names."""
    return manifest.by_href(items.select(BOOK, "ord", "id", "href", "href_raw"), nodes.withColumnRenamed("id", "node_html_id").withColumnRenamed("ord", "node_ord") if "id" in nodes.columns else nodes)


def cleaned(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes whose href names no item go with all below them; roots, nodes without href and those with a scheme stay."""
    names = items.select(BOOK, F.explode(F.array_distinct(F.array("href", "href_raw"))).alias("_target")).filter("_target is not null").distinct().withColumn("_known", F.lit(True))
    met = nodes.withColumn("_target", href.path(F.col("href"))).join(names, [BOOK, "_target"], "left")
    return retained(met, F.col("href").isNull() | href.has_scheme(F.col("href")) | F.col("_known").isNotNull()).select(*nodes.columns)
