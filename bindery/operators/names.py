"""Names that nothing else has: set-based, for all books at once.

A name that is taken gets the first number that makes it free: ``a``, ``a-1``, ``a-2`` for ids, ``a.xhtml``, ``a1.xhtml`` for hrefs. One
after the other each wanted name would hang on all before it. Set-based, only names of one root (without numbers at its end) can ever meet.
Where all its names differ and none is taken they stay.
Where a root has one wanted name, its k-th occurrence gets the k-th number that is free: taken numbers are gaps, and the gaps
below turn ranks into numbers, all by windows over one order of the names. Only roots with several wanted names (``a`` and ``a-1``), or with names that are taken
in between, hang on the order of all their names; they are folded, each root by itself, with one pointer for each name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Levels


@dataclass(frozen=True)
class Style:
    """Where the number stands: after ``sign``, before an ending from the last dot on or at the very end."""

    sign: str = "-"
    ending: bool = False

    @property
    def _tail(self) -> str:
        return r"(\.[^.]*)?$" if self.ending else "()$"

    def root(self, name: Column) -> Column:
        return F.regexp_replace(name, f"({self.sign}[0-9]+)*{self._tail}" if self.sign else f"[0-9]*{self._tail}", "$2" if self.sign else "$1")

    def stem(self, name: Column) -> Column:
        return F.regexp_replace(name, self._tail, "") if self.ending else name

    def made(self, name: Column, number: Column) -> Column:
        stem = self.stem(name)
        return F.when(number == 0, name).otherwise(F.concat(stem, F.lit(self.sign), number.cast("string"), F.substr(name, F.char_length(stem) + 1)))

    def number(self, name: Column, base: Column) -> Column:
        """The number that makes ``name`` of ``base``; null if none does."""
        stem = self.stem(base)
        tail = F.substr(base, F.char_length(stem) + 1)
        middle = F.substr(name, F.char_length(stem) + 1, F.char_length(name) - F.char_length(base))
        fits = F.startswith(name, F.concat(stem, F.lit(self.sign))) & F.endswith(name, tail) & (F.char_length(name) > F.char_length(base))
        digits = F.substr(middle, F.lit(len(self.sign) + 1))
        return F.when(name == base, F.lit(0)).when(fits & digits.rlike("^[1-9][0-9]{0,17}$"), digits.try_cast("long"))


IDS, HREFS = Style(), Style("", True)
#: So many taken names of a root go along with each of its rows; of more, windows of their own count the gaps.
FEW = 64


def _folder(style: Style, keys: Sequence[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by root, place and claims first; what is held is a root's."""
        now: list | None = None
        used: set[str] = set()
        next_: dict[str, int] = {}
        for batch in batches:
            kept, made = [], []
            for i, (*key, want, claim) in enumerate(zip(*[batch.column(k).to_pylist() for k in (*keys, "_root", "name", "_claim")], strict=True)):
                if key != now:
                    now, used, next_ = key, set(), {}
                if claim:
                    used.add(want)
                    continue
                cut = want.rfind(".") if style.ending and "." in want else len(want)
                k, new = next_.get(want, 0), want
                while (new := want if not k else f"{want[:cut]}{style.sign}{k}{want[cut:]}") in used:
                    k += 1
                next_[want] = k  # what is used stays used
                used.add(new)
                kept.append(i)
                made.append(new)
            rows = batch.take(pa.array(kept, pa.int64()))
            own = [c for c in rows.schema.names if c not in ("_root", "_claim", "_at")]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in own], pa.array(made, pa.string())], names=[*own, "new_name"])

    return fold


def told(rows: DataFrame, keys: Sequence[str], style: Style = IDS) -> DataFrame:
    """Wanted and taken names in one table (keys, ord, name, ``_claim``: whether it is taken; further columns go along) with ``new_name`` and
    ``_way``: null where the name is settled, else how ``rest`` settles it. Taken names stay for ``rest`` only. Rows that are dealt out by the
    keys, or by some of them, are not dealt out again: all of a root comes from windows over one order of its names."""
    columns, root = rows.columns, Window.partitionBy(*keys, "_root")
    by_name = root.orderBy("name", F.desc("_claim"), "ord")
    so_far = by_name.rowsBetween(Window.unboundedPreceding, 0)
    claim = F.col("_claim")
    rows = rows.withColumn("_root", style.root(F.col("name")))
    rows = rows.withColumns({"_hit": ~claim & (F.lag("name").over(by_name) == F.col("name")), "_rank": F.count_if(~claim).over(so_far) - 1, "_nth": F.count_if(claim).over(so_far)})
    wish = F.when(~claim, F.col("name"))
    rows = rows.withColumns({
        "_base": F.min(wish).over(root), "_top": F.max(wish).over(root), "_clash": F.coalesce(F.bool_or("_hit").over(root), F.lit(False)), "_timed": F.bool_or(claim & F.col("ord").isNotNull()).over(root), "_claims": F.max("_nth").over(root),
        "_taken": F.collect_set(F.when(claim & (F.col("_nth") <= FEW), F.col("name"))).over(root),
    })
    way = F.when(F.col("_clash"), F.when((F.col("_base") < F.col("_top")) | F.col("_timed"), "fold").when(F.col("_claims") > FEW, "gaps"))
    rows = rows.withColumn("_way", way).filter(~claim | F.col("_way").isNotNull())
    gaps = F.array_sort(F.filter(F.transform("_taken", lambda n: style.number(n, F.col("_base"))), lambda n: n.isNotNull()))
    passed = F.aggregate(gaps, F.col("_rank"), lambda at, n: F.when(n <= at, at + 1).otherwise(at))
    rows = rows.withColumn("_number", F.when(F.col("_clash") & F.col("_way").isNull(), F.when(F.size("_taken") == 0, F.col("_rank")).otherwise(passed)))
    new = F.when(F.col("_way").isNull(), F.when(F.col("_clash"), style.made(F.col("name"), F.col("_number"))).otherwise(F.col("name")))
    return rows.select(*columns, "_root", "_base", "_way", new.alias("new_name"))


def rest(rows: DataFrame, keys: Sequence[str], style: Style = IDS) -> DataFrame | None:
    """The rows of ``told``, written before, that it did not settle, with their new names and the columns that they had; null if there are none."""
    ways = {r[0] for r in rows.filter("_way is not null").select("_way").distinct().collect()}
    columns, out = [c for c in rows.columns if c not in ("_root", "_base", "_way", "_claim", "new_name")], []
    if "gaps" in ways:
        root = Window.partitionBy(*keys, "_root")
        gapped = rows.filter("_way = 'gaps'")
        rank = F.row_number().over(root.orderBy("ord")) - 1
        first = gapped.filter("not _claim").select(*columns, "_root", F.lit(1).alias("_kind"), rank.cast("long").alias("_at"))
        gaps = gapped.filter("_claim").select(*keys, "_root", style.number(F.col("name"), F.col("_base")).alias("_n")).filter("_n is not null").distinct()
        below = F.row_number().over(root.orderBy("_n")) - 1
        gaps = gaps.select(*keys, "_root", F.lit(0).alias("_kind"), (F.col("_n") - below).alias("_at"))
        running = F.count_if(F.col("_kind") == 0).over(root.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
        met = first.unionByName(gaps, allowMissingColumns=True).withColumn("_number", F.col("_at") + running).filter("_kind = 1")
        out.append(met.select(*columns, style.made(F.col("name"), F.col("_number")).alias("new_name")))
    if "fold" in ways:
        hard = rows.filter("_way = 'fold'").select(*columns, "_root", "_claim", F.coalesce("ord", F.lit(-(1 << 62))).alias("_at"))
        schema = hard.select(*columns, F.col("name").alias("new_name")).schema
        out.append(hard.repartition(*keys, "_root").sortWithinPartitions(*keys, "_root", "_at", F.desc("_claim")).mapInArrow(_folder(style, keys), schema))
    return reduce(DataFrame.unionByName, out) if out else None


def unique(wanted: DataFrame, taken: DataFrame, keys: Sequence[str], style: Style = IDS) -> DataFrame:
    """``wanted`` (keys, ord, name; further columns go along) with new_name. ``taken`` (keys, name) is never given; with a column ``ord`` a name
    is taken from there on only, before wanted names of that place (null: always). Null names stay null. Places are to differ within a key.

    A root's names are one window, or one group where they hang on each other."""
    keys, kinds = list(keys), dict(wanted.dtypes)
    columns = [*wanted.columns, "new_name"]
    if "ord" not in taken.columns:
        taken = taken.withColumn("ord", F.lit(None))
    none = wanted.filter("name is null").withColumn("new_name", F.col("name"))
    wants = wanted.filter("name is not null").withColumns({"ord": F.col("ord").cast("long"), "_claim": F.lit(False)})
    claims = taken.filter("name is not null").select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col("ord").cast("long").alias("ord"), "name", F.lit(True).alias("_claim"))
    rows = Levels(wanted).save(told(wants.unionByName(claims, allowMissingColumns=True), keys, style))  # written once, as all ways read it
    out, more = rows.filter("_way is null").select(*columns), rest(rows, keys, style)
    out = out.unionByName(more.select(*columns)) if more is not None else out
    return out.withColumn("ord", F.col("ord").cast(kinds["ord"])).select(*columns).unionByName(none)
