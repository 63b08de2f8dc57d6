"""Whitening of embeddings by the eigenvectors of their covariance.

Entries are integers x = floor(scale * entry) + shift. One aggregation gives n and each dimension's sum S; a second one has a generated
SQL expression for each pair of dimensions of the upper triangle, which sums the products of values centred at the whole number
nearest to the mean. The rest of the mean, below one half, is taken off afterwards, so that the covariance is the centred one: while the
sums stay below 2**53 every step before the last division is exact, in whatever order rows come. LAPACK decomposes the
assembled matrix of dimensions squared, all that the driver holds. Each row is then projected by itself.

Defined results: rows whose vector is null, empty, or has a null or an entry that is not finite are dropped; so are vectors of another length
than the commonest (of equally common ones the longest), as no pair of dimensions is defined for them. A null id is an id like any other, repeated rows count and
are returned as rows. x is held within 2**53 either way. Where a component has no variance (to double precision) ``whitened`` is null and
``explained`` 0; the identity error then is that of the other components. ``deviation`` is null where a long cannot hold it. Fewer
than 8 dimensions have as many components. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """components: the largest that are returned; scale and shift: of the whole numbers that stand for entries."""

    components: int = 8
    scale: int = 1024
    shift: int = 100_000


@dataclass(frozen=True)
class Model:
    """n rows with sums S; values e and vectors (columns) of the covariance by falling e; total: its trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    total: float


def whole_numbers(df: DataFrame, p: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, d (dimensions) and x (array of long) of the rows that remain."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = float(EXACT - p.shift)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * p.scale, F.lit(most)), F.lit(-most))) + p.shift)
    return rows.select("vec_id", F.size("v").alias("d"), x.alias("x"))


def fit(x: DataFrame) -> Model | None:
    """The decomposition for all rows of ``x``, which are of one length."""
    sizes = x.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d, n = sizes.d, sizes.n
    x = x.filter(F.col("d") == d)
    sums = x.agg(*[F.expr(f"try_sum(x[{i}])") for i in range(d)]).first()
    if None in tuple(sums):  # beyond a long
        sums = x.agg(*[F.expr(f"sum(cast(x[{i}] as decimal(38, 0)))") for i in range(d)]).first()
    sums = tuple(int(s) for s in sums)
    near = [(2 * s + n) // (2 * n) for s in sums]
    centred = x.select(*[F.expr(f"coalesce(cast(x[{i}] - {m} as double), 0D) as d{i}") for i, m in enumerate(near)])
    # no entry is null; the expressions say so, as code without null tests compiles and runs faster
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    products = centred.agg(*[F.expr(f"sum(d{i} * d{j}) as p{i}_{j}") for i, j in upper]).first()
    v, rest = np.zeros((d, d)), np.array([(s - n * m) / n for s, m in zip(sums, near, strict=True)])
    for (i, j), p in zip(upper, products, strict=True):
        v[i, j] = v[j, i] = p / n - rest[i] * rest[j]
    values, vectors = np.linalg.eigh(v)
    return Model(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


_ROW = "vec_id long, deviation long, whitened array<double>"


def _project(m: Model, kept: int, good: int):
    """Deviation and the first components of each row; those from ``good`` on have no variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(m.sums)
        whole = [s // m.n for s in m.sums]
        fraction = [s - m.n * w for s, w in zip(m.sums, whole, strict=True)]
        base, part = np.array(whole, np.int64), np.array(fraction, np.int64)
        by = m.vectors[:, :good] / np.sqrt(m.values[:good])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                off = rows.column("x").flatten().to_numpy().reshape(-1, d) - base
                far = int(np.abs(off).max(initial=0)) * m.n + m.n
                if far * far * d < 2**63:
                    deviation = ((off * m.n - part) ** 2).sum(axis=1).tolist()
                else:
                    exact = (sum((m.n * int(a) - b) ** 2 for a, b in zip(row, fraction, strict=True)) for row in off)
                    deviation = [s if s < 2**63 else None for s in exact]
                out = np.full((len(off), kept), np.nan)
                out[:, :good] = (off - part / m.n) @ by
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, kept, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Whitening = Whitening()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every remaining row and component."""
    p, spark = params, df.sparkSession
    x = whole_numbers(df, p, id_col, vector_col)
    m = fit(x)
    if m is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d = len(m.sums)
    kept = min(p.components, d)
    good = int(np.count_nonzero(m.values[:kept] > max(m.values[0], 0.0) * d * np.finfo(float).eps))
    rows = Scratch(spark, "whitened").save(x.filter(F.col("d") == d).mapInArrow(_project(m, kept, good), _ROW))
    pairs = [(i, j) for i in range(good) for j in range(i, good)]
    error = 0.0
    if pairs:
        error = rows.agg(F.greatest(F.lit(0.0), *[F.abs(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) - float(i == j)) for i, j in pairs])).first()[0]
    explained = F.array(*[F.lit(float(max(e, 0.0) / m.total) if k < good else 0.0) for k, e in enumerate(m.values[:kept])])
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"))
