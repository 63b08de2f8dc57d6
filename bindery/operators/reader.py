"""Reading order: linear behaviours, the cursor as window functions, and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of, numbered

BOOK = "book_id"
BEHAVIOURS = ("original", "linear_only", "non_linear_only", "prepend_non_linear", "append_non_linear")


def reading_order(spine: DataFrame, behaviour: str = "original", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Adds ``position`` from 0; ``linear`` says which entries are linear, ``order`` what the spine's order is."""
    if behaviour not in BEHAVIOURS:
        raise ValueError(f"unknown behaviour {behaviour!r}")
    rows = spine.filter("linear") if behaviour == "linear_only" else spine.filter("not linear") if behaviour == "non_linear_only" else spine
    first = {"prepend_non_linear": [F.col("linear").cast("int")], "append_non_linear": [-F.col("linear").cast("int")]}.get(behaviour, [])
    return numbered(rows, [BOOK], [*first, *map(F.col, order)], "position")


def cursor(ordered: DataFrame, key: str = "idref") -> DataFrame:
    """Adds next_key, prev_key, n (entries of the book) and remaining (entries after this one). One sort serves all."""
    w = Window.partitionBy(BOOK).orderBy("position")
    n = F.count("*").over(Window.partitionBy(BOOK))
    out = ordered.withColumns({"next_key": F.lead(key).over(w), "prev_key": F.lag(key).over(w), "n": n})
    return out.withColumn("remaining", F.col("n") - F.col("position") - 1)


def seek(ordered: DataFrame, requests: DataFrame, key: str = "idref") -> DataFrame:
    """requests (book_id, key or position): the first entry of that key, or the entry there; error ``no_mapping`` or ``out_of_bounds``."""
    if key in requests.columns:
        found = first_of(ordered.select(BOOK, key, "position"), [BOOK, key], [F.col("position")])
        return requests.join(found, [BOOK, key], "left").withColumn("error", F.when(F.col("position").isNull(), "no_mapping"))
    found = ordered.select(BOOK, "position", key)
    return requests.join(found, [BOOK, "position"], "left").withColumn("error", F.when(F.col(key).isNull(), "out_of_bounds"))


def by_id(spine: DataFrame, ids: DataFrame) -> DataFrame:
    """For each (book_id, id) the first spine entry of that id."""
    return first_of(spine.join(ids.select(BOOK, "id").distinct(), [BOOK, "id"], "left_semi"), [BOOK, "id"], [F.col("ord")])


def by_idref(spine: DataFrame, idrefs: DataFrame) -> DataFrame:
    """All spine entries of the (book_id, idref) rows."""
    return spine.join(idrefs.select(BOOK, "idref").distinct(), [BOOK, "idref"], "left_semi")


def linearity(spine: DataFrame) -> DataFrame:
    """all_linear and all_non_linear for each book with a spine: whether behaviours leave its order as it is."""
    return spine.groupBy(BOOK).agg(F.bool_and("linear").alias("all_linear"), F.bool_and(~F.col("linear")).alias("all_non_linear"))


def with_items(ordered: DataFrame, items: DataFrame) -> DataFrame:
    """Spine entries with their manifest items; error ``invalid_idref`` where there is none."""
    named = items.select(BOOK, F.col("id").alias("idref"), "href", "media_type")
    return ordered.join(named, [BOOK, "idref"], "left").withColumn("error", F.when(F.col("href").isNull(), "invalid_idref"))


def current(ordered: DataFrame, cursors: DataFrame) -> DataFrame:
    """(book_id, position) cursors with the entry there; a null position is a reader before its first read, or after a reset: no entry."""
    return cursors.join(ordered, [BOOK, "position"], "left")


def content(ordered: DataFrame, items: DataFrame, resources: DataFrame, prefix: str | None = None, css: str | None = None) -> DataFrame:
    """Spine entries with their text and bytes, rewritten if asked for."""
    from .manifest import read

    met = with_items(ordered, items)
    return read(met.filter("error is null").drop("error"), resources, prefix, css).unionByName(met.filter("error is not null"), allowMissingColumns=True)
