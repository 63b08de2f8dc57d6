"""Tasks hold few books at a time, however many Spark hands to them at once."""

import pyarrow as pa

from bindery.sources import epub


class Steps:
    """Stands for a DataFrame: gives the function that runs in tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802  Spark's name
        return run


def test_books_are_decoded_in_small_batches(spark):
    run = epub.parse(Steps())
    batch = pa.RecordBatch.from_pylist([{"book_id": str(k), "content": b"no archive"} for k in range(1000)], schema=epub.ARCHIVES)
    out = list(run(iter([batch])))
    assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) == epub.BATCH_BOOKS
    assert {r["error"]["code"] for b in out for r in b.to_pylist()} == {"unreadable"}


def test_batches_end_at_their_bytes():
    books = (({"book_id": "x", "content": b""}, epub.BATCH_BYTES) for _ in range(3))
    assert [b.num_rows for b in epub.batched(books, epub.ARCHIVES)] == [1, 1, 1]
