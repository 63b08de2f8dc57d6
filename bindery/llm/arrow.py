"""Arrow batches in bounded slices, and words of UTF-8 text as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: The next document begins a new slice once a slice holds this many bytes of text. The arrays made of a slice take up to
#: a hundred times as much, in each of an executor's Python workers.
SLICE_BYTES = 1 << 18

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; those for longer texts than a slice usually holds are not kept."""
    if n <= len(_powers.get("up", ())):
        return _powers["up"], _powers["down"]
    out = {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
        step = np.full(max(2 * SLICE_BYTES, n), base, np.uint64)
        step[0] = 1
        out[name] = np.multiply.accumulate(step)
    if n <= 2 * SLICE_BYTES:
        _powers.update(out)
    return out["up"], out["down"]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every run of bytes other than 0x20 and 0x09-0x0D."""
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column as UTF-8 (null: empty), in slices of about SLICE_BYTES with the row at which each begins."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        data = text.as_buffer()
        data = data.to_pybytes() if data is not None else b""
        held.append(data)
        size += len(data)
        if size >= SLICE_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches that are sorted by them; a group may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest
