"""Media columns: lossless PNG in binary columns, and perceptual hashes of what they show.

Bytes are stored as a grey PNG of 8-bit samples: each row of samples gets the filter (none, sub, up) with the least sum of absolute
differences, then zlib. Reading tests the signature, every chunk's checksum, the order of chunks, zlib's own checksum and the size,
and undoes all five filters in numpy. The feature is the low-frequency block of the cosine transform of the picture, shrunk to
32 x 32 by area means: one bit for each coefficient above their median.

Defined results: null counts as the empty text, which is a picture of filling alone. Equal texts give equal values. ``decode_png``
raises ValueError for a damaged or unsupported file; ``describe`` gives such a row (and a null one) null values of what was read and an
``error`` that says why, and no job ends. Pictures with a palette are hashed by its colours, and alpha is no colour. Repeated rows stay
rows, null ids stay null, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a row, and so the multiple to which a payload is filled.
WIDTH = 576
FILL = 255
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 4) -> bytes:
    """samples: height x width of uint8."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    options = (samples, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in options])
    which = cost.argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = which
    for k, x in enumerate(options):
        lines[which == k, 1:] = x[which == k]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, unit: int) -> np.ndarray:
    """lines: height x (1 + bytes of a row); unit: bytes of a pixel."""
    out = lines[:, 1:].copy()
    height, width = out.shape
    if width % unit:
        raise ValueError("row of broken pixels")
    kinds, y = lines[:, 0], 0
    if height and kinds.max() > 4:
        raise ValueError("unknown filter")
    while y < height:
        kind, run = kinds[y], y + 1
        if kind == 1:
            while run < height and kinds[run] == 1:
                run += 1
            rows = out[y:run].reshape(run - y, -1, unit)
            np.cumsum(rows, axis=1, dtype=np.uint8, out=rows)
        elif kind == 2:
            while run < height and kinds[run] == 2:
                run += 1
            above = max(0, y - 1)
            np.cumsum(out[above:run], axis=0, dtype=np.uint8, out=out[above:run])
        elif kind in (3, 4):
            row = out[y].astype(np.int32)
            above = out[y - 1].astype(np.int32) if y else np.zeros(width, np.int32)
            for x in range(width):
                a, b = row[x - unit] if x >= unit else 0, above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - unit] if x >= unit else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                row[x] = (row[x] + guess) & 255
            out[y] = row
        y = run
    return out


#: Samples of a pixel by colour type (grey, RGB, palette, grey and alpha, RGBA).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes, shown: bool = False) -> np.ndarray:
    """height x width x samples of uint8; 8 bits a sample, not interlaced. ``shown``: colours instead of a palette's places and alpha."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, head, body, kind, palette = len(SIGNATURE), None, [], b"", None
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("chunk cut off")
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        content, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) != 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + content):
            raise ValueError(f"checksum of {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR is to be the first chunk, once")
        if kind == b"IHDR":
            if len(content) != 13:
                raise ValueError("IHDR of a wrong size")
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).reshape(-1, 3)
        elif not kind[:1] or not kind[0] & 32 and kind != b"IEND":
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    width, height, bits, colour, packing, filters, interlaced = head
    if bits != 8 or colour not in _SAMPLES or packing or filters or interlaced or not width or not height:
        raise ValueError("unsupported picture")
    unit = _SAMPLES[colour]
    size, unpacker = height * (1 + width * unit), zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(body), size + 1)  # never more than the picture has, whatever the stream holds
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not unpacker.eof:
        raise ValueError("wrong number of samples")
    out = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), unit).reshape(height, width, unit)
    if shown and colour == 3:
        if palette is None or not len(palette) or out.max() >= len(palette):
            raise ValueError("no such colour in the palette")
        return palette[out[:, :, 0]]
    return out[:, :, :-1] if shown and colour in (4, 6) else out


def _shrunk(grey: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= SIDE:
            cuts = np.arange(SIDE) * n // SIDE
            sizes = np.diff(np.append(cuts, n))
            grey = np.add.reduceat(grey, cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            grey = np.take(grey, np.arange(SIDE) * n // SIDE, axis=axis)
    return grey


_COSINE = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def cosine_hash(picture: np.ndarray) -> str:
    """16 hexadecimal digits: the signs of 8 x 8 low-frequency coefficients against their median."""
    low = (_COSINE @ _shrunk(picture.astype(np.float64).mean(axis=2)) @ _COSINE.T).round(6).ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % WIDTH or WIDTH * (not text))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [b.to_pybytes() if (b := x.as_buffer()) is not None else b"" for x in part.column(1)]
            stored = [encode_png(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(stored, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    for batch in batches:
        out = []
        for media in batch.column(2):
            if media.as_buffer() is None:
                out.append((None,) * 6 + ("no picture",))
                continue
            data = media.as_buffer().to_pybytes()
            stored = len(data), hashlib.sha256(data).hexdigest()
            try:
                picture = decode_png(data)
                back = picture.tobytes()
                colours = picture if picture.shape[2] == 1 and data[25] == 0 else decode_png(data, shown=True)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), *stored, cosine_hash(colours), None))
            except ValueError as e:
                out.append((None, None, None, *stored, None, str(e)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)


def describe(media: DataFrame) -> DataFrame:
    """Reads stored pictures back: sizes, digests and the feature of each row of ``to_media``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema)
