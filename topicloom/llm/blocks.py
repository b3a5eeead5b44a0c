"""Vectorised text helpers that run inside ``mapInArrow`` tasks.

A text column is seen as one byte array with row bounds. Work goes block by
block (``BLOCK_BYTES`` of text, at least one row), so a task's memory does not
depend on how many rows Spark puts in an Arrow batch. Rows are never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 8192


def byte_set(members: bytes) -> np.ndarray:
    """Look-up table: is this byte value a member?"""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes of white-space separated words: all but space and \t \n \v \f \r.
NOT_SPACE = ~byte_set(b" \t\n\v\f\r")
#: Bytes of alphanumeric words after lower-casing A-Z: digits, a-z, all of non-ASCII.
ALNUM = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: First bytes of UTF-8 code points.
LEAD = ~byte_set(bytes(range(0x80, 0xC0)))
#: Maps A-Z to a-z and keeps every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): row i holds bytes[bounds[i]:bounds[i + 1]]; null counts as empty."""
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return found[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` bytes of ``column``, or of one longer row."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + BLOCK_ROWS)
            yield batch.slice(at, end - at)
            at = end


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
             column: str = "text") -> DataFrame:
    """Apply ``work`` to bounded blocks of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column):
            made = work(block)
            if made is not None:
                yield made
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marked bytes each row has."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def segments(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the longest runs of member bytes; runs end with their row."""
    inside = member[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit constants derived from a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_VALUE = stream(11, 256)
_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if n <= BLOCK_BYTES + 1:  # one very long text must not stay in memory
            _powers[base] = have
    return have[:n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts])


_PLACE = stream(23, 4096) | np.uint64(1)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (rows are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words[j:j + n] * _PLACE[j]
        return mix(total)


def lanes(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row): each row cut into pieces of ``width``, longest pieces first.

    Pieces are worked on side by side, one position at a time.
    """
    lengths = np.diff(bounds)
    counts = -(-lengths // width)
    row = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[:-1][row] + place * width
    length = np.minimum(width, bounds[1:][row] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], row[order]


def id_crc(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def take_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte spans as an Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes()))
