"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

A chunk is a run of rows of at most ``CHUNK`` bytes, or one longer row alone, so
memory follows the chunk and the longest single text, never the partition. Nothing
is kept between chunks but tables of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK = 1 << 20
ROWS = 4096

_LIMIT, _SPARKS_OWN, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20

_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

#: Bytes between words: tab to carriage return, and space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
PIECE = 1 << 16


def _power_table(base: int) -> np.ndarray:
    table = np.full(PIECE, base, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


_POWER, _INVERSE = _power_table(_BASE), _power_table(_BASE_INVERSE)


def _sums(values: np.ndarray, at: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """Weighted sum of the values before each place of ``at`` (ascending), a piece at a time."""
    out = np.zeros(len(at), np.uint64)
    total, done = np.zeros(1, np.uint64), int(np.searchsorted(at, 0, "right"))
    for low in range(0, len(values), PIECE):
        piece = values[low : low + PIECE]
        if table is not None:
            piece = table[piece]
        sums = np.cumsum(piece * _POWER[: len(piece)]) * np.uint64(pow(_BASE, low, 1 << 64)) + total
        upto = int(np.searchsorted(at, low + len(piece), "right"))
        out[done:upto] = sums[at[done:upto] - low - 1]
        total, done = sums[-1:], upto
    return out


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Position-independent hash of ``values[start:end]`` (through ``table``) for each pair; starts and ends both ascend."""
    far = np.array([pow(_BASE_INVERSE, low, 1 << 64) for low in range(0, len(values) + 1, PIECE)], np.uint64)
    inverse = far[start // PIECE] * _INVERSE[start % PIECE]
    return mix((_sums(values, end, table) - _sums(values, start, table)) * inverse + (end - start).astype(np.uint64))


def over(rows: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH`` bytes: a session with Spark's own limit, 64 MB, gets this one."""
    conf = rows.sparkSession.conf
    if conf.get(_LIMIT) == _SPARKS_OWN:
        conf.set(_LIMIT, str(BATCH))
    return rows.mapInArrow(run, schema)


class Words(NamedTuple):
    """Words of one chunk. ``row`` counts from 0 within the chunk; ``first`` is each row's first word, with an end mark."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word but the last k-1: hash of the k words from it on, and whether they lie in one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        return _ranges(self.hash, at, at + k), self.row[:n] == self.row[k - 1 :]


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a string column: first row, byte offsets from 0, bytes. A null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    buffer = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1
        to = min(max(to, at + 1), at + ROWS, len(column))
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(offsets: np.ndarray, data: np.ndarray, fold: bool = False, between: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside ``between``, never across rows; ``fold`` lower-cases A-Z in the hashes."""
    n = len(data)
    inside = ~between[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | fresh[1:n]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:] | fresh[1:n]
    end = np.flatnonzero(edge) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(_ranges(data, start, end, _BYTE[_FOLD] if fold else _BYTE), start, end, row, first)
