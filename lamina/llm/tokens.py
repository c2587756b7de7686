"""Words of many texts at once, in numpy over Arrow buffers. Words are runs of bytes other than ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in ((0, _BASE), (1, U(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span: the same wherever the values stand."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + mix((ends - starts).astype(U)))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is the empty text."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): runs of rows of about most_bytes at most; one row at least."""
    data, offsets = texts(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a chunk: byte starts and ends, 64-bit hashes, the row of each, and the first word of each row (rows + 1 entries)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = SPACE[data]
        n = len(data)
        first = np.ones(n, bool)
        first[1:] = space[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        first[inner] = True
        last = np.ones(n, bool)
        last[:-1] = space[1:]
        last[inner[1:] - 1] = True
        self.space = space
        self.starts = np.flatnonzero(first & ~space)
        self.ends = np.flatnonzero(last & ~space) + 1
        self.hashes = spans_hash(_VALUE[data], self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of hashes[i : i + size] for each i that has so many."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(size):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i] : offsets[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
