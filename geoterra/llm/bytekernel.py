"""Vectorised byte-level helpers that run inside Spark tasks (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the white-space word rule: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same tables for ``bytes.translate``.
LOWER_BYTES = LOWER.tobytes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POW[name] = np.cumprod(p)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the hash can serve as a bucket or bitmap position."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of a binary column, of about ``limit`` bytes; a longer row stands alone. Null counts as empty."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each document the index of its first word (one more entry at the end)."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~separator[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from the prefix sums of a polynomial hash."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def fixed_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the spans of ``size`` bytes from every place on, as ``span_hashes`` gives them."""
    n = max(len(sums) - size, 0)
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[size:] - sums[:n]) * down[:n] + U(size) * U(0xD6E8FEB86659FD93))


def planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, low bytes first, then the next: sorted or small numbers compress well in a shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel() if len(b) else np.zeros(0, dtype)
