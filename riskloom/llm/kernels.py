"""Vectorised text kernels on Arrow string buffers: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: White space of the word definition: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longest stretch of symbols hashed at once (powers are kept for it), and the most that one polynomial covers.
BLOCK, PIECE = 1 << 18, 256
_POWERS: dict[str, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, most: int = 1 << 20):
    """Yield (first row, end row, bytes, offsets from 0) of about `most` bytes; rows stay whole."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes with word_byte, cut at row borders."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = word_byte[data]
    first = np.zeros(n + 1, bool)
    first[at[at <= n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        with np.errstate(over="ignore"):
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(BLOCK + 1, _BASE, U64), np.full(BLOCK + 1, inverse, U64)
            up[0] = down[0] = 1
            _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (the public splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_FOLD = U64(0xD6E8FEB86659FD93)


def span_hashes(symbols: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [s, e) of an integer array, from prefix sums of a polynomial; both rise.

    A polynomial modulo 2**64 can't tell some long words of regular structure apart (Thue-Morse words
    of 1,024 symbols), so one covers PIECE symbols at most, and the pieces' mixed values are folded,
    which isn't linear. Works in blocks of BLOCK symbols, so memory doesn't follow the text."""
    out = np.zeros(len(s), U64)
    up, down = _powers()
    i = 0
    while i < len(s):
        lo = int(s[i])
        if e[i] - lo > BLOCK:
            out[i] = _long_hash(symbols[lo : e[i]])
            i += 1
            continue
        j = int(np.searchsorted(e, lo + BLOCK, "right"))
        j = max(i + 1, j)
        hi = int(e[j - 1])
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((symbols[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((total[np.minimum(b, a + PIECE)] - total[a]) * down[a])
        more, step = np.flatnonzero(b - a > PIECE), PIECE
        while len(more):
            x = a[more] + step
            piece = (total[np.minimum(b[more], x + PIECE)] - total[x]) * down[x]
            out[i + more] = mix(out[i + more] * _FOLD ^ mix(piece + U64(step)))
            step += PIECE
            more = more[b[more] - a[more] > step]
        i = j
    return out


def _long_hash(symbols: np.ndarray) -> np.uint64:
    """The same fold for one span beyond BLOCK."""
    up, h = _powers()[0], np.zeros(1, U64)
    for lo in range(0, len(symbols), PIECE):
        part = symbols[lo : lo + PIECE].astype(U64) + U64(1)
        piece = (part * up[: len(part)]).sum(dtype=U64)
        h = mix(h * _FOLD ^ mix(np.array([piece + U64(lo)]))) if lo else mix(np.array([piece]))
    return h[0]


def crc32_mod(ids, modulus: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids], np.int64)
