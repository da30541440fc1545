"""64-bit hashes of many short byte strings at once.

Equal hashes are a hint, not a proof: who needs one compares bytes, or a second hash, beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20_240_501)
#: A random number for each byte value.
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U) | U(1)
GOLDEN = U(0x9E3779B97F4A7C15)
_places = np.ones(0, U)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def places(n: int) -> np.ndarray:
    """A random factor for each place 0, 1, 2, ...: splitmix64's stream, the same in each process.

    Powers of one number won't do: with them the sums of words like "abba baab ..." and their complements are equal modulo 2^64.
    """
    global _places
    if n > len(_places):
        _places = mix64(np.arange(1, max(n, 2 * len(_places), 1024) + 1, dtype=U) * GOLDEN) | U(1)
    return _places[:n]


def of_spans(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each span of ``data``; spans begin at ``starts`` (the first at 0) and fill it."""
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return mix64(np.add.reduceat(BYTE[data] * places(int(sizes.max()))[place], starts) + sizes.astype(U))


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from a to z of a text column with their bytes and where each ends; about ``most`` bytes at once, or one row."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, z, data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a]
        a = z
