"""Rolling and word hashes and word spans over Arrow string batches, with numpy. Pure helpers used inside tasks.

Texts are their UTF-8 bytes. Words are maximal runs of bytes other than space and \\x09-\\x0D; in UTF-8 no
byte of a longer character falls in that set, so bytes and characters give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the entropy of the high bits over all bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Roller:
    """h(x[s:s+size]) = sum of table[x[i]] * base^(i-s) modulo 2^64, for all windows of one buffer at once.

    It picks places; it doesn't tell strings apart: some long strings (Thue-Morse words) share a value for every base.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1 & (2**64 - 1)
        self.power = self.inverse = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n).bit_length()
            self.power, self.inverse = np.full(size + 1, self.base, U64), np.full(size + 1, pow(self.base, -1, 2**64), U64)
            self.power[0] = self.inverse[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)

    def windows(self, data: np.ndarray, size: int) -> np.ndarray:
        self.grow(len(data))
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=prefix[1:])
        n = len(prefix) - size
        return mix((prefix[size:] - prefix[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, U64)


#: Odd multipliers of the two lanes of 128-bit hashes.
LANES = np.random.default_rng(23).integers(0, 2**64, (2, 4), dtype=U64) | U64(1)
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
LONG_WORD = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span, 128 bits together: eight bytes at a time, each step a bijective mix of the state.

    Spans longer than LONG_WORD are hashed by xxh3-128.
    """
    blocks = np.zeros(len(data) // 8 + 3, U64)
    blocks.view(np.uint8)[: len(data)] = data
    size = end - start
    first, second = (mix((size.astype(U64) + U64(1)) * lane[0]) for lane in LANES)
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = start[live], size[live]
    while len(live):
        i, shift = at >> 3, ((at & 7) << 3).astype(U64)
        value = (blocks[i] >> shift | blocks[i + 1] << U64(1) << (U64(63) - shift)) & MASKS[np.minimum(left, 8)]
        first[live] = mix((first[live] ^ value) * LANES[0, 1])
        second[live] = mix(second[live] * LANES[1, 1] + value * LANES[1, 2])
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    view = memoryview(data)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        x = xxhash.xxh3_128_intdigest(view[int(start[i]) : int(end[i])])
        first[i], second[i] = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return first, second


def run_hashes(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of size hashes, by doubling: runs of 1, 2, 4, ... are joined pairwise and mixed."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    a, b = LANES[lane, 2], LANES[lane, 3]
    out, done, power, width = None, 0, values, 1
    while True:
        if size & width:
            out = power[:n] if out is None else mix(out[:n] * a + (power[done : done + n] ^ U64(width)) * b)
            done += width
        width *= 2
        if width > size:
            return out
        power = mix(power[: len(power) - width // 2] * a + (power[width // 2 :] ^ U64(width)) * b)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first, last) document ranges of about size bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words and, for each document, where its words begin in them."""
    n = len(data)
    solid = ~WHITE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = edge[edge > 0] - 1
    ends[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def unique_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, how often each)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether the pair there is new) so that equal pairs are neighbours, ascending by first."""
    order = np.argsort(first, kind="stable")
    x, y = first[order], second[order]
    same, differ = x[1:] == x[:-1], y[1:] != y[:-1]
    if (same & differ).any():
        order = np.lexsort((second, first))
        x, y = first[order], second[order]
        same, differ = x[1:] == x[:-1], y[1:] != y[:-1]
    return order, np.concatenate([[True], ~same | differ]) if len(order) else np.empty(0, bool)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
