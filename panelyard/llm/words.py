"""Words of whole texts as arrays over their UTF-8 bytes.

Batches are cut into pieces of bounded bytes first, so memory follows the longest text and not the batch. The word
classes of the contracts only name ASCII characters, so they are exact on bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

PIECE = 1 << 20
LONG_WORD = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A look-up table of 256 flags that are true in the given ranges of bytes, ends included."""
    flags = np.zeros(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: [^\x20\x09-\x0D]
SPACED = ~table((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], of lower-cased text
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns memory that the allocators hold to the system: a worker outlives its tasks, and stages follow each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def filtered(docs: DataFrame, text: str, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose texts the mask holds for; decided row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(mask(piece.column(text)), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (and the last ends). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return (_LOWER[buf] if lower else buf), offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (and of all words)."""
    inside = flags[buf]
    before = np.zeros(len(buf), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = PIECE + 2 * LONG_WORD
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: differences of a running polynomial, shifted to the span's start, mixed."""
    forward, back = _power_tables()
    out = np.zeros(len(starts), dtype=np.uint64)
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG_WORD)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), 7)
    some = np.flatnonzero(sizes <= LONG_WORD) if len(long) else None
    s, e = (starts, ends) if some is None else (starts[some], ends[some])
    got = np.zeros(len(s), dtype=np.uint64)
    at = 0
    while at < len(s):
        base = int(s[at])
        to = int(np.searchsorted(s, base + PIECE))
        stop = int(e[at:to].max())
        run = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum((buf[base:stop].astype(np.uint64) + np.uint64(1)) * forward[: stop - base], out=run[1:])
        a, b = s[at:to] - base, e[at:to] - base
        got[at:to] = mix((run[b] - run[a]) * back[a] + (b - a).astype(np.uint64))
        at = to
    if some is None:
        return got
    out[some] = got
    return out


def grams(h: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours; element i is the run that starts at i."""
    m = max(len(h) - n + 1, 0)
    acc, f = h[:m].copy(), np.uint64(factor | 1)
    for j in range(1, n):
        acc *= f
        acc += h[j : j + m]
    return mix(acc)


def grams_at(h: np.ndarray, at: np.ndarray, n: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """What ``grams`` gives for the runs that start at ``at``."""
    acc, f = h[at], np.uint64(factor | 1)
    for j in range(1, n):
        acc = acc * f + h[at + j]
    return mix(acc)


class Members:
    """Whether a number is among given 64-bit numbers: one probe of a bit table, then an exact look-up for few."""

    def __init__(self, values: np.ndarray, bits: int = 22):
        self.values = np.unique(values.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, dtype=bool)
        self.flags[(self.values >> self.shift).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Positions in x of members."""
        if not len(self.values):
            return np.zeros(0, dtype=np.int64)
        near = np.flatnonzero(self.flags[(x >> self.shift).astype(np.int64)])
        return near[self.values[np.minimum(np.searchsorted(self.values, x[near]), len(self.values) - 1)] == x[near]]
