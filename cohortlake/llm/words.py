"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, no Python loop per word.

Equality of words is equality of 64-bit hashes (random byte values times powers of an odd number, then mixed).
Exact callers confirm what they find on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
SPACE, WORD, MARK = 0, 1, 2

_rng = np.random.default_rng(20240108)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def _classes(space: list[int], mark: list[int] = []) -> np.ndarray:
    out = np.full(256, WORD, np.uint8)
    out[space] = SPACE
    out[mark] = MARK
    return out


_WHITE = [32, *range(9, 14)]
_ALNUM = {*range(48, 58), *range(65, 91), *range(97, 123)}
#: words are runs of anything but ASCII white space
BY_SPACE = _classes(_WHITE)
#: words are runs of ASCII letters, digits and non-ASCII characters
BY_LETTER = _classes([i for i in range(128) if i not in _ALNUM])
#: as BY_LETTER, and runs of other visible characters are words too
WITH_MARKS = _classes(_WHITE, [i for i in range(128) if i not in _ALNUM and i not in _WHITE])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([out[:1], np.full(n - 1, base, np.uint64)]), out=out)
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_UNBASE, size)
    return _tables["up"][:n], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi``: hash, byte start and end, and row (counted from ``lo``) of each."""

    lo: int
    hi: int
    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: index of the first word of each row, with the total at the end
    first: np.ndarray
    #: byte at which each row starts, with the end of the last
    row_start: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1 of one row, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def of_bytes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = True, lo: int = 0) -> Words:
    """Words of the rows that ``offsets`` cut ``data`` into."""
    rows, n = len(offsets) - 1, len(data)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return Words(lo, lo + rows, data, empty.astype(np.uint64), empty, empty, empty, np.zeros(rows + 1, np.int64), offsets)
    data = (_LOWER if lower else _SAME)[data]
    kind = classes[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    real = kind[start] != SPACE
    start, end = start[real], end[real]
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(lo, lo + rows, data, hashes, start, end, doc, first, offsets)


def of_column(column: pa.Array, classes: np.ndarray, lower: bool = True, target: int = CHUNK) -> Iterator[Words]:
    """Words of a text column, a chunk of rows at a time; a null text has none."""
    for lo, hi, data, offsets in chunks(column, target):
        yield of_bytes(data, offsets, classes, lower, lo)


def chunks(column: pa.Array, target: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``target`` bytes with their bytes and offsets; memory follows the longest text only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + target, "right")) - 1)
        hi = min(hi, n, lo + 65_000)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words, by its first word; runs may cross rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _STEP[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _STEP[j]
    return mix(out ^ np.uint64(k))


def row_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one row; fewer words make one run, no words none."""
    return windows(hashes, min(k, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)
