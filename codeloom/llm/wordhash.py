"""Hashes of all words of many texts at once, with numpy over Arrow's buffers.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums
over the whole buffer, then mixed.  ``A-Z`` count as ``a-z``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)

#: Bytes of text that are worked on at once (a longer text is hashed in such stretches).
SLICE = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker keeps; for a longer stretch (one word, that is) they are made anew.
_KEPT = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = min(_KEPT, 1 << (n - 1).bit_length()) if n <= _KEPT else n
    made = []
    for b in (_BASE, _BACK):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64, out=p))
    if size <= _KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


@dataclass
class Words:
    """Words of consecutive texts: ``first[i]`` is the index of text i's first word."""

    hashes: np.ndarray
    sizes: np.ndarray  # bytes
    first: np.ndarray  # of each text, and the total
    row: int  # of the first text within its batch
    parts: list[tuple[np.ndarray, np.ndarray]] | None = None  # (word, hash) of its beginnings and endings

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _words(data: np.ndarray, bounds: np.ndarray, row: int, separator: np.ndarray, affixes: tuple[int, ...] = ()) -> Words:
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), row)
    word = ~separator[data]
    ahead = np.empty(n, bool)  # is a word's byte of the same text right ahead
    ahead[0] = False
    ahead[1:] = word[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    ahead[inner] = False
    starts = np.flatnonzero(word & ~ahead)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = bounds[1:-1]
    after[last[(last > 0) & (last <= n)] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    size = ends - starts
    parts = []
    for k in affixes:
        long = np.flatnonzero(size > k)
        for kind, a in ((1, starts[long]), (2, ends[long] - k)):
            parts.append((long, mix((sums[a + k] - sums[a]) * down[a] + U(1000 * kind + k))))
    return Words(mix(h + size.astype(np.uint64)), size, np.searchsorted(starts, bounds), row, parts)


def slices(column, limit: int = SLICE, separator: np.ndarray = _SEPARATOR, affixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """The words of an Arrow string column, some texts at a time; null counts as empty.

    ``affixes``: lengths in bytes of beginnings and endings to hash as well.
    """
    for data, bounds, row in buffers(column, limit):
        if len(data) <= limit:
            yield _words(data, bounds, row, separator, affixes)
        else:  # one text
            yield _long(data, row, separator, affixes, limit)


def _long(data: np.ndarray, row: int, separator: np.ndarray, affixes: tuple[int, ...], limit: int) -> Words:
    """The words of one long text, hashed in stretches that end at separators."""
    found: list[Words] = []
    at = n = 0
    while at < len(data):
        stop = min(at + limit, len(data))
        while stop < len(data) and not separator[data[stop]]:
            gap = np.flatnonzero(separator[data[stop : stop + limit]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + limit, len(data))
        w = _words(data[at:stop], np.array([0, stop - at]), row, separator, affixes)
        w.parts = [(k + n, h) for k, h in w.parts or [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * (2 * len(affixes))]
        found.append(w)
        at, n = stop, n + len(w.hashes)
    parts = [tuple(map(np.concatenate, zip(*own, strict=True))) for own in zip(*(w.parts for w in found), strict=True)]
    return Words(np.concatenate([w.hashes for w in found]), np.concatenate([w.sizes for w in found]), np.array([0, n]), row, parts)


def buffers(column, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, bounds of the texts in them, row of the first) of some texts at a time."""
    import pyarrow as pa

    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        stop = min(stop, n)
        yield data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], at
        at = stop


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each ``n`` consecutive words (across texts too: mask those out)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = h[:k] * _PLACE[0]
    for j in range(1, n):
        out += h[j : j + k] * _PLACE[j]
    return mix(out)


def shingles(w: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words has its whole sequence as its one shingle.
    """
    all_runs = runs(w.hashes, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(all_runs[a : b - n + 1])
        elif b > a:
            h = w.hashes[a:b]
            yield mix(np.array([int((h * _PLACE[8 : 8 + b - a]).sum(dtype=np.uint64)) + b - a & (2**64 - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
