"""Byte-level text primitives on Arrow columns, in numpy: blocks of documents, words, lines, hashes.

Documents of a batch are laid end to end as UTF-8 with a line feed after each, so that no word or
line crosses documents; the work on a batch goes block by block, and a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
SEP = 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words of `[^\x20\x09-\x0D]+`
GRAPHIC = np.ones(256, dtype=bool)
GRAPHIC[[0x20, 9, 10, 11, 12, 13]] = False

#: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def blocks(col: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, starts): documents lo..hi, null as empty; starts has hi-lo+1 offsets, each text ends one before the next start."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + limit)
        part = raw[offs[lo] : offs[hi]]
        ends = offs[lo + 1 : hi + 1] - offs[lo]
        buf = np.empty(len(part) + hi - lo, dtype=np.uint8)
        gap = np.zeros(len(buf), dtype=bool)
        at = ends + np.arange(hi - lo)
        gap[at] = True
        buf[gap] = SEP
        buf[~gap] = part
        yield lo, hi, buf, np.concatenate(([0], at + 1))
        lo = hi


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        step = np.concatenate(([0], step))
    if len(inside) and inside[-1]:
        step = np.concatenate((step, [len(inside)]))
    return step[0::2], step[1::2]


def owner(starts: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Document index of each (rising) position."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(pos, starts)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a well-known 64-bit hash: each input bit reaches each output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, BLOCK * 2)
        for key, m in (("p", _M), ("q", _MINV)):
            a = np.full(size, m, dtype=np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    p, q = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_doc(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of flags within each document (bytes)."""
    return np.add.reduceat(flags, starts[:-1], dtype=np.int64)


def count_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n)


class Probe:
    """Open-addressing table from uint64 keys to row numbers, looked up by whole arrays; size follows its keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        self.depth = 0
        while len(left):
            self.depth += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of rows that want one slot the last stays
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & self.mask
        self.held = np.zeros(1 << bits, dtype=np.uint64)
        used = self.slots >= 0
        self.held[used] = self.keys[self.slots[used]]

    def _home(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(k)
        row = self.slots[at]
        wrong = np.flatnonzero((row >= 0) & (self.held[at] != k))
        for _ in range(self.depth):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & self.mask
            row[wrong] = self.slots[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.held[at[wrong]] != k[wrong])]
        row[wrong] = -1  # no key stands further from its home than `depth`
        return row


def grams(buf: np.ndarray, starts: np.ndarray, width: int, outside: int = SEP) -> np.ndarray:
    """The last `width` bytes up to each position as one integer; before a document's start stands the byte `outside`."""
    key = buf.astype(np.uint64)
    for j in range(1, min(width, len(buf))):
        key[j:] |= buf[:-j].astype(np.uint64) << np.uint64(8 * j)
    for o in range(width - 1):
        at = starts[:-1] + o
        at = at[at < starts[1:]]
        keep = (1 << (8 * (o + 1))) - 1
        before = sum(outside << (8 * j) for j in range(o + 1, width))
        key[at] = (key[at] & np.uint64(keep)) | np.uint64(before)
    return key


def tail(key: np.ndarray, width: int) -> np.ndarray:
    """The last `width` bytes of packed keys."""
    return key if width >= 8 else key & np.uint64((1 << (8 * width)) - 1)
