"""A wavelet matrix of token ids in one compressed file: access, counting and places of a token without reading the rest.

Ids are numbered by falling frequency within the file, so that the upper bit-planes are mostly zero. Each plane holds one bit of each number, the rows of a plane ordered by
the bits above it, zeros first. Planes are cut into blocks of BLOCK bits, each compressed by itself, with the count of ones before each block beside them: a rank reads one
block, a select one block after a binary search. Laid out as: MAGIC, blocks of all planes, directory (compressed), its length (8 bytes), MAGIC.

The file also holds the documents' ids (nulls apart) and lengths. A file without documents or tokens is allowed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard

MAGIC, BLOCK, LEVEL = b"CAIRNWM1", 1 << 16, 1
_BYTES = BLOCK // 8


def build(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, null: np.ndarray) -> bytes:
    """The file of ids (whole documents laid end to end, lengths of each, their numbers and which of these are null)."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    if len(ids) and int(ids.max()) < 1 << 22:
        times = np.bincount(ids)
        symbols = np.flatnonzero(times).astype(np.uint32)
        order = np.lexsort((symbols, -times[symbols]))
        place = np.zeros(len(times), dtype=np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        place[symbols[order]] = np.arange(len(order))
        now = place[ids]
    else:
        symbols, codes, times = np.unique(ids.astype(np.uint32), return_inverse=True, return_counts=True)
        order = np.lexsort((symbols, -times))
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        now = place[codes.ravel()]
    levels = max(1, int(len(symbols) - 1).bit_length())
    out, at, zeros, ones, offsets = [MAGIC], len(MAGIC), [], [], []
    for b in range(levels - 1, -1, -1):
        bits = now & now.dtype.type(1 << b) != 0
        packed = np.packbits(bits, bitorder="little").tobytes()
        for lo in range(0, len(packed), _BYTES):
            offsets.append(at)
            raw = packed[lo : lo + _BYTES]
            part = squeeze(raw)
            part = b"\x01" + part if len(part) < len(raw) else b"\x00" + raw
            out.append(part)
            at += len(part)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ones.append(np.concatenate(([0], np.cumsum(sums))))
        zeros.append(len(bits) - int(ones[-1][-1]))
        now = np.concatenate((np.compress(~bits, now), np.compress(bits, now)))
    offsets.append(at)
    columns = {"head": np.array([len(ids), levels], np.int64), "symbols": symbols[order].astype(np.int64), "zeros": np.array(zeros, np.int64), "ones": np.concatenate(ones), "offsets": np.array(offsets, np.int64), "lengths": lengths.astype(np.int64), "docs": docs.astype(np.int64), "null": null.astype(np.int64)}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([(c, pa.list_(pa.int64())) for c in columns])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64())) for v in columns.values()], names=list(columns)))
    directory = squeeze(sink.getvalue().to_pybytes())
    return b"".join([*out, directory, len(directory).to_bytes(8, "little"), MAGIC])


class Wavelet:
    """Reads such a file through `read(offset, length)`; only blocks that a question needs are read, and kept."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        tail = read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet file, or cut short")
        length = int.from_bytes(tail[:8], "little")
        self._squeeze = zstandard.ZstdDecompressor()
        with pa.ipc.open_stream(self._squeeze.decompress(read(size - 16 - length, length))) as r:
            d = {c: col[0].values.to_numpy() for c, col in zip(r.schema.names, r.read_all().columns, strict=True)}
        self.n, self.levels = int(d["head"][0]), int(d["head"][1])
        self.symbols, self.lengths, self.docs, self.null = d["symbols"], d["lengths"], d["docs"], d["null"].astype(bool)
        self._zeros, self._ones, self._offsets = d["zeros"], d["ones"].reshape(self.levels, -1), d["offsets"]
        self._read, self._held, self._many = read, {}, self._ones.shape[1] - 1
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    @classmethod
    def of(cls, data: bytes) -> Wavelet:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bits of one block as bytes of 0 and 1."""
        got = self._held.get((level, k))
        if got is None:
            at = level * self._many + k
            raw = self._read(int(self._offsets[at]), int(self._offsets[at + 1] - self._offsets[at]))
            raw = self._squeeze.decompress(raw[1:]) if raw[0] else raw[1:]
            got = self._held[level, k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: min(BLOCK, self.n - k * BLOCK)]
        return got

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK)
        return int(self._ones[level, k]) + (int(self._block(level, k)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (rising, from 0) ones or zeros of a plane."""
        before = self._ones[level] if bit else np.minimum(np.arange(self._many + 1) * BLOCK, self.n) - self._ones[level]
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), np.int64)
        for k in np.unique(block):
            own = block == k
            out[own] = np.flatnonzero(self._block(level, int(k)) == bit)[nth[own] - before[k]] + int(k) * BLOCK
        return out

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._rank(level, i)
            i = int(self._zeros[level]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.symbols[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, int]:
        """Where the token's occurrences from lo on and before hi stand below the last plane, and its number (-1: none)."""
        code = np.flatnonzero(self.symbols == token)
        if not len(code) or lo >= hi:
            return 0, 0, -1
        for level in range(self.levels):
            a, b = self._rank(level, lo), self._rank(level, hi)
            one = int(code[0]) >> (self.levels - 1 - level) & 1
            lo, hi = (int(self._zeros[level]) + a, int(self._zeros[level]) + b) if one else (lo - a, hi - b)
        return lo, hi, int(code[0])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token from place lo on and before hi."""
        a, b, _ = self._range(token, max(lo, 0), self.n if hi is None else min(hi, self.n))
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of a token, rising."""
        a, b, code = self._range(token, max(lo, 0), self.n if hi is None else min(hi, self.n))
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                break
            one = code >> (self.levels - 1 - level) & 1
            at = self._select(level, one, at - int(self._zeros[level]) if one else at)
        return at

    def select(self, token: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence."""
        a, b, code = self._range(token, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = np.array([a + nth])
        for level in range(self.levels - 1, -1, -1):
            one = code >> (self.levels - 1 - level) & 1
            at = self._select(level, one, at - int(self._zeros[level]) if one else at)
        return int(at[0])

    def document(self, places: np.ndarray) -> np.ndarray:
        """Row of the document that each place is in."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def ids(self) -> np.ndarray:
        """All ids in order: planes are merged from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.concatenate([self._block(level, k) for k in range(self._many)]).view(bool) if self.n else np.zeros(0, bool)
            z, up = int(self._zeros[level]), np.empty_like(now)
            np.place(up, ~bits, now[:z])
            np.place(up, bits, now[z:] | now.dtype.type(1 << (self.levels - 1 - level)))
            now = up
            for k in range(self._many):
                self._held.pop((level, k), None)
        return self.symbols.astype(np.uint32)[now] if self.n else np.zeros(0, np.uint32)
