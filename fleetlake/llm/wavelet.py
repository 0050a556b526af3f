"""A wavelet matrix over one shard of token ids, in one compressed block of bytes.

Ids are renamed by falling frequency, so the upper bit planes are mostly zero and compress well. Each plane is cut
into blocks of ``BLOCK_BITS`` bits, compressed one by one, with the number of ones before each block: rank needs one
block a plane, select a binary search over the counts and one block a plane. Opening a shard reads the header only.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

BLOCK_BITS = 1 << 16
_BLOCK_BYTES = BLOCK_BITS // 8
_MAGIC = b"WVM1"
_LEVEL = 1


def _align(n: int) -> int:
    return -(-n // 8) * 8


class WaveletMatrix:
    """Access, rank, select, counting and occurrence look-up on a sequence of ids, read from :meth:`build`'s bytes."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, n_ids, self.levels, n_blocks = struct.unpack_from("<4sQIIQ", data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at = _align(struct.calcsize("<4sQIIQ"))

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += _align(out.nbytes)
            return out

        self.ids = take("<u4", n_ids)
        self.counts = take("<u8", n_ids)
        self.zeros = take("<u8", self.levels)
        self.ones_before = take("<u8", self.levels * n_blocks).reshape(self.levels, n_blocks)
        self.ends = take("<u8", self.levels * n_blocks).reshape(self.levels, n_blocks)
        self._payload, self._data, self._n_blocks = at, data, n_blocks
        self._code = {int(v): i for i, v in enumerate(self.ids)}
        self._unpack = zstandard.ZstdDecompressor()
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    # --- writing

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        """The bytes of the wavelet matrix of ``ids`` (unsigned integers)."""
        ids = np.asarray(ids)
        n = len(ids)
        if n:
            count = np.zeros(int(ids.max()) + 1, dtype=np.int64)
            for a in range(0, n, BLOCK_BITS * 16):
                part = np.bincount(ids[a:a + BLOCK_BITS * 16])
                count[: len(part)] += part
            present = np.flatnonzero(count)
            order = present[np.argsort(-count[present], kind="stable")]
        else:
            count, order = np.zeros(0, np.int64), np.zeros(0, np.int64)
        levels = max(1, int(len(order) - 1).bit_length()) if len(order) else 1
        rename = np.zeros(len(count), dtype=np.uint16 if levels <= 16 else np.uint32)
        rename[order] = np.arange(len(order))
        codes = rename[ids] if n else np.zeros(0, np.uint16)
        n_blocks = -(-n // BLOCK_BITS)
        pack = zstandard.ZstdCompressor(level=_LEVEL)
        zeros, before, ends, payload, size = [], [], [], [], 0
        for level in range(levels - 1, -1, -1):
            bits = (codes & codes.dtype.type(1 << level)) != 0
            plane = np.packbits(bits, bitorder="little").tobytes()
            ones = np.add.reduceat(bits, np.arange(0, n, BLOCK_BITS), dtype=np.int64) if n else np.zeros(0, np.int64)
            before.append(np.cumsum(ones) - ones)
            for b in range(n_blocks):
                block = pack.compress(plane[b * _BLOCK_BYTES:(b + 1) * _BLOCK_BYTES])
                payload.append(block)
                size += len(block)
                ends.append(size)
            low = codes.take(np.flatnonzero(~bits))
            zeros.append(len(low))
            codes = np.concatenate([low, codes.take(np.flatnonzero(bits))])
        out = [struct.pack("<4sQIIQ", _MAGIC, n, len(order), levels, n_blocks)]
        for dtype, part in (("<u4", order), ("<u8", count[order]), ("<u8", zeros), ("<u8", np.concatenate(before)), ("<u8", ends)):
            out.append(np.asarray(part).astype(dtype).tobytes())
        return b"".join(x.ljust(_align(len(x)), b"\0") for x in out) + b"".join(payload)

    # --- reading

    def _block(self, level: int, b: int) -> bytes:
        end = int(self.ends[level, b])
        at = level * self._n_blocks + b
        start = int(self.ends.flat[at - 1]) if at else 0
        return self._unpack.decompress(self._data[self._payload + start:self._payload + end])

    def _bits(self, level: int, b: int) -> np.ndarray:
        """The bits of one block; blocks looked up one by one are kept."""
        key = (level, b)
        if key not in self._cache:
            self._cache[key] = np.unpackbits(np.frombuffer(self._block(level, b), np.uint8), bitorder="little")
        return self._cache[key]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        b, r = divmod(i, BLOCK_BITS)
        if b == self._n_blocks:
            return self.n - int(self.zeros[level])
        return int(self.ones_before[level, b]) + (int(self._bits(level, b)[:r].sum()) if r else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the ``k``-th (from 0) bit of that value in a plane."""
        before = self.ones_before[level].astype(np.int64)
        if not bit:
            before = np.arange(self._n_blocks) * BLOCK_BITS - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        inside = np.flatnonzero(self._bits(level, b)[: self.n - b * BLOCK_BITS] == bit)
        return b * BLOCK_BITS + int(inside[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(level, i)
            code = code << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return int(self.ids[code])

    def _span(self, code: int, i: int) -> tuple[int, int]:
        """Where the first ``i`` positions' occurrences of a code lie below the last plane."""
        start, end = 0, i
        for level in range(self.levels):
            if code >> (self.levels - 1 - level) & 1:
                start = int(self.zeros[level]) + self._rank1(level, start)
                end = int(self.zeros[level]) + self._rank1(level, end)
            else:
                start, end = start - self._rank1(level, start), end - self._rank1(level, end)
        return start, end

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first ``i`` ids."""
        code = self._code.get(token)
        if code is None or i <= 0:
            return 0
        start, end = self._span(code, min(i, self.n))
        return end - start

    def count(self, token: int) -> int:
        """How often ``token`` occurs, from the header alone."""
        code = self._code.get(token)
        return 0 if code is None else int(self.counts[code])

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = self._code[token]
        i = self._span(code, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def positions(self, token: int, first: int = 0, most: int | None = None) -> list[int]:
        """The positions of ``token``, from its ``first``-th occurrence on."""
        last = self.count(token) if most is None else min(self.count(token), first + most)
        return [self.select(token, k) for k in range(first, last)]

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        dtype = np.uint16 if self.levels <= 16 else np.uint32
        codes = np.zeros(self.n, dtype=dtype)
        for level in range(self.levels - 1, -1, -1):
            plane = b"".join(self._block(level, b) for b in range(self._n_blocks))
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").astype(bool)
            z = int(self.zeros[level])
            above = np.empty(self.n, dtype=dtype)
            above[np.flatnonzero(~bits)] = codes[:z]
            above[np.flatnonzero(bits)] = codes[z:] | dtype(1 << (self.levels - 1 - level))
            codes = above
        return self.ids[codes] if self.n else np.zeros(0, np.uint32)
