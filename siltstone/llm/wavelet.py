"""A file of token ids as a wavelet matrix: one bit-plane for each bit of an id, highest first.

Below each plane the ids are dealt stably, those with bit 0 before those with bit 1. A
plane is cut into blocks of BLOCK bytes, each compressed by itself; a directory holds the blocks'
places and the ones before each block, so that rank and select touch a few blocks only.

Layout, little-endian: MAGIC, then u64: ids, documents, planes, bytes of the two document
columns; then those columns (doc_ids as i64 with a null flag byte each, lengths as u64, both
compressed); then for each plane u64 zeros, u64 blocks, and (place, size, ones before) as u64 for
each block; then the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
BLOCK = 1 << 15
#: Ids that are dealt at a time.
PART = 1 << 14


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _places(bits: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """Part by part: where it lies, its places of zeros, where these go among the dealt ids, and so for its ones.

    Taking by place is faster than by mask where bits change often, if the places stay in the processor's cache.
    """
    a, b = 0, zeros
    for at in range(0, len(bits), PART):
        part = bits[at : at + PART]
        zero, one = np.flatnonzero(~part), np.flatnonzero(part)
        yield slice(at, at + len(part)), zero, slice(a, a + len(zero)), one, slice(b, b + len(one))
        a, b = a + len(zero), b + len(one)


def write(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of documents that lie one after the other in ids."""
    n = len(ids)
    planes = int(ids.max()).bit_length() if n else 0
    flags = np.array([x is None for x in doc_ids], "u1")
    ident = _packed(flags.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    sizes = _packed(np.array(lengths, "<u8").tobytes())
    now, directory, blocks, place = ids.astype("<u2" if planes <= 16 else "<u4"), [], [], 0
    for level in reversed(range(planes)):
        bits = (now & now.dtype.type(1 << level)).astype(bool)
        raw = np.packbits(bits, bitorder="little")
        entries, before = [], 0
        for at in range(0, len(raw), BLOCK):
            part = raw[at : at + BLOCK]
            blocks.append(_packed(part.tobytes()))
            entries.append((place, len(blocks[-1]), before))
            place += len(blocks[-1])
            before += int(np.bitwise_count(part).sum())
        directory.append(struct.pack("<QQ", n - before, len(entries)) + np.array(entries, "<u8").tobytes())
        dealt = np.empty_like(now)
        for here, zero, to_zeros, one, to_ones in _places(bits, n - before):
            part = now[here]
            dealt[to_zeros], dealt[to_ones] = part.take(zero), part.take(one)
        now = dealt
    return b"".join([MAGIC, struct.pack("<5Q", n, len(doc_ids), planes, len(ident), len(sizes)), ident, sizes, *directory, *blocks])


class Wavelet:
    """A file opened from its bytes (or any buffer, such as a memory map)."""

    def __init__(self, raw) -> None:
        self.raw = memoryview(raw)
        if bytes(self.raw[:8]) != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, self.n_docs, self.planes, a, b = struct.unpack_from("<5Q", self.raw, 8)
        at = 48
        self._ident, self._sizes = self.raw[at : at + a], self.raw[at + a : at + a + b]
        at += a + b
        self.zeros, self.blocks = [], []
        for _ in range(self.planes):
            zeros, k = struct.unpack_from("<QQ", self.raw, at)
            self.zeros.append(zeros)
            self.blocks.append(np.frombuffer(self.raw, "<u8", 3 * k, at + 16).reshape(k, 3))
            at += 16 + 24 * k
        self._at = at
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(doc_ids, lengths), in order."""
        raw = _unpacked(self._ident)
        ids = np.frombuffer(raw, "<i8", self.n_docs, self.n_docs).tolist()
        return [None if f else x for f, x in zip(raw[: self.n_docs], ids)], np.frombuffer(_unpacked(self._sizes), "<u8").astype(np.int64)

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._held:
            if len(self._held) > 256:
                self._held.clear()
            place, size, _ = map(int, self.blocks[plane][k])
            self._held[plane, k] = np.frombuffer(_unpacked(self.raw[self._at + place : self._at + place + size]), "u1")
        return self._held[plane, k]

    def ids(self) -> np.ndarray:
        """All ids: the planes from the last to the first, each dealing undone."""
        out = np.zeros(self.n, "<u2" if self.planes <= 16 else "<u4")
        for plane in reversed(range(self.planes)):
            raw = b"".join(_unpacked(self.raw[self._at + int(p) : self._at + int(p) + int(s)]) for p, s, _ in self.blocks[plane])
            bits = np.unpackbits(np.frombuffer(raw, "u1"), count=self.n, bitorder="little").view(bool)
            z, undone = self.zeros[plane], np.empty_like(out)
            out[z:] |= out.dtype.type(1 << (self.planes - 1 - plane))
            for here, zero, from_zeros, one, from_ones in _places(bits, z):
                part = undone[here]
                part[zero], part[one] = out[from_zeros], out[from_ones]
            out = undone
        return out

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // (8 * BLOCK))[i // 8 % BLOCK]) >> (i % 8) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, 8 * BLOCK)
        if k == len(self.blocks[plane]):
            return self.n - self.zeros[plane]
        part = self._block(plane, k)[: rest // 8 + 1]
        ones = int(self.blocks[plane][k][2]) + int(np.bitwise_count(part[: rest // 8]).sum())
        return ones + ((int(part[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the bit's k-th occurrence in a plane, from 0."""
        ones = self.blocks[plane][:, 2].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * 8 * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for plane in range(self.planes):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            out = 2 * out + bit
            i = self.zeros[plane] + ones if bit else i - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, end)
            start, end = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.planes - 1 - plane) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id between two places."""
        if token >> self.planes:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of an id's k-th occurrence, from 0."""
        if token >> self.planes or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, 0)[0] + k
        for plane in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - plane) & 1
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i
