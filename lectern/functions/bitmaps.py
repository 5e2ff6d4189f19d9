"""Compressed bitmaps over dense integer keys.

Keys are split into blocks of 2**16. A block holds a sorted uint16 array while it
has up to 4,096 members and 8 KB of bits beyond that, so neither sparse nor full
blocks waste space.
"""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 16
ARRAY_MOST = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    """low: sorted distinct uint16. The array itself, or 8 KB of bits (uint8)."""
    if len(low) <= ARRAY_MOST:
        return low
    bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _unpack(block: np.ndarray) -> np.ndarray:
    return block if block.dtype == np.uint16 else np.flatnonzero(np.unpackbits(block)).astype(np.uint16)


class Bitmap:
    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, np.ndarray] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def of(cls, ids: np.ndarray) -> "Bitmap":
        ids = np.unique(np.asarray(ids, dtype=np.int64))
        if not len(ids):
            return cls()
        high = ids >> BLOCK_BITS
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        low = (ids & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        return cls({int(high[a]): _pack(low[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(ids)])})

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for k, a in self.blocks.items():
            b = other.blocks.get(k)
            if b is None:
                out[k] = a
            elif a.dtype == np.uint8 and b.dtype == np.uint8:
                kept = a & ~b
                if kept.any():
                    out[k] = _pack(_unpack(kept))
            else:
                kept = np.setdiff1d(_unpack(a), _unpack(b), assume_unique=True)
                if len(kept):
                    out[k] = _pack(kept)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        if not self.blocks:
            return np.zeros(0, dtype=np.int64)
        return np.concatenate([(k << BLOCK_BITS) + _unpack(b).astype(np.int64) for k, b in sorted(self.blocks.items())])

    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.blocks.values())
