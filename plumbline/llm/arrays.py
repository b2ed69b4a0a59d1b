"""Whole numbers as short binary values, and look-up in sorted arrays of hashes."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of their places, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    wide = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + len(x).to_bytes(6, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:7], "little")
    out = np.zeros((n, 8), np.uint8)
    if n and wide:
        out[:, :wide] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[7:], max_output_size=n * wide), np.uint8).reshape(wide, n).T
    return out.view(np.uint64).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as differences."""
    return packed(np.diff(np.asarray(x, np.uint64), prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, the sum of each one's counts)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = starts(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Found:
    """Look-up in an ascending array of evenly spread 64-bit hashes, from an index of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(4, len(hashes).bit_length() + 1))
        n = 1 << (64 - int(self.shift))
        self.start = np.searchsorted(hashes >> self.shift, np.arange(n + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't held."""
        out = np.full(len(asked), -1, np.int64)
        slot = (asked >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.hashes[at] == asked[todo]
            out[todo[same]] = at[same]
            on = ~same & (at + 1 < end)
            todo, at, end = todo[on], at[on] + 1, end[on]
        return out
