"""Words of texts as 64-bit hashes, in numpy, without a Python object a word.

A word's hash covers all its bytes: every byte stands for a fixed random number, and
the sum of these times powers of an odd number is taken over the whole block at once
as a running sum, of which a word's part is a difference. The mixed sum is the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.llm.common import WHITE

BLANK = np.zeros(256, bool)
BLANK[list(WHITE)] = True
#: Bytes that are hashed at a time; a block ends at white space, so a longer word makes it longer.
BLOCK = 1 << 18
_RNG = np.random.default_rng(5)
NUMBERS = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept up to the longest asked for within four blocks."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, BLOCK + 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) <= 4 * BLOCK:
        _powers[base] = out
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a block start and end."""
    blank = np.empty(len(data) + 2, bool)
    blank[0] = blank[-1] = True
    np.take(BLANK, data, out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word of a block."""
    if not len(start):
        return np.zeros(0, np.uint64)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(NUMBERS[data] * powers(BASE, len(data)), out=run[1:])
    return mixed((run[end] - run[start]) * powers(UNBASE, len(data))[start] + (end - start).astype(np.uint64))


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, number of each word's text) of the texts, whole texts in blocks of about `size` bytes.

    A text longer than that is cut at white space and goes on in the next block.
    """
    held, of, room = [], [], 0

    def made():
        data = np.frombuffer(b"\n".join(held), np.uint8)
        start, end = spans(data)
        edges = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        return data, start, end, np.array(of, np.int64)[np.searchsorted(edges, start, side="right")]

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text) if room + len(text) - at <= size else at + size - room
            while stop < len(text) and text[stop] not in WHITE:
                stop += 1
            held.append(text[at:stop])
            of.append(i)
            room += stop - at
            at = stop
            if room >= size:
                yield made()
                held, of, room = [], [], 0
    if held:
        yield made()


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of one text."""
    parts = [hashes(data, start, end) for data, start, end, _ in blocks([text])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
