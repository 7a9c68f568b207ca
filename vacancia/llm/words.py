"""Hashes of words and of word sequences, for whole texts at a time."""

from __future__ import annotations

import numpy as np

from .common import per_process

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, at least ``size`` of them."""
    held = per_process(("powers", which), dict)
    if len(held.get("up", ())) < size:
        room = 1 << max(16, size.bit_length())
        base = _BASES[which]
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(room, factor, np.uint64)
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
    return held["up"], held["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space, np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)


def _ranges(values: np.ndarray, starts, stops, which: int) -> np.ndarray:
    up, down = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mixed((sums[stops] - sums[starts]) * down[starts])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a 64-bit hash, the first byte, the byte after the last) of each run of bytes without white space."""
    space, letters = per_process("word tables", _tables)
    found = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(found) + 2, np.int8)
    inside[1:-1] = ~space[found]
    edges = np.flatnonzero(np.diff(inside))
    starts, stops = edges[::2], edges[1::2]
    return _ranges(letters[found], starts, stops, 0) + (stops - starts).astype(np.uint64), starts, stops


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words."""
    starts = np.arange(max(0, len(words) - size + 1))
    return _ranges(words, starts, starts + size, 1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word sequences, A-Z in lower case; of all its words if they
    are fewer; none without words."""
    words = word_hashes(text.encode().lower())[0]
    return np.unique(sequence_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)
