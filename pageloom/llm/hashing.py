"""Hashes of words and word windows of a whole batch of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers (invertible modulo 2**64) of the polynomial hashes.
BASE, STEP, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def spans_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run of bytes other than 0x20 and 0x09-0x0D."""
    raw = np.frombuffer(text, dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~SPACE[raw]
    change = np.diff(word)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def span_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``text``; equal spans hash alike wherever they stand."""
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, width: int, step: int = STEP) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive word hashes (none if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(step) + words[j : j + n]
    return mixed(out)
