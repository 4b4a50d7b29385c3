"""Polynomial fingerprints of all substrings of a row of symbols, by prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Odd multipliers; one fingerprint for each.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which close fingerprints part."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random value for each byte.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base, and of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) <= n:
        size = -(-(n + 1) // _STEP) * _STEP
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _POWERS[base] = (out[0], out[1])
    return held


class Prints:
    """Fingerprints of the substrings of data: bytes, or symbols that stand for themselves as 64-bit values."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        power, self.inverse = powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((VALUES[data] if data.dtype == np.uint8 else data) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, n: int) -> np.ndarray:
        """Those of every n symbols in a row."""
        out = self.sums[n:] - self.sums[:-n]
        out *= self.inverse[: len(out)]
        return out
