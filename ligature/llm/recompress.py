"""Recompression of texts: locally consistent names for runs and pairs of words.

A round replaces runs of one symbol, and then pairs (a, b) of symbols whose names fall on the left and the right side,
by new symbols. A name is a fingerprint of what it stands for, so tasks agree on all names without a shared table, and
the side of a name is one of its bits in each round; no symbol can be in two pairs. Equal stretches of words so get
equal symbols, but near their ends, where the words outside have a say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .rolling import mix

_FACTOR = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Symbols:
    """The symbols of texts in a row: names, the words [start, end) they stand for, and the words [low, high) that
    decided on them; those that the end of a text decided on reach beyond it."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


def words(prints: np.ndarray, counts: np.ndarray) -> Symbols:
    """One symbol for each word; texts lie one place apart, so that what lies outside a text is none of another."""
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(prints)) + 2 * text + 1
    return Symbols(prints, at, at + 1, at, at + 1, text)


def joined(s: Symbols, name: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
    return Symbols(name, s.start[first], s.end[last], low[first], high[last], s.text[first])


def reach(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol whether a neighbour follows in its text, the same before it, and the reach of these neighbours."""
    n = len(s)
    after = np.zeros(n, bool)
    after[:-1] = s.text[1:] == s.text[:-1]
    before = np.zeros(n, bool)
    before[1:] = after[:-1]
    low, high = s.start - 1, s.end + 1
    low[1:] = np.where(before[1:], s.low[:-1], low[1:])
    high[:-1] = np.where(after[:-1], s.high[1:], high[:-1])
    return after, before, low, high


def runs(s: Symbols) -> Symbols:
    """Runs of one symbol become one, named by the symbol and how often it stands there."""
    if not len(s):
        return s
    after, _, low, high = reach(s)
    same = np.zeros(len(s), bool)
    same[:-1] = after[:-1] & (s.name[1:] == s.name[:-1])
    first = np.flatnonzero(~np.concatenate([[False], same[:-1]]))
    last = np.flatnonzero(~same)
    n = last - first + 1
    name = np.where(n > 1, mix(s.name[first] * _FACTOR + n.astype(np.uint64)), s.name[first])
    # The neighbours decided that a run ends there.
    return joined(s, name, first, last, low, high)


def pairs(s: Symbols, salt: int) -> Symbols:
    """A left symbol with a right one behind it becomes one."""
    if not len(s):
        return s
    after, before, low, high = reach(s)
    left = mix(s.name ^ np.uint64(salt * 2 + 1)) & np.uint64(1) == 0
    head = np.zeros(len(s), bool)
    head[:-1] = after[:-1] & left[:-1] & ~left[1:]
    tail = np.concatenate([[False], head[:-1]])
    first = np.flatnonzero(~tail)
    paired = head[first]
    last = first + paired
    name = np.where(paired, mix(s.name[first] * _FACTOR + mix(s.name[last])), s.name[first])
    # A left symbol stays alone because of the next one, a right symbol because of the one before.
    low = np.where(left, s.low, low)
    high = np.where(left & ~head, high, s.high)
    return joined(s, name, first, last, low, high)


def rounds(s: Symbols, n: int, first: int = 0) -> Symbols:
    """s after n rounds of runs and pairs; first numbers them, as each round has sides of its own."""
    for k in range(first, first + n):
        s = pairs(runs(s), k)
    return s
