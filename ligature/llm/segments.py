"""All segmentations of many words at once: the pieces at each place, found by a hash table of prefixes in NumPy."""

from __future__ import annotations

import numpy as np

from .pieces import load

MARK = "▁"
#: Words are handled in groups of about so many letters; a longer word is a group of its own.
CHUNK_LETTERS = 60_000
#: Sums are brought back to 1 after so many letters, so that they never leave the range of a double.
RESCALE = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Arcs:
    """The pieces in a group of words: word, begin, end and id of each, in the order of their ends."""

    def __init__(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, lengths: np.ndarray, reach: int) -> None:
        order = np.lexsort((word, end))
        self.word, self.begin, self.end, self.ids = word[order], begin[order], end[order], ids[order]
        self.lengths, self.reach = lengths, reach


class Table:
    """All pieces of a vocabulary, and one stand-in for a letter that is no piece. A hash table holds their prefixes."""

    def __init__(self, path: str) -> None:
        names = list(load(path).ids)
        self.longest = max(map(len, names))
        self.mark = names.index(MARK)
        self.unknown = len(names)
        self.none = self.unknown + 1
        self.size = self.none + 1
        found: dict[int, list] = {}
        for k, name in enumerate(names):
            h = 0
            for c in name[:-1]:
                h = self._step(h, c)
                found.setdefault(h, [self.none, True])[1] = True
            found.setdefault(self._step(h, name[-1]), [self.none, False])[0] = k
        self.bits = len(found).bit_length() + 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.taken, self.more = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, bool)
        self.values = np.full(1 << self.bits, self.none, np.int32)
        for h, (k, more) in found.items():
            at = h >> (64 - self.bits)
            while self.taken[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.taken[at], self.values[at], self.more[at] = h, True, k, more

    @staticmethod
    def _step(h: int, letter: str) -> int:
        return ((h + ord(letter)) * int(_MULTIPLIER)) & (2**64 - 1)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Where the table holds each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero(self.keys[at] != h)
        while len(open_):
            open_ = open_[self.taken[at[open_]]]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[self.keys[at[open_]] != h[open_]]
            at[open_[~self.taken[at[open_]]]] = -1
            open_ = open_[at[open_] >= 0]
        missed = (at >= 0) & (self.keys[at] != h)
        at[missed] = -1
        return at

    def arcs(self, words: list[str]) -> Arcs:
        """The pieces at all places of the words, each with the mark put before it."""
        lengths = np.array([len(w) + 1 for w in words])
        letters = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.cumsum(lengths) - lengths
        stop = np.repeat(first + lengths, lengths)
        at, h, single = np.arange(len(letters)), np.zeros(len(letters), np.uint64), np.zeros(len(letters), bool)
        parts = []
        for k in range(self.longest):
            inside = at + k < stop[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = (h + letters[at + k]) * _MULTIPLIER
            slot = self.slots(h)
            hit = (slot >= 0) & (self.values[slot] != self.none)
            if k == 0:
                single[at[hit]] = True
            parts.append((at[hit], k + 1, self.values[slot[hit]]))
            go = (slot >= 0) & self.more[slot]
            at, h = at[go], h[go]
        rest = np.flatnonzero(~single)
        parts.append((rest, 1, np.full(len(rest), self.unknown, np.int32)))
        places = np.concatenate([x for x, _, _ in parts])
        begin = places - first[word[places]]
        size = np.concatenate([np.full(len(x), n) for x, n, _ in parts])
        return Arcs(word[places], begin, begin + size, np.concatenate([k for _, _, k in parts]), lengths, self.longest)


def forward(arcs: Arcs, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs): the sum over the segmentations of the first e letters is sums[w, e, ...] * exp(logs[w, e, ...]).

    p: piece (and language).
    """
    words, longest, n = len(arcs.lengths), int(arcs.lengths.max()), arcs.reach
    sums = np.zeros((words, longest + 1, *p.shape[1:]))
    logs = np.zeros_like(sums)
    sums[:, 0] = 1.0
    cut = np.searchsorted(arcs.end, np.arange(1, longest + 2))
    for e in range(1, longest + 1):
        some = slice(cut[e - 1], cut[e])
        w = arcs.word[some]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        logs[:, e] = logs[:, e - 1]
        sums[w[first], e] = np.add.reduceat(sums[w, arcs.begin[some]] * p[arcs.ids[some]], first)
        if e % RESCALE == 0:
            rescale(sums[:, max(0, e - n + 1) : e + 1], logs[:, max(0, e - n + 1) : e + 1])
    return sums, logs


def backward(arcs: Arcs, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs) as in forward, over the segmentations of what follows place b; p of one language."""
    words, longest, n = len(arcs.lengths), int(arcs.lengths.max()), arcs.reach
    order = np.lexsort((arcs.word, arcs.begin))
    word, begin, end, ids = (x[order] for x in (arcs.word, arcs.begin, arcs.end, arcs.ids))
    sums, logs = np.zeros((words, longest + 1)), np.zeros((words, longest + 1))
    sums[np.arange(words), arcs.lengths] = 1.0
    cut = np.searchsorted(begin, np.arange(longest + 1))
    for b in range(longest - 1, -1, -1):
        some = slice(cut[b], cut[b + 1])
        w = word[some]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        logs[:, b] = logs[:, b + 1]
        sums[w[first], b] = np.add.reduceat(sums[w, end[some]] * p[ids[some]], first)
        if b % RESCALE == 0:
            rescale(sums[:, b : b + n], logs[:, b : b + n])
    return sums, logs


def rescale(sums: np.ndarray, logs: np.ndarray) -> None:
    """Bring the largest of the sums that are still used to 1, in place; all of them have one scale."""
    most = sums.max(axis=1, keepdims=True)
    most[most == 0] = 1.0
    sums /= most
    logs += np.log(most)


def chunks(words: list[str]):
    """Indices of words of like length, so that little is padding."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    k = 0
    while k < len(order):
        n = 1
        while k + n < len(order) and (n + 1) * (len(words[order[k + n]]) + 1) <= CHUNK_LETTERS:
            n += 1
        yield order[k : k + n]
        k += n


def log_words(table: Table, words: list[str], p: np.ndarray) -> np.ndarray:
    """[w, language]: log of the sum over all segmentations of each word."""
    out = np.zeros((len(words), p.shape[1]))
    for at in chunks(words):
        arcs = table.arcs([words[i] for i in at])
        sums, logs = forward(arcs, p)
        end = np.arange(len(at)), arcs.lengths
        out[at] = np.log(sums[end]) + logs[end]
    return out


def expected(table: Table, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the segmentations of words, weighted by n; p of one language."""
    out = np.zeros(table.size)
    for at in chunks(words):
        arcs = table.arcs([words[i] for i in at])
        (ahead, la), (behind, lb) = forward(arcs, p), backward(arcs, p)
        end = np.arange(len(at)), arcs.lengths
        whole = np.log(ahead[end]) + la[end]
        b, e = (arcs.word, arcs.begin), (arcs.word, arcs.end)
        share = ahead[b] * p[arcs.ids] * behind[e] * np.exp(la[b] + lb[e] - whole[arcs.word])
        out += np.bincount(arcs.ids, share * n[at][arcs.word], table.size)
    return out


_TABLES: dict[str, Table] = {}


def table(path: str) -> Table:
    if path not in _TABLES:
        _TABLES[path] = Table(path)
    return _TABLES[path]
