"""Sets of hashed 5-word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from .rolling import Prints, mix

WORDS = 5
#: Texts are joined up to about this many bytes.
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def blocks(texts: list[str | None], size: int = BLOCK):
    """(first, past the last) of runs of texts of about size bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_prints(texts: list[str | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, counts): those of the words of all texts in a row, and the number of words of each text."""
    coded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    data = _LOWER[data] if fold else data
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    edge = np.diff(_SPACE[data].astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[ends > 0] if len(ends) and ends[0] == 0 else ends
    word = mix(Prints(data).of(starts, ends) + (ends - starts).astype(np.uint64))
    return word, np.bincount(np.searchsorted(text_ends, starts, "right"), minlength=len(texts))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct shingle hashes of text i are hashes[ends[i-1]:ends[i]].

    Letters A-Z count as lower case. A text of fewer words than a shingle has its whole sequence as one, a text
    without words has none.
    """
    word, counts = word_prints(texts, fold=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(word)
    full = max(0, n - WORDS + 1)
    h = np.zeros(full, np.uint64)
    for j in range(WORDS):
        h = h * _FACTOR + word[j : j + full]
    inside = owner[:full] == owner[WORDS - 1 : WORDS - 1 + full] if full else np.zeros(0, bool)
    hashes, of = [mix(h[inside])], [owner[:full][inside]]
    begin = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        x = np.uint64(counts[i])
        for w in word[begin[i] : begin[i] + counts[i]]:
            x = np.uint64((int(x) * int(_FACTOR) + int(w)) & (2**64 - 1))
        hashes.append(mix(np.array([x], np.uint64)))
        of.append(np.array([i]))
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[first], np.cumsum(np.bincount(of[first], minlength=len(texts)))
