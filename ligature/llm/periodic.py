"""Periodic runs of words, found online on sparse diagonals.

A run of period q is a diagonal of matches at lag q: word i equals word i - q for length - q words in a row. The scan
goes through a text once. At each word its earlier occurrence increments the match length of the lag between them; a
lag that isn't incremented at a word has ended there, and is emitted at once if its diagonal was long enough.

Taking all earlier occurrences of a bare word costs the square of its count. A run has 3 q matches at least, so for
lags from 2**k up to 2**(k+1) a word counts as the same only together with the words before it, L = 2**(k+1) in all.
Then the nearest earlier occurrence is the only one that matters: within a run of smallest period q <= L, a nearer one
at q' would give L + q' words the periods q and q', so also their greatest common divisor, and q were not the smallest
(Fine and Wilf). For the same reason a diagonal of a multiple of the period never becomes active, and each run comes out
once, with its smallest period. Occurrences are found by sorting fingerprints of 64 bits; at each level only words whose
shorter context recurs are sorted. So a text of n words costs n log n at most, also when it is one word repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .rolling import Prints, mix
from .shingles import blocks, word_prints

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Documents whose hash is a multiple of REWRITTEN get a periodic end, of 3 to 10 periods, before the search.
REWRITTEN = 10

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """For each of n words the number of the word that takes its place, for a tenth of the documents by hash."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % REWRITTEN:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def occurrences(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, context): the words, in order, whose nearest earlier occurrence within its text is lag words before.

    words are fingerprints of all texts in a row, counts the words of each text. context is the number of words that
    agree; each word has at most one entry for each level of lags.
    """
    prints = Prints(words)
    text = np.repeat(np.arange(len(counts)), counts)
    begin, most = np.repeat(np.cumsum(counts) - counts, counts), np.repeat(counts // LEAST_PERIODS, counts)
    open_ = np.arange(len(words))
    found = []
    low = 1
    while len(open_):
        context = 2 * low
        open_ = open_[(most[open_] >= low) & (open_ - begin[open_] >= context - 1)]
        key = mix(prints.of(open_ - context + 1, open_ + 1) + mix(text[open_].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        later = order[same[:-1]]
        lag = open_[later] - open_[order[np.flatnonzero(same[:-1]) - 1]]
        here = (lag >= low) & (lag < context) & (lag <= most[open_[later]])
        found.append((open_[later[here]], lag[here], np.full(here.sum(), context)))
        again = np.zeros(len(key), bool)
        again[order] = same[:-1] | same[1:]
        open_ = open_[again]
        low = context
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, lag, context = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, at))
    return at[order], lag[order], context[order]


def diagonals(at: list[int], lags: list[int], contexts: list[int]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one text, by the online scan of its occurrences, by start and period."""
    runs: list[tuple[int, int, int]] = []
    matched: dict[int, int] = {}
    last: dict[int, int] = {}

    def end(q: int) -> None:
        m = matched.pop(q)
        e = last.pop(q) + 1
        if m + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            runs.append((e - m - q, m + q, q))

    now = -1
    for i, q, context in zip(at, lags, contexts, strict=True):
        if i != now:
            for x in [x for x, e in last.items() if e < i - 1]:
                end(x)
            now = i
        matched[q] = matched[q] + 1 if q in last else context
        last[q] = i
    for x in list(last):
        end(x)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def found(ids: list[int | None], texts: list[str | None], rewrite: bool = True) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs) of each text, after the rewriting."""
    prints, counts = word_prints(texts)
    ends = np.cumsum(counts)
    places = [rewritten(i, int(n)) if rewrite else None for i, n in zip(ids, counts, strict=True)]
    for b, e, place in zip(ends - counts, ends, places, strict=True):
        if place is not None:
            prints[b:e] = prints[b:e][place]
    at, lag, context = occurrences(prints, counts)
    bounds = np.searchsorted(at, np.concatenate([ends - counts, ends[-1:]]))
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        if places[k] is not None:
            words = [words[j] for j in places[k].tolist()]
        x = slice(bounds[k], bounds[k + 1])
        yield words, diagonals((at[x] - (ends[k] - counts[k])).tolist(), lag[x].tolist(), context[x].tolist())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: bool = True) -> DataFrame:
    """One row for each row of docs: n_runs, the longest run, and digests of all runs and of the words that stay.

    A run is a stretch of words with smallest period q, of six words and four periods at least, that no neighbour
    extends. Unless rewrite is false, the end of a tenth of the documents, by the hash of doc_id, is made periodic
    first. Null and empty texts have no words and no run; ties for the longest run go to the smallest start, then
    period. A null doc_id stays null and isn't rewritten. Repeated rows are separate documents; an empty table gives an
    empty result; other columns aren't read. Texts of any length are scanned whole, each within one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for b, e in blocks(texts):
                for words, runs in found(ids[b:e], texts[b:e], rewrite):
                    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rest = b" ".join(collapsed(words, runs))
                    out.append((len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RESULT)
