"""Removal of word passages that an earlier document holds too, by recompression.

A window of `length` words is removed where the same words start in a document with a smaller doc_id. One row for each
window would shuffle many times the input, so Spark asks for symbols of the recompressed texts (`recompress.py`) instead,
whose names equal stretches share, from long ones to short ones and at last single windows:

1. high symbols, of about forty words: each two in a row are named together. If a smaller doc_id has the same name, all
   windows within are settled at once: long repeats take few rows.
2. low symbols, of about two words. Where eight words alone decide that a symbol stands at their start (an interior
   symbol), equal stretches hold it too. A window's anchor is the interior symbol with the least name near its start,
   named by those words. Which anchors do documents share? Only windows with a shared anchor can repeat. A filter of
   fixed size tells shared anchors; where it lets others pass, or a window has no anchor, that costs work, not
   correctness.
3. the windows that are still open, by the name of all their words: Spark finds the first document of each name, and each
   document gets the list of names it is the first of. Its other open windows are repeats. A window settled before is
   never settled in the smallest document that holds it, so no witness is missing.

Each round counts names with partial aggregation. Texts are read by each round, as their words' names take more room. Names are
fingerprints of 64 bits, so the result is exact up to collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, sliced
from .membership import bit_of_hash, has_hash, marked, members
from .recompress import Symbols, pairs, rounds, runs, words
from .rolling import Prints, mix
from .shingles import blocks, word_prints
from .skew import counted, spread_join
from .suffix_dedup import merged, window_minima

#: A window is so many words.
LENGTH = 13
#: An anchor lies at most this part of a window behind its start; the rest of the window's words name it.
LEAD = 5 / 13
#: Rounds of pairs for low symbols, after one of runs, and further rounds for high ones.
LOW_ROUNDS = 3
HIGH_ROUNDS = 9
KEY = ["doc_id", "h"]
SPANS = "array<struct<lo:int,hi:int>>"
NAMED = "name long, doc_id long, h long, lo int, hi int"
NONE = np.iinfo(np.uint64).max

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def low_symbols(prints: np.ndarray, counts: np.ndarray) -> Symbols:
    s = runs(words(prints, counts))
    for k in range(LOW_ROUNDS):
        s = pairs(s, k)
    return s


def batch_texts(batch: pa.RecordBatch, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[str]]]:
    """(rows, doc_ids, word names, words of each text, settled spans of each text, texts) by blocks of texts.

    Of rows repeated within a batch only one comes, if once is true.
    """
    ids, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    some = np.array(list({key: i for i, key in enumerate(zip(ids.tolist(), h.tolist(), strict=True))}.values()) if once else range(batch.num_rows), np.int64)
    batch = batch.take(pa.array(some))
    texts, ends = batch.column(2).to_pylist(), batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
    lo, hi = (x.to_numpy(zero_copy_only=False) for x in batch.column(3).flatten().flatten())
    for b, e in blocks(texts):
        yield some[b:e], ids[some[b:e]], *word_prints(texts[b:e]), [np.stack([lo[x:y], hi[x:y]]) for x, y in zip(ends[b:e], ends[b + 1 : e + 1], strict=True)], texts[b:e]


def unsettled(counts: np.ndarray, spans: list[np.ndarray], length: int) -> np.ndarray:
    """Whether each word starts a window of its text that no settled span [lo, hi] of window starts holds."""
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    depth = np.zeros(n + 1, np.int64)
    for begin, (lo, hi) in zip((ends - counts).tolist(), spans, strict=True):
        if len(lo):
            np.add.at(depth, lo + begin, 1)
            np.add.at(depth, hi + begin + 1, -1)
    return (np.cumsum(depth)[:-1] == 0) & (np.arange(n) + length <= np.repeat(ends, counts))


def anchors(prints: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the word of the anchor of the window that starts there, -1 without any, and the anchors' names by word."""
    lead = int(length * LEAD)
    own = length - lead
    s = low_symbols(prints, counts)
    inner = np.flatnonzero(s.high - s.low <= own)
    text = s.text[inner]
    word = s.low[inner] - 2 * text - 1
    ends = np.cumsum(counts)
    inside = (word >= (ends - counts)[text]) & (word + own <= ends[text])
    word = word[inside]
    names = np.full(len(prints) + lead, NONE)
    names[word] = np.minimum(mix(Prints(prints).of(word, word + own)), NONE - np.uint64(1))
    least = window_minima(names, lead + 1)
    # The place of the least name among the next lead + 1 words.
    at = np.full(len(prints), -1)
    for k in range(lead, -1, -1):
        here = names[k : k + len(prints)] == least
        at = np.where(here & (least != NONE), np.arange(len(prints)) + k, at)
    return at, names


def high_pairs(rows: DataFrame, length: int) -> DataFrame:
    """Each two high symbols in a row, or a symbol alone in its text, with the window starts [lo, hi] that lie within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for some, _, prints, counts, _, _ in batch_texts(batch):
                s = rounds(low_symbols(prints, counts), HIGH_ROUNDS, LOW_ROUNDS)
                if not len(s):
                    continue
                before = np.zeros(len(s), bool)
                before[1:] = s.text[1:] == s.text[:-1]
                after = np.append(before[1:], False)
                head = np.flatnonzero(after | ~before & ~after)
                tail = np.where(after[head], np.minimum(head + 1, len(s) - 1), head)
                name = np.where(after[head], mix(mix(s.name[head]) + s.name[tail] * np.uint64(3)), s.name[head])
                begin = np.cumsum(counts) - counts + 2 * np.arange(len(counts)) + 1
                text = s.text[head]
                lo, hi = s.start[head] - begin[text], s.end[tail] - begin[text] - length
                x = hi >= lo
                of = pa.array(some[text[x]])
                yield pa.record_batch([pa.array(name[x].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(lo[x].astype(np.int32)), pa.array(hi[x].astype(np.int32))], [c.split()[0] for c in NAMED.split(", ")])

    return rows.mapInArrow(run, NAMED)


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose name a smaller doc_id has too."""
    least = counted(rows, ["name"], F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = cut(least.where("least < most").select("name", "least", "n"))
    return spread_join(rows, least, ["name"], deal=F.xxhash64(*KEY)).where("least < doc_id").drop("least", "n", "name")


def shared_names(rows: DataFrame, length: int) -> np.ndarray:
    """A filter of the names of anchors of unsettled windows that several documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, ids, prints, counts, spans, _ in batch_texts(batch):
                at, names = anchors(prints, counts, length)
                used = np.unique(at[unsettled(counts, spans, length) & (at >= 0)])
                name, doc = names[used], ids[np.repeat(np.arange(len(counts)), counts)[used]]
                order = np.lexsort((doc, name))
                name, doc = name[order], doc[order]
                new = np.ones(len(name), bool)
                new[1:] = name[1:] != name[:-1]
                # The least and the largest document of each name.
                take = np.flatnonzero(new | np.append(new[1:], True)[: len(new)])
                yield pa.record_batch([pa.array(name[take].view(np.int64)), pa.array(doc[take])], ["name", "doc_id"])

    found = rows.mapInArrow(run, "name long, doc_id long").groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return members(found.where("a < b"), bit=bit_of_hash("name"))


def open_windows(prints: np.ndarray, counts: np.ndarray, spans: list[np.ndarray], bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, name): the unsettled windows whose anchor, if they have one, may be shared."""
    at, names = anchors(prints, counts, length)
    shared = np.append(has_hash(bits, names), True)
    word = np.flatnonzero(unsettled(counts, spans, length) & shared[at])
    return word, mix(Prints(prints).of(word, word + length))


def first_names(rows: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """(doc_id, name): the first document of each open window."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, ids, prints, counts, spans, _ in batch_texts(batch):
                word, name = open_windows(prints, counts, spans, shared.value, length)
                doc = ids[np.repeat(np.arange(len(counts)), counts)[word]]
                order = np.lexsort((doc, name))
                name, doc = name[order], doc[order]
                new = np.ones(len(name), bool)
                new[1:] = name[1:] != name[:-1]
                yield pa.record_batch([pa.array(name[new].view(np.int64)), pa.array(doc[new])], ["name", "doc_id"])

    return rows.mapInArrow(run, "name long, doc_id long").groupBy("name").agg(F.min("doc_id").alias("doc_id"))


def first_kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words of windows that start in a document with a smaller doc_id too are removed; windows are judged on the input.
    Null and empty texts have no words; texts shorter than a window lose nothing. Rows that share a doc_id are one
    document, so they don't remove each other's words; rows without doc_id are neither judged nor witnesses. An empty
    table gives an empty result; other columns aren't read. Texts of any length are taken whole.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("t"))
    named, none = every.where("doc_id is not null"), F.array().cast(SPANS)
    with Tables(docs.sparkSession) as tables:
        settled = cut(repeated(tables.put(high_pairs(named.withColumn("done", none), length), "high-symbols")))
    # Only texts with settled spans meet these in a shuffle.
    lists = settled.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("done"))
    both = marked(named, settled, "h")
    copies = cut(counted(both.where("_in"), KEY))
    some = cut(spread_join(both.where("_in"), lists, KEY, how="left", sizes=copies).select(*KEY, "t", F.coalesce("done", none).alias("done")))
    rows = both.where("not _in").select(*KEY, "t", none.alias("done")).unionByName(some)

    bits = shared_names(rows, length)
    firsts = cut(first_names(rows, bits, length))
    own = firsts.groupBy("doc_id").agg(F.collect_list("name").alias("own"))
    judged = marked(rows, firsts, "doc_id", "_first")
    alone = judged.where("not _first").select(*KEY, "t", "done", F.array().cast("array<long>").alias("own"))
    owners = judged.where("_first").join(own, "doc_id", "left").select(*KEY, "t", "done", F.coalesce("own", F.array().cast("array<long>")).alias("own"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column(4)
            names, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for some, _, prints, counts, spans, texts in batch_texts(batch, once=False):
                word, name = open_windows(prints, counts, spans, shared.value, length)
                begin = np.cumsum(counts) - counts
                bounds = np.searchsorted(word, np.append(begin, len(prints)))
                out = []
                for k, (row, t) in enumerate(zip(some.tolist(), texts, strict=True)):
                    x = slice(bounds[k], bounds[k + 1])
                    again = word[x][~np.isin(name[x], names[ends[row] : ends[row + 1]])] - begin[k]
                    w = t.encode().split()
                    total = len(w)
                    gone = [*zip(again.tolist(), again.tolist(), strict=True), *zip(*spans[k].tolist(), strict=True)]
                    for b, e in reversed(merged(gone, length)):
                        del w[b:e]
                    out.append((total, total - len(w), hashlib.sha256(b" ".join(w)).hexdigest()))
                cols = list(zip(*out, strict=True)) or [()] * 3
                kinds = [pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([batch.column(0).take(pa.array(some)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    nameless = every.where("doc_id is null").select(
        "doc_id", F.size(F.regexp_extract_all("t", F.lit(r"([^\x20\x09-\x0D]+)"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join(F.regexp_extract_all("t", F.lit(r"([^\x20\x09-\x0D]+)")), " ").cast("binary"), 256).alias("kept_sha256"),
    )
    return alone.unionByName(owners).mapInArrow(run, RESULT).unionByName(nameless)
