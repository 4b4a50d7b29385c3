"""Removal of strings that occur more than once, by prefix doubling over sampled positions.

A string of `length` symbols (bytes or words) is a duplicate if it starts anywhere else too. Ranking every position of a
corpus would shuffle many times its size, so positions are sampled by their content: each window start p goes with the
anchor in [p, p + length / 2), the place with the least fingerprint, and equal strings have their anchors at equal
distances. Ranks are fingerprints, which tell equal from unequal, as ranks do; every round pairs the rank of a prefix
with the rank of the symbols that follow at a larger offset, groups equal pairs, and drops the positions that have
become unique, until none is left or the pairs cover the whole length:

1. anchors, by the half of the length that every string of their windows holds; unique ones are done;
2. blocks of window starts of the remaining anchors, by the symbols that all strings of the block hold;
3. single window starts, by all symbols.

In each round a group whose members also agree on all symbols that the block's windows cover is wholly duplicated; only
groups that agree on the common symbols and differ outside go on, with one witness for each distinct block. Groups are
counted with partial aggregation; a filter of fixed size then keeps unique rows out of the shuffle, and the join that
marks the rest splits ranks that very many positions share. The result is exact up to collisions of 64-bit fingerprints
within groups that agree on another 64-bit fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, sliced
from .membership import bit_of_hash, has_hash, marked, members
from .rolling import BASES, VALUES, Prints, mix
from .shingles import blocks, word_prints
from .skew import counted, spread_join


@dataclass(frozen=True)
class Unit:
    """What strings are made of: symbols of a gram for anchors, and window starts in the blocks of the two later rounds."""

    name: str
    length: int
    gram: int
    blocks: tuple[int, ...]


BYTES = Unit("bytes", 400, 16, (16, 1))
#: A passage is fifty words, whatever their length and the white space between them.
WORDS = Unit("words", 50, 2, (4, 1))
UNITS = {u.name: u for u in (BYTES, WORDS)}
#: About so many rows go out together.
SLICE_ROWS = 100_000
KEY = ["h", "crc"]
ROW = "h long, crc long, u int, a int, lo int, hi int, c long, s long"
FIELDS = ["h", "crc", "u", "a", "lo", "hi", "c", "s"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i that has as many."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def symbols(texts: list[str | None], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and where each text ends."""
    if unit.name == "words":
        prints, counts = word_prints(texts)
        return prints, np.cumsum(counts)
    coded = [(t or "").encode() for t in texts]
    return VALUES[np.frombuffer(b"".join(coded), np.uint8)], np.cumsum([len(c) for c in coded])


def anchors(texts: list[str | None], unit: Unit = BYTES, length: int | None = None):
    """(text, start of text, anchor, first and last window start, rank of common symbols, rank of all) as arrays.

    Anchor and window starts count from the start of all texts joined.
    """
    length = length or unit.length
    span = length // 2
    data, ends = symbols(texts, unit)
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if len(data) < length:
        return nothing
    one, two = Prints(data, BASES[0]), Prints(data, BASES[1])
    begin = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - begin - length + 1, 0)
    if not windows.any():
        return nothing
    # The high half of a gram's fingerprint, which the multiplication has mixed, above its place.
    grams = one.all(unit.gram)
    grams &= np.uint64(0xFFFFFFFF << 32)
    grams |= np.arange(len(grams), dtype=np.uint64)
    best = window_minima(grams, span).astype(np.uint32)
    before = np.cumsum(windows) - windows
    p = np.arange(windows.sum()) + np.repeat(begin - before, windows)
    anchor = best[p]
    new = np.ones(len(p), bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[before[windows > 0]] = True
    first = np.flatnonzero(new)
    lo, hi, a = p[first], p[np.append(first[1:], len(p)) - 1], anchor[first].astype(np.int64)
    common = mix(one.of(a, a + length - span + 1))
    every = mix(two.of(lo, hi + length) + mix(((a - lo) * 1000 + hi - lo).astype(np.uint64)))
    text = np.searchsorted(ends, lo, "right")
    return text, begin[text], a, lo, hi, common, every


def twice(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The keys and texts of the batch, of equal texts the first two: two are as repeated as more."""
    h, crc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    met: dict[tuple, int] = {}
    some = []
    for i, key in enumerate(zip(h.tolist(), crc.tolist(), strict=True)):
        met[key] = n = met.get(key, 0) + 1
        if n <= 2:
            some.append(i)
    return h[some], crc[some], batch.column(2).take(pa.array(some, pa.int64())).to_pylist()


#: Units and lengths that are searched for together; rows have the number of theirs in `u`.
Strings = list[tuple[Unit, int]]


def ranked(texts: list[str | None], strings: Strings) -> Iterator[tuple]:
    """(u, anchors) of the texts for each of strings; ranks of different units never agree."""
    for u, (unit, length) in enumerate(strings):
        text, start, a, lo, hi, common, every = anchors(texts, unit, length)
        yield u, text, start, a, lo, hi, common ^ tag_of(u), every


def tag_of(u: int) -> np.uint64:
    return mix(np.array([u + 1], np.uint64))[0]


def anchor_groups(docs: DataFrame, strings: Strings) -> DataFrame:
    """(c, n, mixed): ranks of common symbols that n > 1 anchors share, and whether their windows differ elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            _, _, texts = twice(batch)
            for b, e in blocks(texts):
                for *_, common, every in ranked(texts[b:e], strings):
                    yield pa.record_batch([pa.array(common.view(np.int64)), pa.array(every.view(np.int64))], ["c", "s"])

    return groups_of(docs.select(*KEY, "text").mapInArrow(run, "c long, s long"))


def anchor_rows(docs: DataFrame, strings: Strings, repeated: np.ndarray) -> DataFrame:
    """The anchors whose rank of common symbols may be among the repeated ones."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(batches):
            h, crc, texts = twice(batch)
            for b, e in blocks(texts):
                for u, text, start, a, lo, hi, common, every in ranked(texts[b:e], strings):
                    x = has_hash(bits, common)
                    text, start, common, every = text[x], start[x], common[x], every[x]
                    place = [pa.array((v[x] - start).astype(np.int32)) for v in (a, lo, hi)]
                    yield pa.record_batch([pa.array(h[b:e][text]), pa.array(crc[b:e][text]), pa.array(np.full(len(text), u, np.int32)), *place, pa.array(common.view(np.int64)), pa.array(every.view(np.int64))], FIELDS)

    return docs.select(*KEY, "text").mapInArrow(run, ROW)


def block_rows(docs: DataFrame, wanted: DataFrame, strings: Strings, turn: int) -> DataFrame:
    """Rows of the blocks of window starts in the wanted rows, with ranks read from the texts; `single` goes along.

    turn numbers the round, which has a size of blocks for each unit.
    """
    lists = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("u", "a", "lo", "hi", "c", "single")).alias("w"))
    some = marked(docs, wanted, "h").where("_in").drop("_in").dropDuplicates(KEY).join(lists, KEY)

    def put(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(cols, kinds, strict=False)]
        return pa.record_batch([*arrays, pa.array(cols[6].view(np.int64)), pa.array(cols[7].view(np.int64)), pa.array(cols[8])], [*FIELDS, "single"])

    def of_text(text: str, h: int, crc: int, u: int, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: np.ndarray, single: np.ndarray) -> list[np.ndarray]:
        unit, length = strings[u]
        block = unit.blocks[turn]
        data, _ = symbols([text], unit)
        one, two = Prints(data, BASES[0]), Prints(data, BASES[1])
        # Blocks are counted by distance from the anchor, so that they agree between texts.
        near, far = (a - hi) // block, (a - lo) // block
        n = far - near + 1
        row = np.repeat(np.arange(len(a)), n)
        j = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        left, right = a[row] - j * block - block + 1, a[row] - j * block
        begin, end = np.maximum(left, 0), np.minimum(right + length, len(data))
        tag = mix(c[row] + mix(j.astype(np.uint64) + np.uint64(block << 20)))
        common = mix(one.of(np.minimum(right, len(data)), np.maximum(np.minimum(left + length, len(data)), np.minimum(right, len(data)))) ^ tag)
        every = mix(two.of(begin, end) + mix(((begin - left) * 1000 + (right + length - end)).astype(np.uint64)) + tag)
        return [np.full(len(row), h), np.full(len(row), crc), np.full(len(row), u), a[row], np.maximum(left, lo[row]), np.minimum(right, hi[row]), common, every, single[row]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list[np.ndarray]] = []
            h, crc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, (text, w) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                table = pa.RecordBatch.from_struct_array(w.values)
                of = table.column(0).to_numpy()
                a, lo, hi = (table.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
                c, single = table.column(4).to_numpy().view(np.uint64), table.column(5).to_numpy(zero_copy_only=False)
                for u in np.unique(of).tolist():
                    x = of == u
                    out.append(of_text(text, h[i], crc[i], u, a[x], lo[x], hi[x], c[x], single[x]))
                if sum(len(x[0]) for x in out) >= SLICE_ROWS:
                    yield put(out)
                    out = []
            if out:
                yield put(out)

    return some.select(*KEY, "text", "w").mapInArrow(run, ROW + ", single boolean")


def groups_of(rows: DataFrame) -> DataFrame:
    return cut(counted(rows, ["c"], (F.min("s") != F.max("s")).alias("mixed")).where("n > 1"))


def split(rows: DataFrame, groups: DataFrame, tables: Tables, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(duplicated intervals, rows to go on with) of one round; rows: FIELDS and `single`, whether the result counts."""
    interval = [*KEY, "u", "lo", "hi"]
    found = tables.put(spread_join(rows, groups, ["c"]).drop("n"), "equal-prefixes")
    # A group without a row whose result counts is of no use.
    same = found.where("not mixed and single").select(*interval)
    if last:
        return same, None
    mixed = found.where("mixed")
    first = F.min(F.struct(*KEY, "u", "a", "lo", "hi", "single")).alias("r")
    reps = tables.put(counted(mixed, ["c", "s"], first), "distinct-windows")
    equal = spread_join(mixed.where("single"), reps.where("n > 1").select("c", "s", "n"), ["c", "s"]).select(*interval)
    live = cut(counted(reps, ["c"], F.max((F.col("n") == 1) & F.col("r.single")).alias("live")).where("live").select("c", "n"))
    rest = spread_join(reps.withColumnRenamed("n", "copies"), live, ["c"])
    return same.unionAll(equal), rest.select(*(f"r.{k}" for k in (*KEY, "u", "a", "lo", "hi")), "c", (F.col("r.single") & (F.col("copies") == 1)).alias("single"))


def duplicated(docs: DataFrame, strings: Strings) -> DataFrame:
    """(h, crc, u, lo, hi): intervals of window starts whose strings occur elsewhere; docs: h, crc, text (not null).

    All of strings are searched for in the same rounds, so the texts are read and ranks are counted once a round.
    """
    with Tables(docs.sparkSession) as tables:
        groups = anchor_groups(docs, strings)
        rows = anchor_rows(docs, strings, members(groups, bit=bit_of_hash("c"))).withColumn("single", F.lit(True))
        done, rest = split(rows, groups, tables, last=False)
        turns = len(BYTES.blocks)
        for turn in range(turns):
            wanted = cut(rest)
            if wanted.isEmpty():
                break
            found = tables.put(block_rows(docs, wanted, strings, turn), "blocks")
            more, rest = split(found, groups_of(found), tables, last=turn == turns - 1)
            done = done.unionAll(more)
        return cut(done.distinct())


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns h, crc and t: the key of the text, and the text with null as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"t": whole, "h": F.xxhash64(whole), "crc": F.crc32(whole.cast("binary"))})


def merged(intervals: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The runs (start, end) of symbols that the windows of length at the intervals of starts cover."""
    runs: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    return [(b, e) for b, e in runs]


def byte_runs(data: bytes, intervals: list[tuple[int, int]], unit: Unit, length: int) -> list[tuple[int, int]]:
    """The runs of bytes of data that the intervals of window starts remove."""
    runs = merged(intervals, length)
    if unit.name == "words" and runs:
        spans = [m.span() for m in WORD.finditer(data)]
        return [(spans[b][0], spans[e - 1][1]) for b, e in runs]
    return runs


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(data[b:e] for b, e in zip([0, *(e for _, e in runs)], [*(b for b, _ in runs), len(data)], strict=True))


LISTS = "array<struct<u:int,lo:int,hi:int>>"


def with_intervals(docs: DataFrame, strings: Strings) -> tuple[DataFrame, DataFrame]:
    """(docs surely without repeated strings, the others with `iv`, the intervals (number in strings, first, last) of their
    text, null if none); docs: h, crc, t.

    The filter runs in a Python worker of its own, which stays once started. A shuffle parts the others from it, and the rows
    without are best finished by column functions, so that a task never holds two workers.
    """
    found = duplicated(docs.select(*KEY, F.col("t").alias("text")), strings)
    lists = found.groupBy(*KEY).agg(F.collect_list(F.struct("u", "lo", "hi")).alias("iv"))
    both = marked(docs, found, "h")
    copies = cut(counted(both.where("_in"), KEY))
    some = spread_join(both.where("_in"), lists.hint("merge"), KEY, how="left", sizes=copies)
    return both.where("not _in").drop("_in"), some.drop("_in")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = BYTES.length, passage: int = WORDS.length) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words.

    Bytes of strings of `length` bytes that start elsewhere too are removed; n_passage_words counts the words in
    passages of `passage` words that start elsewhere too, which can be shorter. Null texts count as empty; texts below
    these lengths lose nothing. Repeated rows are separate documents, so they remove each other's strings. An empty
    table gives an empty result; other columns aren't read.
    """
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    none, some = with_intervals(rows.drop("text"), [(BYTES, length), (WORDS, passage)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            lists = batch.column(2)
            u, lo, hi = (x.to_numpy().tolist() for x in lists.values.flatten())
            ends = lists.offsets.to_numpy().tolist()
            for t, b, e in zip(batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                data = t.encode()
                runs, words = (merged([(lo[k], hi[k]) for k in range(b, e) if u[k] == v], n) for v, n in enumerate((length, passage)))
                out.append((len(data), sum(e - b for b, e in runs), len(runs), hashlib.sha256(kept(data, runs)).hexdigest(), sum(e - b for b, e in words)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    whole, zero = F.col("t").cast("binary"), F.lit(0).cast("long")
    clean = none.select(
        F.col("doc_id").cast("long"), F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), zero.alias("n_passage_words")
    )
    return clean.unionByName(some.select(F.col("doc_id").cast("long"), "t", "iv").mapInArrow(run, RESULT))


def strip(docs: DataFrame, text: str = "text", length: int | None = None, unit: Unit = BYTES) -> DataFrame:
    """docs with the duplicated strings cut out of their texts; letters cut in two are dropped. Null texts stay null.

    In units of words a run goes from the start of its first word to the end of its last; the white space around it
    stays. Rows are judged as in dedup; all columns are kept.
    """
    names, length = docs.columns, length or unit.length
    plain = docs.select(F.col(text).alias("text"), F.struct(*(F.col(c) for c in names)).alias("row"))
    none, some = with_intervals(keyed(plain).drop("text"), [(unit, length)])

    @F.pandas_udf("string")
    def left(t, iv):
        import pandas as pd

        out = []
        for x, found in zip(t, iv, strict=True):
            data = x.encode()
            out.append(kept(data, byte_runs(data, [(v["lo"], v["hi"]) for v in found], unit, length)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    clean: Column = F.when(F.col("iv").isNull(), F.col("row")[text]).otherwise(left(F.col("t"), F.coalesce("iv", F.array().cast(LISTS))))
    stripped = some.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in names))
    return none.select(*(F.col("row")[c].alias(c) for c in names)).unionByName(stripped)
