"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are interpolated bigram models over the ids of one public tokenizer, with the same smoothing. The background is
counted over all documents, the target over those that the labels call good. Unigrams and contexts, of the size of the
vocabulary, are gathered and broadcast. Pairs are counted exactly, however many there are, and never leave the
executors: rows are dealt into blocks, each block counts its distinct pairs, sums over the blocks of each pair give the
table, and a block gets the sums of its own pairs back to score its rows. A document's own counts are taken out of the models that counted
it, so that the target doesn't know its own documents by heart. The score of a document is the difference of its mean
losses in nats a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced
from .membership import marked
from .tokens import coder, default_path

BIGRAM_WEIGHT = 0.6
SMOOTHING = 0.5
#: A block of rows closes at so many tokens; rows are scored about so many tokens at a time.
BLOCK_TOKENS = 1 << 21
SLICE_TOKENS = 1 << 18


def with_marks(docs: DataFrame, good: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_good, text, good) of the rows of docs: their doc_id, text, and whether good holds the doc_id."""
    marks = good.select(F.col("doc_id").alias("_good")).distinct()
    # Only texts that may be good are shuffled for the exact join, at any size of the labels.
    rows = marked(docs.select(F.col(doc_id).alias("_good"), F.col(text).alias("text")), marks, "_good")
    exact = rows.where("_in").join(marks.withColumn("good", F.lit(True)).hint("merge"), "_good", "left").select("_good", "text", F.coalesce("good", F.lit(False)).alias("good"))
    return rows.where("not _in").select("_good", "text", F.lit(False).alias("good")).unionAll(exact)


def encoded(flagged: DataFrame, path: str) -> DataFrame:
    """(block, doc_id, good, ids) of rows (doc_id, text, good): token ids as bytes, and a block that one task fills."""
    most = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held = coder(path), 0
        kind = id_type(code)
        block = TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            names, rows = [], []
            for t in batch.column(1).to_pylist():
                ids = code.encode(t)
                if held and held + len(ids) > most:
                    block, held = block + 1, 0
                held += len(ids)
                names.append(block)
                rows.append(ids.astype(kind).tobytes())
            yield pa.record_batch([pa.array(names, pa.int64()), batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["block", "doc_id", "good", "ids"])

    return flagged.mapInArrow(run, "block long, doc_id long, good boolean, ids binary")


def id_type(code) -> str:
    return "<u2" if len(code.widths()) <= 1 << 16 else "<u4"


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a column of bytes."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *rows]).astype(np.int64), np.array([len(x) for x in rows], np.int64)


def predecessors(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The token before each; the first of each row follows the start mark."""
    before = np.concatenate([[vocabulary], ids])[: len(ids)]
    begin = np.cumsum(lengths) - lengths
    before[begin[lengths > 0]] = vocabulary
    return before


def singles(coded: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of unigrams and contexts by model (row 0 target, row 1 background); their size is the vocabulary's."""
    vocabulary = len(coder(path).widths())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(coder(path))
        sums = np.zeros((2, 2, vocabulary + 1), np.int64)
        for batch in sliced(batches):
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            ids, lengths = flat(batch.column(1), kind)
            before, of = predecessors(ids, lengths, vocabulary), np.repeat(good, lengths)
            for m, some in enumerate((of, slice(None))):
                for k, values in enumerate((ids, before)):
                    sums[m, k] += np.bincount(values[some], minlength=vocabulary + 1)
        m, k, at = np.nonzero(sums)
        yield pa.record_batch([pa.array(m.astype(np.int8)), pa.array(k.astype(np.int8)), pa.array(at.astype(np.int32)), pa.array(sums[m, k, at])], ["model", "kind", "cell", "n"])

    found = coded.select("good", "ids").mapInArrow(run, "model byte, kind byte, cell int, n long").groupBy("model", "kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 2, vocabulary + 1), np.int64)
    m, kind, cell, n = (found.column(c).to_numpy() for c in range(4))
    out[kind, m, cell] = n
    return out[0, :, :vocabulary], out[1]


def pair_counts(coded: DataFrame, path: str) -> DataFrame:
    """(block, pair, target, background): the distinct pairs of each block, with their exact counts over all blocks."""
    vocabulary = len(coder(path).widths())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(coder(path))

        def counts(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pairs, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            some, target = np.unique(pairs[of], return_counts=True)
            pairs.sort()
            at = np.flatnonzero(np.diff(pairs, prepend=-1))
            values, all_ = pairs[at], np.diff(np.append(at, len(pairs)))
            good = np.zeros(len(values), np.int64)
            good[np.searchsorted(values, some)] = target
            for k in range(0, len(values), 50_000):
                v = values[k : k + 50_000]
                yield pa.record_batch([pa.array(np.full(len(v), block, np.int64)), pa.array(v), pa.array(good[k : k + 50_000]), pa.array(all_[k : k + 50_000])], ["block", "pair", "t", "b"])

        last, parts = None, []
        for batch in batches:
            blocks, good = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ends = np.flatnonzero(np.diff(blocks, append=-1)) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                if blocks[a] != last and parts:
                    yield from counts(last, parts)
                    parts = []
                last = int(blocks[a])
                ids, lengths = flat(batch.column(2).slice(a, b - a), kind)
                parts.append((predecessors(ids, lengths, vocabulary) * (vocabulary + 1) + ids, np.repeat(good[a:b], lengths)))
        if parts:
            yield from counts(last, parts)

    by_pair = Window.partitionBy("pair")
    rows = coded.select("block", "good", "ids").mapInArrow(run, "block long, pair long, t long, b long")
    return rows.select("block", "pair", F.sum("t").over(by_pair).alias("target"), F.sum("b").over(by_pair).alias("background"))


SCORES = "doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double"


def repeats(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """How often each value occurs in its owner's row."""
    _, at, n = np.unique(owner * size + values, return_inverse=True, return_counts=True)
    return n[at]


def cross_entropy_difference(docs: DataFrame, good: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, ce_difference; low differences are like the target.

    good: the doc_id of target documents. With leave_out a document is scored without its own counts (those of its
    copies stay). A null or empty text has no tokens and null losses. Rows that repeat a doc_id are counted and scored
    separately; a null doc_id is never good. An empty table gives an empty result; other columns aren't read.
    """
    path = path or default_path()
    flagged = with_marks(docs, good, doc_id, text).select(F.col("_good").cast("long").alias("doc_id"), "text", "good")
    # The bytes of all tokens are written once, so that blocks stay as they are and nothing is encoded again.
    coded = cut(encoded(flagged, path))
    one, context = singles(coded, path)
    shared = docs.sparkSession.sparkContext.broadcast((one, context))

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        kind = id_type(coder(path))
        one, context = shared.value
        vocabulary = one.shape[1]
        totals = one.sum(axis=1)
        values = pairs.column("pair").to_numpy()
        order = np.argsort(values)
        values = values[order]
        counts = [pairs.column(c).to_numpy()[order] for c in ("target", "background")]
        coded_rows = rows.column("ids").combine_chunks()
        good = rows.column("good").to_numpy().astype(bool)
        sizes = np.array([len(x) for x in coded_rows.to_pylist()], np.int64) // np.dtype(kind).itemsize
        means = np.zeros((2, len(sizes)))
        part = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
        ends = np.flatnonzero(np.diff(part, append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            ids, lengths = flat(coded_rows.slice(a, b - a), kind)
            if not len(ids):
                continue
            before = predecessors(ids, lengths, vocabulary)
            at = np.searchsorted(values, before * (vocabulary + 1) + ids)
            some = lengths > 0
            begin = (np.cumsum(lengths) - lengths)[some]
            owner = np.repeat(np.arange(b - a), lengths)
            if leave_out:
                own_one, own_seen, own_pair = repeats(owner, ids, vocabulary + 1), repeats(owner, before, vocabulary + 1), repeats(owner, at, len(values))
            for m in range(2):
                single, seen, pair, total = one[m][ids], context[m][before], counts[m][at], np.full(len(ids), totals[m])
                if leave_out:
                    mine = np.ones(len(ids), bool) if m else good[a:b][owner]
                    single, seen, pair, total = single - own_one * mine, seen - own_seen * mine, pair - own_pair * mine, total - lengths[owner] * mine
                plain = (single + SMOOTHING) / (total + SMOOTHING * vocabulary)
                share = np.divide(pair, seen, out=plain.copy(), where=seen > 0)
                loss = -np.log(BIGRAM_WEIGHT * share + (1 - BIGRAM_WEIGHT) * plain)
                means[m, a:b][some] = np.add.reduceat(loss, begin) / lengths[some]
        none = sizes == 0
        losses = [pa.array(x, mask=none) for x in (means[0], means[1], means[0] - means[1])]
        return pa.table([rows.column("doc_id"), pa.array(sizes), *losses], [c.split()[0] for c in SCORES.split(", ")])

    return coded.select("block", "doc_id", "good", "ids").groupBy("block").cogroup(pair_counts(coded, path).groupBy("block")).applyInArrow(run, SCORES)
