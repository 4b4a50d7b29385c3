"""Packing of tokenised documents into sequences by a configuration linear program.

The length histogram (one count for each length up to the capacity, so of bounded size) goes to the driver. There a
covering program over bin configurations is solved by multiplicative weights: each length has a price that falls
as the length gets covered, and a knapsack dynamic program finds the dearest configurations. Its fractional uses are
rounded and the program is solved again for what they leave over; best fit on the histogram only closes the few pieces
at the end. The plan is a list of configurations with multiplicities; documents find their places by their rank among
the pieces of their length, without any shuffle of text and without a list of documents on the driver.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import coder, default_path, special_tokens

CAPACITY = 2048
SEPARATOR = 0
ROUNDS = 8
#: How often the program is solved again for what rounding left over; best fit takes the rest.
PASSES = 40
STEP = 0.5
DECAY = 2.0
MOST_SHARDS = 4096
SHARD_ROWS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document with the checksum of their ids. A null text counts as empty, with one token.

    Strings of special tokens in a text get those tokens' ids, as the tokenizer's own encoding has it. A null doc_id
    stays null.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, special = coder(path), special_tokens()
        end = np.array([SEPARATOR], "<u4").tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                rows: list[tuple] = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = code.encode(t, special).tobytes() + end
                    for j, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                        rows.append((i, j, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class Knapsack:
    """The dearest multisets of sizes (ascending) for every room up to capacity, by dynamic programming."""

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        self.sizes = sizes
        self.value = np.zeros(capacity + 1)
        self.took = np.full(capacity + 1, -1)
        fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
        for c in range(1, capacity + 1):
            self.value[c] = self.value[c - 1]
            if k := fits[c]:
                value = self.value[c - sizes[:k]] + prices[:k]
                j = int(value.argmax())
                if value[j] > self.value[c] + 1e-12:
                    self.value[c], self.took[c] = value[j], j

    def content(self, room: int) -> dict[int, int]:
        """What fills the room, as index -> copies."""
        out: dict[int, int] = {}
        while room > 0:
            if (j := int(self.took[room])) < 0:
                room -= 1
            else:
                out[j] = out.get(j, 0) + 1
                room -= int(self.sizes[j])
        return out


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """Fractional uses of configurations ((index, copies), ...) that together cover counts at most once.

    A length's weight falls by a constant factor each time its whole count is covered once. In a round one dynamic
    program prices all rooms, and each length that is still open gets the dearest configuration that holds it.
    """
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        # Large lengths are a little dearer, since less fits beside them.
        sizes = lengths[open_]
        table = Knapsack(sizes, sizes * (1 + 0.1 * sizes / capacity) * np.exp(-DECAY * covered[open_]), capacity)
        left = counts[open_] * (1 - covered[open_])
        for j in range(len(open_) - 1, -1, -1):
            if left[j] <= 1e-9 * counts[open_[j]]:
                continue
            pick = table.content(capacity - int(sizes[j]))
            pick[j] = pick.get(j, 0) + 1
            step = STEP * min(left[i] / c for i, c in pick.items())
            if step <= 1e-6:
                continue
            key = tuple(sorted((int(open_[i]), c) for i, c in pick.items()))
            used[key] = used.get(key, 0.0) + step
            for i, c in pick.items():
                left[i] -= step * c
        covered[open_] = 1 - left / counts[open_]
    return used


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) and how often to use them, together within the histogram.

    The program's uses are rounded up in the order of their fill, as far as pieces are left, and the program is solved
    again for what is left over, until everything has a place or the passes end.
    """
    left = {n: k for n, k in histogram.items() if k and n <= capacity}
    out: dict[tuple, int] = {}
    for _ in range(PASSES):
        lengths = np.array(sorted(n for n, k in left.items() if k), dtype=np.int64)
        if not len(lengths):
            break
        uses = program(lengths, np.array([left[int(n)] for n in lengths], dtype=float), capacity, rounds)
        named = [(tuple((int(lengths[j]), c) for j, c in key), x) for key, x in uses.items()]
        before = sum(left.values())
        for content, x in sorted(named, key=lambda kx: (-sum(n * c for n, c in kx[0]), -kx[1], kx[0])):
            if n := min(math.ceil(x - 1e-6), *(left[k] // c for k, c in content)):
                out[content] = out.get(content, 0) + n
                for k, c in content:
                    left[k] -= c * n
        if sum(left.values()) == before:
            break
    return [(dict(content), n) for content, n in out.items()]


def best_fit(histogram: dict[int, int], capacity: int, bins: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling length, on groups of equal bins. bins: (contents, number) to begin with."""
    groups: dict[int, list[list]] = {}
    for content, n in bins:
        groups.setdefault(capacity - sum(k * c for k, c in content.items()), []).append([content, n])
    rooms = sorted(groups)

    def put(room: int, content: dict[int, int], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([content, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put(capacity - each * length, {length: each}, left // each)
                if rest := left % each:
                    put(capacity - rest * length, {length: rest}, 1)
                break
            room = rooms[at]
            content, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, left)
            full = left // each if n * each > left else n
            put(room - each * length, content | {length: content.get(length, 0) + each}, full)
            put(room, content, n - full)
            left -= full * each
    return [(content, n) for room in sorted(groups) for content, n in groups[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Bins (length -> copies, number of such bins) that hold the histogram exactly; by best fit alone if that needs fewer."""
    first = configurations(histogram, capacity, rounds)
    left = dict(histogram)
    for content, n in first:
        for length, c in content.items():
            left[length] -= c * n
    ours, plain = best_fit({k: v for k, v in left.items() if v}, capacity, first), best_fit(histogram, capacity, [])
    return ours if sum(n for _, n in ours) <= sum(n for _, n in plain) else plain


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    rows: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, n in bins:
        offset = 0
        for length, c in content.items():
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, c, offset))
            taken[length] = taken.get(length, 0) + c * n
            offset += c * length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece with its sequence and its place there.

    Null texts are empty documents of one token; documents over the capacity are cut, others never. Repeated rows are
    separate documents. An empty table gives an empty result. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    table = cut(pieces(docs, tokenizer, capacity, doc_id, text))
    histogram = {int(r["length"]): int(r["n"]) for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    shards = max(1, min(MOST_SHARDS, total // SHARD_ROWS))
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    dealt = table.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = by_length[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + k // row[:, 2]
                offset[at] = row[:, 3] + k % row[:, 2] * n
            cols = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(cols, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
