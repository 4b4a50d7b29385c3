"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders the shingles of a document. Documents with equal sets collapse into one class. A class
retains its first n - ceil(p n) + 1 shingles for a threshold p: two sets as similar as it always share a retained value,
so the inverted lists of retained values miss no link. The order puts shingles that very many documents share last,
which is only a matter of cost: then a passage that thousands of different documents quote is hardly ever retained.

Long lists aren't expanded into pairs. First every list is compared with one centre, the member with the smallest
part of rare shingles. Sketches of the union estimate the similarity of these pairs and drop hopeless ones; the full
sets decide. Linked documents form components, and only members of a list outside the component of its centre are
then compared with the list's other members in other components, where the places of the shared value leave room for
enough overlap. So every pair that shares a list is either compared or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components
from .membership import bit_of, has, marked, members
from .rolling import mix
from .shingles import blocks, shingle_sets
from .skew import counted, spread_join

#: Links have 100 * intersection >= percent * union; this is the percent where none is given.
PERCENT = 85
#: Values of the plain bottom-k sketch that estimates similarities.
SKETCH = 48
#: Pairs estimated below this aren't verified; it moves with the percent. At the threshold that is over seven standard errors,
#: a chance of less than one in ten billion; without the estimate every pair of a list is verified.
LEAST_ESTIMATE = 0.4
#: A shingle counts as common from this many documents on; at most so many are put last.
COMMON_DOCUMENTS = 64
MOST_COMMON = 1 << 17
#: A task reports a shingle that this many of its documents hold.
LOCAL_COMMON = 4
SHIFT = 1 << 26
#: Sketches hold hashes with this bit flipped, so that their signed order in Spark is the unsigned order of the hashes.
SIGN = np.uint64(1 << 63)


def retained(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def _sets(batch: pa.RecordBatch):
    """(row numbers, hashes, ends) of blocks of the batch's texts (column 1)."""
    texts = batch.column(1).to_pylist()
    for a, b in blocks(texts):
        yield a, b, *shingle_sets(texts[a:b])


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, as far as single tasks notice it; a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.zeros(0, np.uint64), *(h for batch in batches for _, _, h, _ in _sets(batch))])
        h.sort()
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        n = np.diff(np.append(at, len(h)))
        keep = n >= LOCAL_COMMON
        yield pa.record_batch([pa.array(h[at[keep]].view(np.int64)), pa.array(n[keep])], ["v", "n"])

    found = docs.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCUMENTS)
    top = found.orderBy(F.desc("n"), "v").limit(MOST_COMMON).select("v").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


SKETCHES = "doc_id long, h long, n long, f1 long, f2 long, rare long, kept array<long>, sketch array<long>"


def sketches(docs: DataFrame, common: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Per document: hash of the text, set size, two fingerprints of the set, how many retained values are rare, retained values, sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for a, b, h, ends in _sets(batch):
                begin = np.concatenate([[0], ends[:-1]])
                n = ends - begin
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(s)))]) for s in (1, 2)]
                f1, f2 = ((s[ends] - s[begin]).view(np.int64) for s in sums)
                place = np.searchsorted(last, h)
                is_common = last[np.minimum(place, len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, is_common, owner))
                rank = np.arange(len(h)) - np.repeat(begin, n)
                most = retained(n, percent)
                take = rank < np.repeat(most, n)
                values = h[order][take].view(np.int64)
                rare = np.bincount(owner[take & ~is_common[order]], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)
                few = rank < SKETCH
                kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, most, 0))]).astype(np.int32)), pa.array(values))
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, SKETCH))]).astype(np.int32)), pa.array((h[few] ^ SIGN).view(np.int64)))
                cols = [ids.slice(a, b - a), keys.slice(a, b - a), pa.array(n), pa.array(f1), pa.array(f2), pa.array(rare), kept, sketch]
                yield pa.record_batch(cols, ["doc_id", "h", "n", "f1", "f2", "rare", "kept", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, SKETCHES)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ids, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(members(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(has(bits, at)))
            for a, b, h, ends in _sets(some):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([some.column(0).slice(a, b - a), lists], ["id", "shingles"])

    return docs.select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(run, "id long, shingles array<long>")


def sizes_fit(n: Column, m: Column, percent: int = PERCENT) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def with_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b), a checkpoint, with the value of table (id, value) for both as s and t; ids of many pairs are split."""
    out = pairs
    for side, other, name in (("a", "b", "s"), ("b", "a", "t")):
        sizes = counted(pairs, [side])
        values = table.select(F.col("id").alias(side), F.col(value).alias(name))
        out = spread_join(out, values, [side], sizes=sizes, deal=F.xxhash64(other))
    return out


def estimated(pairs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) whose similarity, estimated from the sketch of the union, isn't hopeless."""
    union = F.slice(F.sort_array(F.array_union("s", "t")), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect("s", "t")))
    least = LEAST_ESTIMATE - (PERCENT - percent) / 100
    return with_sides(cut(pairs), sketch, "sketch").where(both >= least * F.size(union)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) whose full sets are similar enough."""
    pairs = cut(pairs)
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    same = F.size(F.array_intersect("s", "t"))
    enough = same * 100 >= (F.size("s") + F.size("t") - same) * percent
    return cut(with_sides(pairs, sets, "shingles").where(enough).select("a", "b"))


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, estimate: bool = True) -> DataFrame:
    """Verified links (a, b) that connect every two similar classes (id, n, rare, kept, sketch)."""
    likely = (lambda pairs: estimated(pairs, sketch, percent)) if estimate else (lambda pairs: pairs)
    sketch = classes.select("id", "sketch")
    share = (F.col("rare") * 1000 / F.greatest(F.size("kept"), F.lit(1))).cast("int")
    entries = classes.select("id", "n", share.alias("share"), F.posexplode("kept").alias("i", "v"))
    centre = F.min(F.struct("share", F.col("n").alias("zn"), F.col("id").alias("z"))).alias("c")
    lists = cut(entries.groupBy("v").agg(centre, F.count("*").alias("size")).where("size > 1").select("v", "size", "c.z", "c.zn"))
    # Two numbers to a column, as this table is the largest that is written.
    packed = entries.select("v", "id", (F.col("n") * SHIFT + F.col("i")).alias("ni"))
    held = cut(spread_join(packed, lists, ["v"], n="size", deal=F.xxhash64("id")).where("id <> z").select("v", "id", "ni", "z", (F.col("zn") * 2 + (F.col("size") > 2).cast("long")).alias("zs")))
    ni, zs = F.col("ni"), F.col("zs")
    listed = held.select("v", "id", F.shiftright(ni, 26).alias("n"), (ni % SHIFT).alias("i"), "z", F.shiftright(zs, 1).alias("zn"), (zs % 2 == 1).alias("long"))

    first = listed.where(sizes_fit(F.col("n"), F.col("zn"), percent)).select(F.col("id").alias("a"), F.col("z").alias("b")).distinct()
    found = verified(likely(first), docs, percent)
    label = components(found)

    long_ = listed.where("long").join(label.select("id", F.col("component").alias("k")), "id", "left").withColumn("k", F.coalesce("k", "id"))
    long_ = long_.join(label.select(F.col("id").alias("z"), F.col("component").alias("zk")), "z", "left").withColumn("zk", F.coalesce("zk", "z"))
    outside = long_.where("k <> zk")
    open_ = outside.select("v").distinct()
    others = long_.join(open_, "v", "left_semi").select("v", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("k").alias("bk"), (F.col("k") != F.col("zk")).alias("b_out"))
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = room * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    once = (F.col("id") < F.col("b")) | ~F.col("b_out")
    second = outside.select("v", "id", "n", "i", "k").join(others, "v").where((F.col("k") != F.col("bk")) & once & sizes_fit(F.col("n"), F.col("m"), percent) & enough)
    second = second.select(F.col("id").alias("a"), "b").distinct()
    return found.unionAll(verified(likely(second), docs, percent))


def judged(rows: DataFrame, percent: int = PERCENT, estimate: bool = True) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and kept of each row (doc_id, text)."""
    base = cut(sketches(rows, common_shingles(rows), percent)).withColumn("row", F.monotonically_increasing_id())
    named = F.col("n") > 0
    sets = base.where(named & F.col("doc_id").isNotNull())
    groups = sets.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    groups = cut(groups.select("f1", "f2", "n", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"), "copies"))
    few = ["doc_id", "h", "n", "f1", "f2"]
    of_class = spread_join(sets.select(*few, "row"), groups.drop("row"), ["f1", "f2", "n"], n="copies", deal=F.xxhash64("row"))
    alone = base.where(~named | F.col("doc_id").isNull()).withColumn("id", F.col("doc_id"))
    classes = sets.drop("doc_id").join(groups.select("row", "id"), "row").select("id", "n", "rare", "kept", "sketch")
    label = components(links(rows, classes, percent, estimate))
    out = of_class.join(label, "id", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = out.unionByName(alone.select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, estimate: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and are linked with nothing; fewer words than a shingle count
    as one. Rows that share a doc_id count as one document. A row without doc_id is linked with nothing and kept, with
    a null component. An empty table gives an empty result; other columns aren't read. Without estimate every pair of
    a list is verified, also the hopeless.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return judged(rows, percent, estimate).drop("h")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that near_duplicates drops; null ids all stay.

    Of rows that share doc_id and text one stays. Rows of one doc_id with different texts are judged by their texts.
    """
    key = ["_id", "_h"]
    plain = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = cut(judged(rows, percent).where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "kept"))
    some = cut(found.groupBy(*key).agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"))
    both = marked(plain, some, "_id").withColumn("_in", F.col("_in") & F.col("_id").isNotNull())
    checked = both.where("_in").join(some.where("not kept").select(*key), key, "left_anti").dropDuplicates(key)
    return both.where("not _in").unionByName(checked).select(*(F.col("row")[c].alias(c) for c in docs.columns))
