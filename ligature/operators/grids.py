"""Whole grids of settings for each piece in one kernel call.

A row holds one packed piece (or one piece and bin size). What settings share is found once: affinities, distances, and
the tables of the interval program, which have an axis for the settings. Results are rows of counts, one for each
setting, so the number of shuffles doesn't depend on the size of a grid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .dealing import dealt
from .packs import CELLS, arrow_schema, by_length, lists, padded
from .selection import best, by_scores
from .trees import TRANSFORMS, matrix

#: Trials of one piece that go into one row.
TRIALS = 16
#: How a split is taken: by a threshold of its salience, by a share of the possible splits, or as many as there are marks.
MODES = ("threshold", "budget", "oracle")
#: Contrasts of a trial: none (only the affinities count), the mean of the features, or a fitted scorer's.
KINDS = ("similarity", "unsupervised", "supervised")
SEARCHES = ("exact", "greedy")
MARKS = "array<double>"


def packed(leaves: DataFrame, keys: list[str], marks: DataFrame, most: int | None = None) -> DataFrame:
    """(keys, leaves, marks): leaves in order and marks (piece, t) of all pieces, or those of at most `most` leaves; one shuffle each."""
    rows = dealt(leaves, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("leaf", "start", "end", F.col("vec").cast("array<double>").alias("vec")))).alias("leaves"))
    times = marks.groupBy("piece").agg(F.sort_array(F.collect_list("t")).alias("marks"))
    some = rows if most is None else rows.where(F.size("leaves") <= most)
    return some.join(times, "piece", "left").withColumn("marks", F.coalesce("marks", F.array().cast(MARKS)))


def arrays(items) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, edges) of packed leaves."""
    return np.array([list(x["vec"]) for x in items]), np.array([x["start"] for x in items] + [items[-1]["end"]])


def matches(predicted: list[float], marks: list[float], tolerance: float) -> tuple[int, int, int]:
    """(tp, fp, fn) of the largest order-preserving match of sorted times; predictions have no repeats.

    Taking the first partner within the tolerance for each in turn gives the most pairs.
    """
    tp = i = j = 0
    while i < len(predicted) and j < len(marks):
        gap = predicted[i] - marks[j]
        if abs(gap) <= tolerance:
            tp, i, j = tp + 1, i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return tp, len(predicted) - tp, len(marks) - tp


def match_counts(times: np.ndarray, chosen: np.ndarray, marks: np.ndarray, tolerance: float) -> np.ndarray:
    """(tp, fp, fn) of `matches` for each choice of predictions of each piece, [piece, choice, 3].

    times: [piece, place], rising; chosen: [piece, choice, place]; marks: [piece, place], rising, infinity after the last.
    Equal predictions count once.
    """
    size, choices = chosen.shape[:2]
    new = np.ones(times.shape, bool)
    new[:, 1:] = times[:, 1:] != times[:, :-1]
    if not new.all():
        # The first of equal times stands for all.
        first = np.maximum.accumulate(np.where(new, np.arange(times.shape[1]), 0), axis=1)
        chosen = np.stack([(chosen & (first == k)[:, None]).any(axis=2) for k in range(times.shape[1])], axis=2)
    end = lambda x: np.concatenate([x, np.full((*x.shape[:-1], 1), np.inf)], axis=-1)
    found = end(np.sort(np.where(chosen, times[:, None], np.inf), axis=2)).reshape(size * choices, -1)
    marks, who = end(marks), np.repeat(np.arange(size), choices)
    row = np.arange(len(found))
    tp, i, j = (np.zeros(len(found), np.int64) for _ in range(3))
    for _ in range(found.shape[1] + marks.shape[1]):
        x, y = found[row, i], marks[who, j]
        live = np.isfinite(x) & np.isfinite(y)
        if not live.any():
            break
        gap = np.subtract(x, y, out=np.zeros(len(x)), where=live)
        hit = live & (np.abs(gap) <= tolerance)
        early = live & ~hit & (gap < 0)
        tp += hit
        i += hit | early
        j += live & ~early
    n, m = np.isfinite(found).sum(axis=1), np.isfinite(marks).sum(axis=1)[who]
    return np.stack([tp, n - tp, m - tp], axis=1).reshape(size, choices, 3)


def above(nodes: list[K.Node], depth: int) -> list[int]:
    """The splits of the nodes above a depth."""
    at = {(i, j): k for i, j, k in nodes}
    out, level = [], [max(at, key=lambda x: x[1] - x[0])] if at else []
    for _ in range(depth):
        out += [at[x] for x in level]
        level = [x for i, j in level for x in ((i, at[i, j]), (at[i, j], j)) if x in at]
    return out


def salient(nodes: list[K.Node], contrast: np.ndarray, n: int) -> list[tuple[float, int, int]]:
    """(-salience, -leaves, split) of each node, best first."""
    span = lambda m: np.log(m) / np.log(n) if n > 1 else 0.0
    return sorted((-float(span(j - i) * contrast[k - 1]), -(j - i), k) for i, j, k in nodes)


def taken(ranked: list[tuple[float, int, int]], mode: str, value: float, n: int, marks: int) -> list[int]:
    """The splits that a candidate takes."""
    if mode == MODES[0]:
        return [k for s, _, k in ranked if -s >= value]
    # Rounded half to even, at least one, at most all.
    most = marks if mode == MODES[2] else min(n - 1, max(1, round(value * (n - 1))))
    return [k for _, _, k in ranked[:most]]


COUNTED = "kind string, stage string, outer_work string, work string, piece string, search string, weight double, balance double, mode string, value double, tp long, fp long, fn long"


def trial_counts(leaves: DataFrame, marks: DataFrame, contrasts: DataFrame, grid: list[tuple[float, float]], thresholds: list[float], ratios: list[float], tolerance: float, distance: str = "euclidean", searches: tuple[str, ...] = SEARCHES, most: int | None = None) -> DataFrame:
    """Counts (kind, stage, outer_work, work, piece, search, weight, balance, mode, value, tp, fp, fn) of boundary-aware trees.

    leaves: (piece, leaf, start, end, vec), marks: (piece, t), contrasts: (kind, stage, outer_work, work, piece, split,
    score), one score in [0, 1] for each split of a piece in each trial. Trees are built for each trial and each
    (weight, balance) of grid, exactly and greedily, and splits are taken by each threshold of salience and each ratio; the
    outer stage has oracle rows as well, with as many splits as the piece has marks and no value. Trials of the kind
    `similarity` take only the weight 0 (none, if the grid hasn't it). Pieces of one leaf or without all scores are left out, and those
    over `most` leaves if it is given.
    """
    keys = ["kind", "stage", "outer_work", "work"]
    one = contrasts.groupBy("piece", *keys).agg(F.array_sort(F.collect_list(F.struct("split", "score"))).alias("c"))
    place = F.floor((F.row_number().over(Window.partitionBy("piece").orderBy(*keys)) - 1) / TRIALS)
    trials = one.withColumn("block", place).groupBy("piece", "block").agg(F.collect_list(F.struct(*keys, F.col("c.score").alias("score"))).alias("trials"))
    rows = dealt(packed(leaves, ["piece"], marks, most).join(trials, "piece"), "piece", "block")
    candidates = [(MODES[0], float(v)) for v in thresholds] + [(MODES[1], float(v)) for v in ratios]

    def run(batches):
        for f in batches:
            for piece, items, times, some in zip(f["piece"], f["leaves"], f["marks"], f["trials"], strict=True):
                out = []
                vectors, edges = arrays(items)
                n, times, aff, seen = len(vectors), list(times), matrix(vectors, distance), {}
                for t in some:
                    contrast = np.array(t["score"], float)
                    settings = [g for g in grid if t["kind"] != KINDS[0] or g[0] == 0]
                    if n < 2 or len(contrast) != n - 1 or not settings:
                        continue
                    name = (t["kind"], t["stage"], t["outer_work"], t["work"], piece)
                    built = {"exact": K.boundary_grid(aff, contrast, settings)[0]} if "exact" in searches else {}
                    if "greedy" in searches:
                        built["greedy"] = [K.boundary_linkage(aff, contrast, *g) for g in settings]
                    for search, trees in built.items():
                        for (weight, balance), nodes in zip(settings, trees, strict=True):
                            ranked = salient(nodes, contrast, n)
                            for mode, value in [*candidates, *([(MODES[2], None)] if t["stage"] == "outer" else [])]:
                                splits = tuple(sorted(taken(ranked, mode, value, n, len(times))))
                                if splits not in seen:
                                    seen[splits] = matches([float(edges[k]) for k in splits], times, tolerance)
                                out.append((*name, search, float(weight), float(balance), mode, value, *seen[splits]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")])

    return rows.select("piece", "leaves", "marks", "trials").mapInPandas(run, COUNTED)


def spans_of(cut: np.ndarray) -> np.ndarray:
    """[program, split - 1]: leaves of the node that each split divides, from cuts [program, first, past the last]."""
    size, n = len(cut), cut.shape[1] - 1
    out = np.zeros((size, n - 1), np.int64)
    # All nodes of a depth at once.
    at = np.arange(size if n > 1 else 0)
    i, j = np.zeros(len(at), np.int64), np.full(len(at), n)
    while len(at):
        k = cut[at, i, j]
        out[at, k - 1] = j - i
        at, i, j = np.concatenate([at, at]), np.concatenate([i, k]), np.concatenate([k, j])
        inner = j - i > 1
        at, i, j = at[inner], i[inner], j[inner]
    return out


def most_programs(n: int) -> int:
    """How many interval programs of n leaves have tables of about CELLS numbers together; one at least."""
    return max(1, CELLS // (n + 1) ** 2)


def exact_spans(prefix: np.ndarray, whole: np.ndarray, of: np.ndarray, contrast: np.ndarray, weight: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """spans_of the boundary programs of pieces of one length; prefix, whole: one for each piece; `of`: the piece of each program."""
    n, w, b = prefix.shape[1] - 1, weight[:, None, None], balance[:, None, None]
    some = whole > 0

    def gain(length: int, i: np.ndarray, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, right, middle, all_ = K.diagonals(prefix, length)
        cross = right - all_ - middle + left
        revenue = np.where(some[:, None, None], (n - length) * cross / np.where(some, whole, 1.0)[:, None, None], 0.0)
        revenue = revenue if len(revenue) == 1 else revenue[of]
        # Imbalance depends on the place of a split in its interval alone.
        uneven = (2 * np.arange(1, length) - length) / length
        own = sliding_window_view(contrast, length - 1, axis=1)
        return (1 - w) * revenue + (w * np.log(length) / np.log(n) * own - b * uneven**2) / max(1, n - 1)

    return spans_of(K.interval_cuts(n, len(of), gain, "midpoint")[0])


def greedy_spans(prefix: np.ndarray, of: np.ndarray, contrast: np.ndarray, weight: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """As exact_spans, of boundary linkage."""
    n, row, w, b = prefix.shape[1] - 1, np.arange(len(of))[:, None], weight[:, None], balance[:, None]
    edges, out, p = np.tile(np.arange(n + 1), (len(of), 1)), np.zeros((len(of), n - 1), np.int64), of[:, None]
    while edges.shape[1] > 2:
        i, k, j = edges[:, :-2], edges[:, 1:-1], edges[:, 2:]
        mean = (prefix[p, k, j] - prefix[p, i, j] - prefix[p, k, k] + prefix[p, i, k]) / ((k - i) * (j - k))
        value = (1 - w) * mean - w * contrast[row, k - 1] - b * ((2 * k - i - j) / (j - i)) ** 2
        at = value.argmax(axis=1)
        one = row[:, 0]
        out[one, k[one, at] - 1] = j[one, at] - i[one, at]
        keep = np.ones(edges.shape, bool)
        keep[one, at + 1] = False
        edges = edges[keep].reshape(len(of), -1)
    return out


SUMMED = "kind string, stage string, outer_work string, work string, search string, weight double, balance double, mode string, value double, pieces long, f1 double, recall double, precision double"


def trial_sums(leaves: DataFrame, marks: DataFrame, features: DataFrame, names: list[str], trials: list[dict], grid: list[tuple[float, float]], thresholds: list[float], ratios: list[float], tolerance: float, distance: str = "euclidean", searches: tuple[str, ...] = SEARCHES, most: int | None = None) -> DataFrame:
    """What trial_counts counts, for the trials of fitted scorers and both plain kinds, as sums of rates over the pieces of a work.

    features: (piece, work, split, names), trials: dicts of stage, outer_work, work, weights, gain, intercept. A task adds up
    its pieces, so the rows that leave it don't grow with them: (..., pieces, f1, recall, precision). Trees of all trials and
    settings of pieces of one length are built at once, those without weight on contrasts for all trials in common. Pieces
    of any length count, unless `most` leaves out longer ones; of a long piece so many programs go together as fit in CELLS.
    """
    one = features.groupBy("piece", "work").agg(F.array_sort(F.collect_list(F.struct("split", F.array(*names).cast("array<double>").alias("x")))).alias("c"))
    rows = dealt(packed(leaves, ["piece"], marks, most).join(one, "piece"), "piece")
    rows = rows.where((F.size("leaves") > 1) & (F.size("c") == F.size("leaves") - 1))
    tried: dict[str, list[dict]] = {}
    for t in sorted(trials, key=lambda t: (t["work"], t["stage"] == "outer", t["outer_work"])):
        tried.setdefault(t["work"], []).append(t)
    candidates = [(MODES[0], float(v)) for v in thresholds] + [(MODES[1], float(v)) for v in ratios] + [(MODES[2], None)]
    plain, zero = [g for g in grid if g[0] == 0], {g: at for at, g in enumerate(g for g in grid if g[0] == 0)}

    def rates(vectors, edges, times, x, fitted):
        """[contrast, setting, search, candidate, rate] of each piece; all have the same number of leaves and trials."""
        size, n = len(vectors), len(edges[0]) - 1
        aff = [matrix(v, distance) for v in vectors]
        prefix, whole = np.stack([K.prefix2(a) for a in aff]), np.array([K.denominator(a) for a in aff])
        x = np.stack(x)
        logit = fitted[2][:, :, None] + fitted[1][:, :, None] * (np.einsum("psf,ptf->pts", x, fitted[0]) - 0.5)
        score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        # Contrasts of a piece: none, the mean, and those of its trials.
        contrast = np.concatenate([np.ones((size, 1, n - 1)), x.mean(axis=2)[:, None], score], axis=1)
        kinds = contrast.shape[1]
        # Programs: the settings without weight once, then the others for each contrast but the first.
        other = [g for g in grid if g[0] != 0]
        jobs = [(0, *g) for g in plain] + [(c, *g) for c in range(1, kinds) for g in other]
        of, c = np.repeat(np.arange(size), len(jobs)), np.tile([j[0] for j in jobs], size)
        weight, balance = (np.tile(np.array([j[k] for j in jobs], float), size) for k in (1, 2))
        own = contrast[of, c]
        blocks = [slice(at, at + most_programs(n)) for at in range(0, len(of), most_programs(n))]
        # The program of each contrast and setting; the first contrast takes only settings without weight.
        uses = [(c, s, zero[g] if g[0] == 0 else len(plain) + (c - 1) * len(other) + other.index(g)) for c in range(kinds) for s, g in enumerate(grid) if c or g[0] == 0]
        span = np.array([0.0, *(np.log(m) / np.log(n) for m in range(1, n + 1))])
        counts = np.array([len(t) for t in times])
        out = np.zeros((size, kinds, len(grid), len(searches), len(candidates), 3))
        for a, search in enumerate(searches):
            if search == "exact":
                leaf = np.concatenate([exact_spans(prefix, whole, of[b], own[b], weight[b], balance[b]) for b in blocks])
            else:
                leaf = greedy_spans(prefix, of, own, weight, balance)
            leaf = leaf.reshape(size, len(jobs), n - 1)[:, [u[2] for u in uses]]
            value = span[leaf] * contrast[:, [u[0] for u in uses]]
            rank = np.lexsort((np.broadcast_to(np.arange(n - 1), value.shape), -leaf, -value), axis=-1).argsort(axis=-1)
            masks = []
            for mode, v in candidates:
                if mode == MODES[0]:
                    masks.append(value >= v)
                else:
                    masks.append(rank < (counts[:, None, None] if mode == MODES[2] else min(n - 1, max(1, round(v * (n - 1))))))
            bits = np.packbits(np.stack(masks, axis=2), axis=-1)
            for p in range(size):
                kept, back = np.unique(bits[p].reshape(-1, bits.shape[-1]), axis=0, return_inverse=True)
                found = []
                for row in np.unpackbits(kept, axis=1, count=n - 1):
                    tp, fp, fn = matches([float(edges[p][k + 1]) for k in np.flatnonzero(row)], times[p], tolerance)
                    pr, re = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
                    found.append((2 * pr * re / (pr + re) if pr + re else 0.0, re, pr))
                out[p][[u[0] for u in uses], [u[1] for u in uses], a] = np.array(found)[back.ravel()].reshape(len(uses), len(candidates), 3)
        return out

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for f in batches:
            groups: dict[tuple[int, int], list[tuple]] = {}
            for work, items, times, c in zip(f["work"], f["leaves"], f["marks"], f["c"], strict=True):
                if tried.get(work):
                    groups.setdefault((len(items), len(tried[work])), []).append((work, *arrays(items), list(times), np.array([list(s["x"]) for s in c])))
            for (n, t), pieces in groups.items():
                step = max(1, most_programs(n) // ((t + 2) * len(grid)))
                for at in range(0, len(pieces), step):
                    works, vectors, edges, times, x = zip(*pieces[at : at + step], strict=True)
                    fitted = [np.array([[m[k] for m in tried[w]] for w in works], float) for k in ("weights", "gain", "intercept")]
                    for w, r in zip(works, rates(vectors, edges, times, x, fitted), strict=True):
                        sums[w] = sums[w] + r if w in sums else r
                        number[w] = number.get(w, 0) + 1
        out = []
        for work, r in sums.items():
            for t, m in enumerate(tried[work]):
                for kind, c in zip(KINDS, (0, 1, t + 2), strict=True):
                    for s, (weight, balance) in enumerate(grid):
                        if kind != KINDS[0] or weight == 0:
                            for a, search in enumerate(searches):
                                for b, (mode, value) in enumerate(candidates):
                                    if mode != MODES[2] or m["stage"] == "outer":
                                        out.append((kind, m["stage"], m["outer_work"], work, search, float(weight), float(balance), mode, value, number[work], *r[c, s, a, b].tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMED.split(", ")])

    return rows.select("work", "leaves", "marks", "c").mapInPandas(run, SUMMED)


def summed_select(sums: DataFrame) -> DataFrame:
    """grid_select of rows of trial_sums."""
    keys = ["stage", "kind", "outer_work", "mode", "weight", "balance", "value", "search", "work"]
    return work_select(sums.groupBy(*keys).agg(*((F.sum(c) / F.sum("pieces")).alias(c) for c in ("f1", "recall", "precision"))))


def grid_select(rated: DataFrame) -> DataFrame:
    """(kind, outer_work, mode, weight, balance, value, inner_f1, search, f1, recall, precision): outer scores of inner choices.

    rated: rows of trial_counts with f1, recall and precision. A candidate's inner score is its mean over works and
    searches of means over pieces. On ties of all three the smaller budget or higher threshold is taken, then the smaller
    balance, then the smaller weight. Oracle rows stand on the trees that the budget's choice built.
    """
    keys = ["stage", "kind", "outer_work", "mode", "weight", "balance", "value", "search", "work"]
    return work_select(rated.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("f1", "recall", "precision"))))


def work_select(by_work: DataFrame) -> DataFrame:
    """grid_select of means over the pieces of each work."""
    names, dims = ("f1", "recall", "precision"), ["weight", "balance", "value"]
    keys, inner = ["kind", "outer_work", "mode"], F.col("stage") == "inner"
    # One table of means, over searches only within; windows then choose and hand the choice to the outer rows.
    means = by_work.withColumn("search", F.when(~inner, F.col("search"))).groupBy("stage", *keys, *dims, "search").agg(*(F.avg(c).alias(c) for c in names))
    means = means.withColumns({c: F.when(inner, F.round(c, 9)).otherwise(F.col(c)) for c in names})
    cautious = F.when(F.col("mode") == MODES[0], -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy(*keys, "stage").orderBy(*by_scores(cautious, F.asc("balance"), F.asc("weight")))
    ranked = means.withColumn("_r", F.row_number().over(order))
    choice = F.when(inner & (F.col("_r") == 1), F.struct(*dims, F.col("f1").alias("inner_f1")))
    pick = lambda mode: F.max(F.when(F.col("mode") == mode, choice)).over(Window.partitionBy("kind", "outer_work"))
    told = ranked.withColumns({"_t": pick(MODES[0]), "_b": pick(MODES[1])}).withColumn("_own", F.when(F.col("mode") == MODES[0], F.col("_t")).otherwise(F.col("_b")))
    same = (F.col("weight") == F.col("_own.weight")) & (F.col("balance") == F.col("_own.balance"))
    found = told.where(~inner & same & ((F.col("mode") == MODES[2]) | (F.col("value") == F.col("_own.value"))))
    return found.select(*keys, *dims, "_own.inner_f1", "search", *names)


def seeded(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


CONFIGURED = "piece string, size double, method string, replicate int, kind string, budget int, tolerance double, tp long, fp long, fn long"
SUMMED_SIZES = "work string, size double, method string, kind string, budget int, tolerance double, pieces long, f1 double, recall double, precision double"


class Grid:
    """The settings of configurations: trees, ways to take their splits, and tolerances."""

    def __init__(self, distances: list[str], depths: list[int], budgets: list[int], tolerances: list[float], replicates: int, seed: int) -> None:
        self.distances, self.depths, self.budgets, self.tolerances, self.replicates, self.seed = distances, depths, budgets, tolerances, replicates, seed
        self.trees = [(name, 0) for name in distances] + [("balanced", 0)] + [("random", r) for r in range(replicates)]
        self.kinds = [("depth", d) for d in depths] + [("budget", b) for b in budgets] + [("oracle", None)]

    def counts(self, pieces: list[str], sizes: list[float], vectors: np.ndarray, edges: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """[piece, tree, kind, tolerance, (tp, fp, fn)] of pieces of one length; marks have infinity after the last."""
        size, n = vectors.shape[:2]
        number = np.isfinite(marks).sum(axis=1)
        out = np.zeros((size, len(self.trees), len(self.kinds), len(self.tolerances), 3), np.int64)
        for t, (name, r) in enumerate(self.trees):
            if name == "balanced":
                nodes = np.broadcast_to(np.array(K.balanced(n), np.int64).reshape(1, n - 1, 3), (size, n - 1, 3))
            elif name == "random":
                nodes = np.array([K.random_merges(n, seeded(self.seed, p, s, r)) for p, s in zip(pieces, sizes, strict=True)], np.int64).reshape(size, n - 1, 3)
            else:
                nodes = K.greedy_distances(vectors, TRANSFORMS[name])
            deep, late = K.depths(nodes), np.arange(n - 2, -1, -1)
            by_merge = [deep < d for d in self.depths] + [np.broadcast_to(late < b, deep.shape) for b in self.budgets] + [late < number[:, None]]
            chosen = np.zeros((size, len(self.kinds), n - 1), bool)
            np.put_along_axis(chosen, np.broadcast_to(nodes[:, None, :, 2] - 1, chosen.shape), np.stack(by_merge, axis=1), axis=2)
            for x, tolerance in enumerate(self.tolerances):
                out[:, t, :, x] = match_counts(edges[:, 1:n], chosen, marks, tolerance)
        return out

    def run(self, batch: pa.RecordBatch):
        """(rows, counts) of the pieces of a batch (piece, size, leaves, marks), those of one length together."""
        pieces, sizes = batch["piece"].to_pylist(), batch["size"].to_pylist()
        for rows, vectors, edges in by_length(batch["leaves"], CELLS // 4):
            # Padded by group, as long pieces may have many marks.
            yield rows, self.counts([pieces[k] for k in rows], [sizes[k] for k in rows], vectors, edges, padded(batch["marks"].take(pa.array(rows))))


def configurations(leaves: DataFrame, marks: DataFrame, distances: list[str], depths: list[int], budgets: list[int], tolerances: list[float], replicates: int = 1, seed: int = 0, most: int | None = None) -> DataFrame:
    """Counts (piece, size, method, replicate, kind, budget, tolerance, tp, fp, fn) of a whole grid of evaluations.

    leaves: (piece, size, leaf, start, end, vec), as binning.leaves gives for several sizes. Methods are greedy trees of
    each distance, the balanced tree, and random merges, of which there are `replicates`. Each tree is built once; its
    splits above each depth (kind `depth`), its latest merges up to each budget (`budget`), and as many as there are
    marks (`oracle`, whose budget is that number) are matched for each tolerance. If `most` is given, longer pieces are left out.
    """
    rows = packed(leaves, ["piece", "size"], marks, most)
    grid = Grid(distances, depths, budgets, tolerances, replicates, seed)

    def run(batches):
        for batch in batches:
            number, out = lists(batch["marks"])[1].tolist(), []
            for own, counts in grid.run(batch):
                for p, each in zip(own.tolist(), counts.tolist(), strict=True):
                    name = (batch["piece"][p].as_py(), batch["size"][p].as_py())
                    out += [
                        (*name, method, r, kind, number[p] if value is None else value, float(t), *each[a][b][c])
                        for a, (method, r) in enumerate(grid.trees) for b, (kind, value) in enumerate(grid.kinds) for c, t in enumerate(tolerances)
                    ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONFIGURED.split(", ")])

    # Frames are made of batches of numbers, not of lists of structs.
    def frames(batches):
        for f in run(batches):
            yield pa.RecordBatch.from_pandas(f, arrow_schema(CONFIGURED), preserve_index=False)

    return rows.select("piece", "size", "leaves", "marks").mapInArrow(frames, CONFIGURED)


def configuration_sums(leaves: DataFrame, marks: DataFrame, distances: list[str], depths: list[int], budgets: list[int], tolerances: list[float], replicates: int = 1, seed: int = 0, most: int | None = None) -> DataFrame:
    """Rates of configurations as sums over the pieces of a work, with `pieces`; leaves have `work` too.

    All pieces count, unless `most` leaves out longer ones; what a kernel keeps of a piece is linear in its leaves. The
    rates of a piece are means over its replicates, and an oracle's budget is null. A task adds up its pieces, so the rows
    that leave it don't grow with them: (work, size, method, kind, budget, tolerance, pieces, f1, recall, precision).
    """
    rows = packed(leaves, ["piece", "size", "work"], marks, most)
    grid = Grid(distances, depths, budgets, tolerances, replicates, seed)
    names = list(dict.fromkeys(name for name, _ in grid.trees))

    def run(batches):
        sums: dict[tuple[str, float], list] = {}
        for batch in batches:
            keys = list(zip(batch["work"].to_pylist(), batch["size"].to_pylist(), strict=True))
            for own, counts in grid.run(batch):
                tp, fp, fn = np.moveaxis(counts.astype(float), -1, 0)
                ratio = lambda a, b: np.divide(a, b, out=np.zeros(a.shape), where=b > 0)
                precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
                rates = np.stack([ratio(2 * precision * recall, precision + recall), recall, precision], axis=-1)
                rates = np.stack([rates[:, [a for a, t in enumerate(grid.trees) if t[0] == name]].mean(axis=1) for name in names], axis=1)
                groups: dict[tuple[str, float], list[int]] = {}
                for at, p in enumerate(own.tolist()):
                    groups.setdefault(keys[p], []).append(at)
                for key, at in groups.items():
                    n, x = sums.get(key, (0, 0.0))
                    sums[key] = (n + len(at), x + rates[at].sum(axis=0))
        out = [
            (*key, method, kind, value, float(t), n, *x[a, b, c].tolist())
            for key, (n, x) in sums.items() for a, method in enumerate(names) for b, (kind, value) in enumerate(grid.kinds) for c, t in enumerate(tolerances)
        ]
        schema = arrow_schema(SUMMED_SIZES)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return rows.select("piece", "size", "work", "leaves", "marks").mapInArrow(run, SUMMED_SIZES)


def simplex(parts: int, steps: int) -> np.ndarray:
    """All weights in multiples of 1 / steps that sum to one, in rising order."""
    if parts == 1:
        return np.array([[1.0]])
    out = []
    for k in range(steps + 1):
        rest = simplex(parts - 1, steps - k) * (steps - k) / steps if k < steps else np.zeros((1, parts - 1))
        out += [[k / steps, *r] for r in rest.tolist()]
    return np.array(out)


def mixture_counts(leaves: DataFrame, marks: DataFrame, distances: list[str], scales: list[float], steps: int, depth: int, tolerance: float, most: int | None = None) -> DataFrame:
    """(piece, weights, objective, tp, fp, fn): the exact additive tree of each mixture of scaled distances, by its splits above a depth.

    Distances of all pairs of neighbouring intervals are found once for each distance of a piece, and mixed for all
    weights of the simplex.
    """
    grid = simplex(len(distances), steps)

    def run(batches):
        for f in batches:
            for piece, items, times in zip(f["piece"], f["leaves"], f["marks"], strict=True):
                vectors, edges = arrays(items)
                trees, costs = K.mixture_grid(vectors, [TRANSFORMS[d] for d in distances], scales, grid)
                out = [(piece, w, float(c), *matches(sorted(float(edges[k]) for k in above(t, depth)), list(times), tolerance)) for w, t, c in zip(grid.tolist(), trees, costs, strict=True)]
                yield pd.DataFrame(out, columns=["piece", "weights", "objective", "tp", "fp", "fn"])

    return packed(leaves, ["piece"], marks, most).select("piece", "leaves", "marks").mapInPandas(run, "piece string, weights array<double>, objective double, tp long, fp long, fn long")


def choose_mixture(rated: DataFrame) -> DataFrame:
    """One row (weights, f1, recall, objective): the best mean over works of means over pieces.

    rated: rows (work, piece, weights, f1, recall, objective). Ties of f1 go to the larger recall, then the smaller
    objective, then the smaller weights.
    """
    names = ("f1", "recall", "objective")
    by_work = rated.groupBy("work", "weights").agg(*(F.avg(c).alias(c) for c in names))
    means = by_work.groupBy("weights").agg(*(F.round(F.avg(c), 9).alias(c) for c in names))
    return best(means, [], F.desc("f1"), F.desc("recall"), F.asc("objective"), F.asc("weights"))
