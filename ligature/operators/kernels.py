"""Ordered binary trees over the leaves of one sequence, as arrays.

A builder returns, for each internal node, (first, past the last, split) in merge order. These functions know nothing
of Spark; `trees` runs them once for each piece and configuration.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import as_strided

Node = tuple[int, int, int]


def prefix2(a: np.ndarray) -> np.ndarray:
    return np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def cross_sums(prefix: np.ndarray, i: int, ks: np.ndarray, j: int) -> np.ndarray:
    """Sums of affinity between [i, k) and [k, j) for each k."""
    return prefix[ks, j] - prefix[i, j] - prefix[ks, ks] + prefix[i, ks]


def choose(ks: np.ndarray, values: np.ndarray, middle: float, tie: str) -> tuple[int, float]:
    """The best k and its value; near-equal values go to the earliest, latest or most central k."""
    tied = np.flatnonzero(values >= values.max() - 1e-12)
    if tie == "midpoint":
        at = tied[np.lexsort((ks[tied], np.abs(ks[tied] - middle)))[0]]
    else:
        at = tied[0 if tie == "earliest" else -1]
    return int(ks[at]), float(values[at])


def interval_program(n: int, gain: Callable[[int, np.ndarray, int], np.ndarray], tie: str) -> tuple[list[Node], np.ndarray]:
    """The tree with the largest sum of gains over its splits, by dynamic programming over intervals."""
    best = np.zeros((n + 1, n + 1))
    cut = np.zeros((n + 1, n + 1), np.int32)
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            j = i + length
            ks = np.arange(i + 1, j)
            cut[i, j], best[i, j] = choose(ks, best[i, i + 1 : j] + best[i + 1 : j, j] + gain(i, ks, j), (i + j) / 2, tie)
    return unfold(n, lambda i, j: int(cut[i, j])), best


def unfold(n: int, cut: Callable[[int, int], int]) -> list[Node]:
    """Nodes of a tree given by its splits, children before parents, left before right."""
    out: list[Node] = []
    stack: list[tuple[int, int, bool]] = [(0, n, False)]
    while stack:
        i, j, seen = stack.pop()
        if j - i < 2:
            continue
        k = cut(i, j)
        if seen:
            out.append((i, j, k))
        else:
            stack += [(i, j, True), (k, j, False), (i, k, False)]
    return out


def merged(n: int, pick: Callable[[list[tuple[int, int]]], int]) -> list[Node]:
    """Merge neighbouring clusters until one is left; pick names the left one of each merge."""
    clusters, out = [(i, i + 1) for i in range(n)], []
    while len(clusters) > 1:
        at = pick(clusters)
        (i, k), (_, j) = clusters[at], clusters[at + 1]
        out.append((i, j, k))
        clusters[at : at + 2] = [(i, j)]
    return out


def denominator(affinity: np.ndarray) -> float:
    n = len(affinity)
    return float((n - 2) * affinity[np.triu_indices(n, 1)].sum()) if n > 2 else 0.0


def balanced(n: int) -> list[Node]:
    return unfold(n, lambda i, j: i + (j - i) // 2)


def random_merges(n: int, seed: str) -> list[Node]:
    """Random neighbour merges; the stream of random numbers is a hash of the seed's text."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))
    return merged(n, lambda c: int(rng.integers(len(c) - 1)))


def greedy_distance(vectors: np.ndarray, transform: Callable[[np.ndarray], np.ndarray]) -> list[Node]:
    """Merge the neighbours whose summed vectors are nearest, the earliest on ties."""
    sums = np.vstack([np.zeros(vectors.shape[1]), vectors.cumsum(0)])

    def pick(clusters: list[tuple[int, int]]) -> int:
        reps = transform(np.array([sums[j] - sums[i] for i, j in clusters]))
        return int(np.linalg.norm(reps[1:] - reps[:-1], axis=1).argmin())

    return merged(len(vectors), pick)


def without(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x less the item `at` of each row."""
    keep = np.ones(x.shape[:2], bool)
    keep[np.arange(len(x)), at] = False
    return x[keep].reshape(len(x), x.shape[1] - 1, *x.shape[2:])


def greedy_distances(vectors: np.ndarray, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """greedy_distance of pieces of one length at once: [piece, merge, (first, past the last, split)]; vectors: [piece, leaf, part]."""
    size, n, width = vectors.shape
    row, out = np.arange(size), np.zeros((size, n - 1, 3), np.int64)
    sums = np.concatenate([np.zeros((size, 1, width)), vectors.cumsum(axis=1)], axis=1)
    edges = np.tile(np.arange(n + 1), (size, 1))
    reps = transform((sums[:, 1:] - sums[:, :-1]).reshape(size * n, width)).reshape(size, n, -1)
    for m in range(n - 1):
        at = np.linalg.norm(reps[:, 1:] - reps[:, :-1], axis=2).argmin(axis=1)
        i, k, j = edges[row, at], edges[row, at + 1], edges[row, at + 2]
        out[:, m] = np.stack([i, j, k], axis=1)
        edges, reps = without(edges, at + 1), without(reps, at + 1)
        reps[row, at] = transform(sums[row, j] - sums[row, i])
    return out


def depths(nodes: np.ndarray) -> np.ndarray:
    """[piece, merge]: the depth of each node of trees of one length, [piece, merge, (first, past the last, split)].

    From the last merge back, one cluster begins at a leaf at a time, so its depth stands at that leaf.
    """
    size, n = len(nodes), nodes.shape[1] + 1
    row, table, out = np.arange(size), np.zeros((size, n), np.int64), np.zeros(nodes.shape[:2], np.int64)
    for m in range(n - 2, -1, -1):
        i, _, k = nodes[:, m].T
        out[:, m] = table[row, i]
        table[row, i] = table[row, k] = out[:, m] + 1
    return out


def additive(vectors: np.ndarray, transform: Callable[[np.ndarray], np.ndarray], balance: float = 0.0, weight: str = "none") -> tuple[list[Node], np.ndarray]:
    """Least sum of distances between children, with an optional price of imbalance; negative costs as gains."""
    n = len(vectors)
    if (vectors < 0).any():
        raise ValueError("the additive program needs non-negative vectors")
    sums = np.vstack([np.zeros(vectors.shape[1]), vectors.cumsum(0)])
    reps = {(i, j): None for i in range(n) for j in range(i + 1, n + 1)}
    table = transform(np.array([sums[j] - sums[i] for i, j in reps]))
    place = {key: at for at, key in enumerate(reps)}
    weights = {"none": lambda m: 1.0, "log1p": np.log1p, "linear": float}[weight]

    def gain(i: int, ks: np.ndarray, j: int) -> np.ndarray:
        left, right = table[[place[i, int(k)] for k in ks]], table[[place[int(k), j] for k in ks]]
        return -(weights(j - i) * np.linalg.norm(left - right, axis=1) + balance * np.abs(2 * ks - i - j) / (j - i))

    return interval_program(n, gain, "earliest")


def affinity_program(affinity: np.ndarray, tie: str = "midpoint") -> tuple[list[Node], np.ndarray]:
    """Largest revenue: each pair of leaves pays its affinity for every leaf outside their smallest node."""
    n, prefix = len(affinity), prefix2(affinity)
    return interval_program(n, lambda i, ks, j: (n - (j - i)) * cross_sums(prefix, i, ks, j), tie)


def boundary_program(affinity: np.ndarray, contrast: np.ndarray, weight: float, balance: float = 0.0, tie: str = "midpoint") -> tuple[list[Node], np.ndarray]:
    """Normalised revenue mixed with the contrast of splits, weighted by their span, less squared imbalance."""
    n, prefix, whole = len(affinity), prefix2(affinity), denominator(affinity)

    def gain(i: int, ks: np.ndarray, j: int) -> np.ndarray:
        span = np.log(j - i) / np.log(n)
        revenue = (n - (j - i)) * cross_sums(prefix, i, ks, j) / whole if whole > 0 else 0.0
        uneven = (2 * ks - i - j) / (j - i)
        return (1 - weight) * revenue + (weight * span * contrast[ks - 1] - balance * uneven**2) / max(1, n - 1)

    return interval_program(n, gain, tie)


def interval_grid(n: int, size: int, gain: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], tie: str) -> tuple[list[list[Node]], np.ndarray]:
    """The trees and values of `size` interval programs at once, by interval_cuts."""
    cut, best = interval_cuts(n, size, gain, tie)
    return [unfold(n, lambda a, b, c=c: int(c[a, b])) for c in cut], best[:, 0, n]


def diagonals(table: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """table[.., first, past the last] at [i, k), [k, j), [k, k) and [i, j), for all intervals [i, j) of a length (rows) and their splits k.

    These are views of the table's diagonals, so nothing is gathered.
    """
    size, m = len(table), table.shape[1] - length
    a, b, c = table.strides
    view = lambda x, width, step: as_strided(x, (size, m, width), (a, b + c, step), writeable=False)
    return view(table[:, 0, 1:], length - 1, c), view(table[:, 1:, length:], length - 1, b), view(table[:, 1:, 1:], length - 1, b + c), view(table[:, 0, length:], 1, 0)


def interval_cuts(n: int, size: int, gain: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], tie: str) -> tuple[np.ndarray, np.ndarray]:
    """The cuts and values of all intervals of `size` programs, [program, first, past the last].

    gain(length, i, k, j) gives the gains of all splits k of all intervals [i, j) of a length, with one leading axis for
    the programs. Tables have that axis too, so a length is one step whatever the number of programs.
    """
    best = np.zeros((size, n + 1, n + 1))
    cut = np.zeros((size, n + 1, n + 1), np.int32)
    for length in range(2, n + 1):
        i = np.arange(n - length + 1)[:, None]
        step = np.arange(1, length)
        k, j = i + step, i + length
        left, right, _, _ = diagonals(best, length)
        values = left + right
        values += gain(length, i, k, j)
        near = values >= values.max(axis=2, keepdims=True) - 1e-12
        order = {"earliest": step, "latest": -step, "midpoint": np.abs(2 * step - length) * length + step}[tie].argsort()
        at = order[near[:, :, order].argmax(axis=2)]
        best[:, i[:, 0], j[:, 0]] = np.take_along_axis(values, at[:, :, None], 2)[:, :, 0]
        cut[:, i[:, 0], j[:, 0]] = i[:, 0] + 1 + at
    return cut, best


def affinity_cuts(affinity: np.ndarray, tie: str = "midpoint") -> tuple[np.ndarray, np.ndarray]:
    """interval_cuts of affinity_program for pieces of one length; affinity: [piece, leaf, leaf]."""
    n = affinity.shape[1]
    prefix = np.pad(affinity.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))

    def gain(length: int, i: np.ndarray, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (n - length) * (prefix[:, k, j] - prefix[:, i, j] - prefix[:, k, k] + prefix[:, i, k])

    return interval_cuts(n, len(affinity), gain, tie)


def spans(cut: np.ndarray) -> np.ndarray:
    """[program, first, past the last]: which intervals are nodes of the trees of cuts, leaves included."""
    n = cut.shape[1] - 1
    used = np.zeros(cut.shape, bool)
    used[:, 0, n] = True
    for length in range(n, 1, -1):
        for i in range(n - length + 1):
            at = np.flatnonzero(used[:, i, i + length])
            k = cut[at, i, i + length]
            used[at, i, k] = used[at, k, i + length] = True
    return used


def boundary_grid(affinity: np.ndarray, contrast: np.ndarray, grid: list[tuple[float, float]], tie: str = "midpoint") -> tuple[list[list[Node]], np.ndarray]:
    """boundary_program for each (weight, balance) of grid."""
    n, prefix, whole = len(affinity), prefix2(affinity), denominator(affinity)
    weight, balance = (np.array([g[x] for g in grid])[:, None, None] for x in (0, 1))

    def gain(length: int, i: np.ndarray, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        cross = prefix[k, j] - prefix[i, j] - prefix[k, k] + prefix[i, k]
        revenue = (n - length) * cross / whole if whole > 0 else np.zeros(k.shape)
        uneven = (2 * k - i - j) / length
        return (1 - weight) * revenue + (weight * np.log(length) / np.log(n) * contrast[k - 1] - balance * uneven**2) / max(1, n - 1)

    return interval_grid(n, len(grid), gain, tie)


def mixture_grid(vectors: np.ndarray, transforms: list[Callable[[np.ndarray], np.ndarray]], scales: list[float], weights: np.ndarray) -> tuple[list[list[Node]], np.ndarray]:
    """Additive programs, and their costs, for each row of weights of scaled distances; each distance is found once."""
    n = len(vectors)
    if (vectors < 0).any():
        raise ValueError("the additive program needs non-negative vectors")
    sums = np.vstack([np.zeros(vectors.shape[1]), vectors.cumsum(0)])
    a, b = np.triu_indices(n + 1, 1)
    tables = []
    for transform in transforms:
        reps = transform(sums[b] - sums[a])
        table = np.zeros((n + 1, n + 1, reps.shape[1]))
        table[a, b] = reps
        tables.append(table)

    def gain(length: int, i: np.ndarray, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        each = [np.linalg.norm(t[i, k] - t[k, j], axis=2) / s for t, s in zip(tables, scales, strict=True)]
        return -np.tensordot(weights, np.stack(each), axes=1)

    trees, best = interval_grid(n, len(weights), gain, "earliest")
    return trees, -best


def average_linkage(affinity: np.ndarray) -> list[Node]:
    """Merge the neighbours with the largest mean affinity, the first on ties."""
    return boundary_linkage(affinity, np.zeros(max(0, len(affinity) - 1)), 0.0)


def boundary_linkage(affinity: np.ndarray, contrast: np.ndarray, weight: float, balance: float = 0.0) -> list[Node]:
    """Merge the neighbours with the best value, the first on ties; a merge changes the values of its two neighbours alone."""
    prefix = prefix2(affinity)

    def values(edges: np.ndarray) -> np.ndarray:
        i, k, j = edges[:-2], edges[1:-1], edges[2:]
        mean = (prefix[k, j] - prefix[i, j] - prefix[k, k] + prefix[i, k]) / ((k - i) * (j - k))
        return (1 - weight) * mean - weight * contrast[k - 1] - balance * ((2 * k - i - j) / (j - i)) ** 2

    edges, out = np.arange(len(affinity) + 1), []
    value = values(edges)
    while len(value):
        at = int(value.argmax())
        i, k, j = edges[at : at + 3].tolist()
        out.append((i, j, k))
        edges, value = np.delete(edges, at + 1), np.delete(value, at)
        low, high = max(0, at - 1), min(len(value), at + 1)
        value[low:high] = values(edges[low : high + 2])
    return out


def edit_distance(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> int:
    """Unit-cost tree edit distance of two trees in postorder as (label, leftmost leaf's postorder number)."""
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    keys = lambda t: sorted({l: i for i, (_, l) in enumerate(t)}.values())  # noqa: E731, E741
    # Lists, as single numbers of an array cost several times as much to read.
    tree = [[0] * m for _ in range(n)]
    ends = [(y, b[y][1]) for y in keys(b)]
    for x in keys(a):
        la = a[x][1]
        for y, lb in ends:
            row = list(range(y - lb + 2))
            d = [row]
            for i in range(la, x + 1):
                label, low = a[i]
                up, row, known = row, [i - la + 1], tree[i]
                d.append(row)
                last, whole, from_ = row[0], low == la, d[low - la]
                for c in range(y - lb + 1):
                    j = lb + c
                    other, start = b[j]
                    v = (up[c + 1] if up[c + 1] < last else last) + 1
                    if whole and start == lb:
                        w = up[c] + (label != other)
                        last = known[j] = w if w < v else v
                    else:
                        w = from_[start - lb] + known[j]
                        last = w if w < v else v
                    row.append(last)
    return tree[n - 1][m - 1]
