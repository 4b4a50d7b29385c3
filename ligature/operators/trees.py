"""Trees of pieces as node tables, and operators on node tables.

A node table has rows (piece, node, parent, depth, first, last, split, start, end, merge_order): the node covers the
leaves first..last, its right child begins at leaf `split` (null for leaves), and the root has no parent. Builders run
once for each piece with its leaves packed into one row, whatever its length; tables of a piece are quadratic in its
leaves. An invalid piece, or one longer than a caller allows, becomes a status row instead of an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import kernels as K
from .dealing import dealt
from .packs import CELLS

NODES = "piece string, node int, parent int, depth int, first int, last int, split int, start double, end double, merge_order int, mean_affinity double, objective double, status string"

TRANSFORMS = {"plain": lambda v: v}


def unit(v: np.ndarray) -> np.ndarray:
    sums = v.sum(axis=1, keepdims=True)
    return np.divide(v, sums, out=np.full_like(v, 1 / v.shape[1]), where=sums > 0)


def profile_transform(v: np.ndarray) -> np.ndarray:
    rows = np.array(V.PROFILES)
    rows = rows - rows.mean(axis=1, keepdims=True)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    c = unit(v)
    c = c - c.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.divide(c, norm, out=np.zeros_like(c), where=norm > 0) @ rows.T


def fifths_transform(v: np.ndarray) -> np.ndarray:
    angle = np.empty(12)
    angle[V.FIFTHS] = 2 * np.pi * np.arange(12) / 12
    return np.column_stack((unit(v) @ np.cos(angle), unit(v) @ np.sin(angle)))


TRANSFORMS |= {"euclidean": unit, "key_profile": profile_transform, "circle_of_fifths": fifths_transform}


class Metric:
    """A distance function of two vectors, given by the caller; only methods on affinities take it."""

    def __init__(self, function: Callable[[np.ndarray, np.ndarray], float]) -> None:
        self.function = function


#: The name of a transform, a caller's transform of rows of vectors to rows of coordinates, or a caller's metric.
Distance = str | Callable[[np.ndarray], np.ndarray] | Metric


def transform_of(name: Distance) -> Callable[[np.ndarray], np.ndarray]:
    if isinstance(name, Metric):
        raise ValueError("this method needs a transform instead of a metric")
    return name if callable(name) else TRANSFORMS[name]


def all_distances(vectors: np.ndarray, name: Distance) -> np.ndarray:
    if isinstance(name, Metric):
        n = len(vectors)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                d[i, j] = d[j, i] = float(name.function(vectors[i], vectors[j]))
        if not (np.isfinite(d).all() and (d >= 0).all()):
            raise ValueError("a metric must give finite distances of at least 0")
        return d
    reps = transform_of(name)(vectors)
    out = np.empty((len(reps), len(reps)))
    # By blocks of rows: the differences have an axis more than the distances.
    step = max(1, CELLS // max(1, reps.size))
    for at in range(0, len(reps), step):
        out[at : at + step] = np.linalg.norm(reps[at : at + step, None] - reps[None], axis=2)
    return out


def matrix(vectors: np.ndarray, name: Distance) -> np.ndarray:
    """Affinities with the piece's own scale."""
    d = all_distances(vectors, name)
    some = np.concatenate([row[k + 1 :] for k, row in enumerate(d)])
    some = some[some > 1e-12]
    # In place, as a long piece's table is large.
    d /= np.median(some, overwrite_input=True) if len(some) else 1.0
    np.square(d, out=d)
    d *= -0.5
    return np.exp(d, out=d)


def matrices(vectors: np.ndarray, name: Distance) -> np.ndarray:
    """matrix of each of many pieces of one length; vectors: [piece, leaf, part]."""
    size, n = vectors.shape[:2]
    reps = transform_of(name)(vectors.reshape(size * n, -1)).reshape(size, n, -1)
    d = np.linalg.norm(reps[:, :, None] - reps[:, None], axis=3)
    some = d[:, *np.triu_indices(n, 1)]
    count, row = (some > 1e-12).sum(axis=1), np.arange(size)
    some = np.sort(np.where(some > 1e-12, some, np.inf), axis=1) if n > 1 else np.ones((size, 1))
    scale = np.where(count > 0, (some[row, np.maximum(count - 1, 0) // 2] + some[row, np.minimum(count // 2, some.shape[1] - 1)]) / 2, 1.0)
    return np.exp(-0.5 * (d / scale[:, None, None]) ** 2)


def contrast_of(vectors: np.ndarray, name: Distance, context: int) -> np.ndarray:
    """Unscaled contrast of each split, cut to [0, 1]."""
    d, n = all_distances(vectors, name), len(vectors)
    out = []
    for k in range(1, n):
        left, right = np.arange(max(0, k - context), k), np.arange(k, min(n, k + context))
        inner = lambda x: d[np.ix_(x, x)][np.triu_indices(len(x), 1)].mean() if len(x) > 1 else 0.0
        out.append(d[np.ix_(left, right)].mean() - (inner(left) + inner(right)) / 2)
    return np.clip(np.array(out), 0, 1)


def build(method: str, vectors: np.ndarray, name: Distance, piece: str, options: dict) -> tuple[list[K.Node], float | None]:
    n = len(vectors)
    if method == "balanced":
        return K.balanced(n), None
    if method == "random":
        return K.random_merges(n, f"{options.get('seed', 0)}|{piece}"), None
    if method == "greedy":
        return K.greedy_distance(vectors, transform_of(name)), None
    if method == "additive":
        nodes, best = K.additive(vectors, transform_of(name), options.get("balance", 0.0), options.get("length_weight", "none"))
        return nodes, -float(best[0, n])
    aff = matrix(vectors, name)
    if method == "linkage":
        return K.average_linkage(aff), None
    if method == "affinity":
        nodes, best = K.affinity_program(aff, options.get("tie", "midpoint"))
        return nodes, float(best[0, n])
    contrast, weight, balance = contrast_of(vectors, name, options.get("context", 2)), options.get("weight", 0.5), options.get("balance", 0.0)
    if method == "boundary":
        nodes, best = K.boundary_program(aff, contrast, weight, balance, options.get("tie", "midpoint"))
        return nodes, float(best[0, n])
    if method == "boundary_greedy":
        return K.boundary_linkage(aff, contrast, weight, balance), None
    raise ValueError(f"no such method: {method}")


METHODS = ("balanced", "random", "greedy", "additive", "linkage", "affinity", "boundary", "boundary_greedy")


def node_rows(piece: str, nodes: list[K.Node], edges: np.ndarray, aff: np.ndarray | None, objective: float | None) -> list[tuple]:
    """Rows in preorder."""
    n = len(edges) - 1
    prefix = K.prefix2(aff) if aff is not None else None
    order = {(i, j): (m, k) for m, (i, j, k) in enumerate(nodes)}
    rows, stack = [], [(0, n, None, 0)]
    while stack:
        i, j, parent, depth = stack.pop()
        m, k = order.get((i, j), (-1, None))
        mean = None
        if k is not None and prefix is not None:
            mean = float(K.cross_sums(prefix, i, np.array([k]), j)[0] / ((k - i) * (j - k)))
        at = len(rows)
        rows.append((piece, at, parent, depth, i, j - 1, k, float(edges[i]), float(edges[j]), m, mean, objective if parent is None else None, "success"))
        if k is not None:
            stack += [(k, j, at, depth + 1), (i, k, at, depth + 1)]
    return rows


def trees(leaves: DataFrame, method: str, distance: Distance = "euclidean", most: int | None = None, **options) -> DataFrame:
    """The node table of each piece; leaves: (piece, leaf, start, end, vec). The distance may be the caller's own.

    The leaves of a piece are packed by one aggregation. All pieces get a tree, however long; only if a caller gives
    `most`, pieces over so many leaves are reported before any vector is shipped to Python. Failures become a row with
    their message as status.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    packed = dealt(leaves, "piece").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("leaf", "start", "end", F.col("vec").cast("array<double>").alias("vec")))).alias("leaves"))
    small = packed if most is None else packed.where(F.size("leaves") <= most)

    def run(batches):
        for frame in batches:
            rows: list[tuple] = []
            for piece, items in zip(frame["piece"], frame["leaves"], strict=True):
                try:
                    vectors = np.array([list(x["vec"]) for x in items])
                    edges = np.array([x["start"] for x in items] + [items[-1]["end"]])
                    nodes, value = build(method, vectors, distance, piece, options)
                    rows += node_rows(piece, nodes, edges, matrix(vectors, distance) if method not in ("additive", "greedy") else None, value)
                except ValueError as e:
                    rows.append((piece, *[None] * 11, f"failed: {e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
            yield out.astype({c: "Int32" for c in ("node", "parent", "depth", "first", "last", "split", "merge_order")})

    if most is None:
        return small.mapInPandas(run, NODES)
    long_ = packed.where(F.size("leaves") > most).select("piece", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in NODES.split(", ")[1:-1])), F.concat(F.lit("skipped: "), F.size("leaves").cast("string"), F.lit(f" bins exceeds max_bins={most}")).alias("status"))
    return small.mapInPandas(run, NODES).unionByName(long_)


def internal(nodes: DataFrame) -> DataFrame:
    return nodes.where("split is not null")


def counts(nodes: DataFrame) -> DataFrame:
    """(piece, nodes, leaves)."""
    return nodes.where("node is not null").groupBy("piece").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("split").isNull(), 1).otherwise(0)).alias("leaves"))


def pruned(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes down to a depth; those at the depth become leaves."""
    return nodes.where(F.col("depth") <= depth).withColumn("split", F.when(F.col("depth") < depth, F.col("split")))


def prune_depths(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(piece, depth, leaves): the depth whose pruned tree has leaves nearest to the target, the shallower on ties."""
    deepest = nodes.groupBy("piece").agg(F.max("depth").alias("deepest"))
    grid = deepest.select("piece", F.explode(F.sequence(F.lit(0), "deepest")).alias("at"))
    cut = nodes.join(grid, "piece").where((F.col("depth") == F.col("at")) | (F.col("split").isNull() & (F.col("depth") < F.col("at"))))
    size = cut.groupBy("piece", "at").agg(F.count("*").alias("leaves")).join(targets, "piece")
    best = size.groupBy("piece").agg(F.min(F.struct(F.abs(F.col("leaves") - F.col("target")).alias("gap"), F.col("at").alias("depth"), "leaves")).alias("m"))
    return best.select("piece", "m.depth", "m.leaves")


def split_times(nodes: DataFrame) -> DataFrame:
    """Internal nodes with `t`, the time of their split: where the right child starts."""
    child = nodes.select("piece", F.col("parent").alias("p"), F.col("first").alias("f"), F.col("start").alias("t"))
    one = internal(nodes)
    return one.join(child, (one["piece"] == child["piece"]) & (one["node"] == child["p"]) & (one["split"] == child["f"])).select(one["*"], child["t"])


def top_splits(nodes: DataFrame, depth: int) -> DataFrame:
    """(piece, t): splits above a depth."""
    return split_times(nodes).where(F.col("depth") < depth).select("piece", "t").distinct()


def first_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("piece").orderBy(*order)))
    return ranked.where(F.col("_r") <= k).drop("_r")


def k_splits(nodes: DataFrame, k: int) -> DataFrame:
    """(piece, t): the splits of the k latest merges."""
    return first_k(split_times(nodes), k, F.desc("merge_order"), F.desc(F.col("end") - F.col("start")), F.asc("node")).select("piece", "t")


def prominence(nodes: DataFrame) -> DataFrame:
    """(piece, t, prominence, leaf_count, mean_affinity, merge_order): splits with the share of the piece they divide."""
    whole = nodes.where("parent is null").select("piece", (F.col("end") - F.col("start")).alias("whole"))
    return split_times(nodes).join(whole, "piece").select("piece", "t", ((F.col("end") - F.col("start")) / F.col("whole")).alias("prominence"), (F.col("last") - F.col("first") + 1).alias("leaf_count"), "mean_affinity", "merge_order")


def prominent(nodes: DataFrame, k: int) -> DataFrame:
    order = (F.desc("prominence"), F.desc("leaf_count"), F.asc_nulls_last("mean_affinity"), F.desc("merge_order"), F.asc("t"))
    return first_k(prominence(nodes), k, *order)


def salience(nodes: DataFrame, contrast: DataFrame | None = None) -> DataFrame:
    """(piece, t, split, leaf_count, salience): span weight times the contrast (1 without any) of each split."""
    n = nodes.where("parent is null").select("piece", (F.col("last") + 1).alias("n"))
    rows = split_times(nodes).join(n, "piece")
    value = F.lit(1.0)
    if contrast is not None:
        rows, value = rows.join(contrast.select("piece", "split", "contrast"), ["piece", "split"]), F.col("contrast")
    span = F.col("last") - F.col("first") + 1
    return rows.select("piece", "t", "split", span.alias("leaf_count"), (V.span_weight(span, F.col("n")) * value).alias("salience"))


def salient(nodes: DataFrame, contrast: DataFrame | None = None, threshold: float | None = None, budget: int | None = None) -> DataFrame:
    if (threshold is None) == (budget is None):
        raise ValueError("give either threshold or budget")
    rows = salience(nodes, contrast)
    if threshold is not None:
        return rows.where(F.col("salience") >= threshold)
    return first_k(rows, budget, F.desc("salience"), F.desc("leaf_count"), F.asc("t"), F.asc("split"))


def shape(nodes: DataFrame) -> DataFrame:
    """Depth and imbalance of each piece's tree."""
    left, right = F.col("split") - F.col("first"), F.col("last") + 1 - F.col("split")
    leaf = F.col("split").isNull()
    s = nodes.groupBy("piece").agg(
        F.sum(leaf.cast("int")).alias("leaves"), F.max(F.when(leaf, F.col("depth"))).alias("max_depth"), F.sum(F.when(leaf, F.col("depth")).otherwise(0)).alias("sackin"),
        F.coalesce(F.sum(F.abs(left - right)), F.lit(0)).alias("colless"), F.coalesce(F.sum((left == 1).cast("int") + (right == 1).cast("int")), F.lit(0)).alias("single"), F.sum((~leaf).cast("int")).alias("inner"),
        F.coalesce(F.max(F.when(F.col("parent").isNull(), F.least(left, right) / F.greatest(left, right))), F.lit(1.0)).alias("root_ratio"),
    )
    n = F.col("leaves")
    return s.select(
        "piece", "leaves", "max_depth", "sackin", "colless", "root_ratio", (F.col("max_depth") / F.greatest(F.lit(1), n - 1)).alias("depth_share"),
        (F.col("sackin") / F.greatest(F.lit(1), n * F.greatest(F.lit(1), n - 1))).alias("sackin_share"), (F.col("colless") / F.greatest(F.lit(1.0), (n - 1) * (n - 2) / 2)).alias("colless_share"),
        (F.col("single") / F.greatest(F.lit(1), 2 * F.col("inner"))).alias("singleton_share"),
    )


def revenue(nodes: DataFrame, aff: DataFrame) -> DataFrame:
    """(piece, revenue, normalised) of any tree; aff: (piece, i, j, aff) for i < j.

    A pair pays at its smallest common node, the deepest one that splits between its leaves. A node's pairs are listed by
    the leaves of its children, so a piece has a row for each pair instead of one for each pair and node.
    """
    n = nodes.where("parent is null").select("piece", (F.col("last") + 1).alias("n"))
    inner = internal(nodes).join(n, "piece").select("piece", "n", (F.col("n") - (F.col("last") - F.col("first") + 1)).alias("w"), F.explode(F.sequence("first", F.col("split") - 1)).alias("i"), "split", "last")
    pairs = inner.select("piece", "n", "w", "i", F.explode(F.sequence("split", "last")).alias("j"))
    paid = pairs.join(aff, ["piece", "i", "j"]).groupBy("piece", "n").agg(F.sum(F.col("w") * F.col("aff")).alias("revenue"), F.sum("aff").alias("mass"))
    share = F.when(F.col("n") > 2, F.coalesce(F.try_divide(F.col("revenue"), (F.col("n") - 2) * F.col("mass")), F.lit(0.0))).otherwise(F.lit(0.0))
    return paid.select("piece", "revenue", share.alias("normalised"))


def additive_cost(nodes: DataFrame, leaves: DataFrame, distance: str) -> DataFrame:
    """(piece, cost): the sum over splits of the distance between the summed vectors of both children, for any tree."""
    inner = internal(nodes).select("piece", "node", "first", "last", "split")
    parts = leaves.select("piece", "leaf", F.posexplode("vec").alias("k", "x")).join(inner, "piece").where((F.col("leaf") >= F.col("first")) & (F.col("leaf") <= F.col("last")))
    side = lambda cond: F.sum(F.when(cond, F.col("x")).otherwise(0.0))
    sums = parts.groupBy("piece", "node", "k").agg(side(F.col("leaf") < F.col("split")).alias("a"), side(F.col("leaf") >= F.col("split")).alias("b"))
    rows = sums.groupBy("piece", "node").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("s"))
    return rows.groupBy("piece").agg(F.sum(V.distance(distance, F.col("s.a"), F.col("s.b"))).alias("cost"))


def boundary_objective(nodes: DataFrame, aff: DataFrame, contrast: DataFrame, weight: float, balance: float) -> DataFrame:
    """(piece, revenue, reward, penalty, objective) of any tree for the boundary-aware objective."""
    n = nodes.where("parent is null").select("piece", (F.col("last") + 1).alias("n"))
    size = F.col("last") - F.col("first") + 1
    inner = internal(nodes).join(contrast.select("piece", "split", "contrast"), ["piece", "split"]).join(n, "piece")
    uneven = (2 * F.col("split") - F.col("first") - F.col("last") - 1) / size
    terms = inner.groupBy("piece", "n").agg(F.sum(V.span_weight(size, F.col("n")) * F.col("contrast")).alias("s"), F.sum(uneven * uneven).alias("u"))
    each = terms.join(revenue(nodes, aff), "piece").select("piece", F.col("normalised").alias("revenue"), (F.col("s") / F.greatest(F.lit(1), F.col("n") - 1)).alias("reward"), (F.col("u") / F.greatest(F.lit(1), F.col("n") - 1)).alias("penalty"))
    return each.withColumn("objective", (1 - weight) * F.col("revenue") + weight * F.col("reward") - balance * F.col("penalty"))


def invalid(nodes: DataFrame) -> DataFrame:
    """Nodes that break an ordered binary tree: children that don't tile their parent. Empty for valid tables."""
    child = nodes.where("parent is not null").groupBy("piece", F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.min("first").alias("f"), F.max("last").alias("l"), F.sum(F.col("last") - F.col("first") + 1).alias("size"))
    inner = internal(nodes).join(child, ["piece", "node"], "left")
    good = (F.col("children") == 2) & (F.col("f") == F.col("first")) & (F.col("l") == F.col("last")) & (F.col("size") == F.col("last") - F.col("first") + 1)
    return inner.where(~F.coalesce(good, F.lit(False))).select("piece", "node")


def edges(nodes: DataFrame, depth: int) -> DataFrame:
    """(piece, node, centre, width, depth, parent_centre, parent_width): for drawing, down to a depth."""
    one = nodes.where(F.col("depth") <= depth).select("piece", "node", "parent", "depth", ((F.col("start") + F.col("end")) / 2).alias("centre"), (F.col("end") - F.col("start")).alias("width"))
    up = one.select("piece", F.col("node").alias("parent"), F.col("centre").alias("parent_centre"), F.col("width").alias("parent_width"))
    return one.join(up, ["piece", "parent"], "left").select("piece", "node", "centre", "width", "depth", "parent_centre", "parent_width")


def outline(nodes: DataFrame) -> DataFrame:
    """(piece, node, line): an indented line for each node."""
    return nodes.select("piece", "node", F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.lit("["), F.col("first").cast("string"), F.lit(","), F.col("last").cast("string"), F.lit("]")).alias("line"))


def postorder(nodes: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(label, leftmost leaf) in postorder from preorder rows (depth, _, label)."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[int, str, int]] = []
    for depth, _, label in [*nodes, (-1, 0, "")]:
        while stack and stack[-1][0] >= depth:
            _, name, low = stack.pop()
            out.append((name, low if low < len(out) else len(out)))
        stack.append((depth, label, len(out)))
    return out


def flat_tree(segments: DataFrame) -> DataFrame:
    """(piece, node, parent, depth, first, last, start, end, label): segments (piece, seg, start, end, label) below one root."""
    root = segments.groupBy("piece").agg(F.min("seg").alias("first"), F.max("seg").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    top = root.select("piece", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("depth"), "first", "last", "start", "end", F.lit("ROOT").alias("label"))
    below = segments.select("piece", (F.col("seg") + 1).cast("int").alias("node"), F.lit(0).alias("parent"), F.lit(1).alias("depth"), F.col("seg").alias("first"), F.col("seg").alias("last"), "start", "end", "label")
    return top.unionByName(below)


#: Trees of a dataset are dealt to blocks of about so many; a task compares two blocks.
PAIR_BLOCK = 32
PAIRS = "piece_a string, piece_b string, ted long, nodes_a long, nodes_b long, by_max double, by_sum double"


def pair_blocks(a: DataFrame, b: DataFrame | None = None, dataset: str = "dataset", block: int = PAIR_BLOCK) -> DataFrame:
    """(dataset, i, j, trees): packed trees of block i of a and block j of b (or a, for i <= j), each with its side.

    A tree goes to as many rows as the other side has blocks, and a row holds about two blocks, however large a dataset.
    """

    def dealt_trees(df: DataFrame) -> DataFrame:
        trees = df.groupBy(dataset, "piece").agg(F.array_sort(F.collect_list(F.struct("node", "depth", "label"))).alias("tree"))
        sizes = trees.groupBy(dataset).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        return trees.join(sizes, dataset).withColumn("own", F.pmod(F.xxhash64("piece"), F.col("n")).cast("int"))

    one = dealt_trees(a)
    if b is None:
        rows = one.select(dataset, "piece", "tree", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        rows = rows.select(dataset, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "piece", "tree")
    else:
        two = dealt_trees(b)
        n = lambda df: df.select(dataset, F.col("n").alias("m")).distinct()
        spread = lambda x, y, own, other, side: x.join(n(y), dataset).select(dataset, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias(other), F.col("own").alias(own), F.lit(side).alias("side"), "piece", "tree").select(dataset, "i", "j", "side", "piece", "tree")
        rows = spread(one, two, "i", "j", 0).unionByName(spread(two, one, "j", "i", 1))
    return dealt(rows, dataset, "i", "j").groupBy(dataset, "i", "j").agg(F.array_sort(F.collect_list(F.struct("side", "piece", "tree"))).alias("trees"))


def tree_pairs(a: DataFrame, b: DataFrame | None = None, dataset: str = "dataset", block: int = PAIR_BLOCK) -> DataFrame:
    """(dataset, piece_a, piece_b, ted, nodes_a, nodes_b, by_max, by_sum) of all pairs of trees in each dataset.

    Rows are (dataset, piece, node, depth, label). With b, each tree of a meets each of b with the same dataset; without,
    each unordered pair of a's trees comes once. The result is quadratic in the trees of a dataset, as asked for; blocks
    of trees meet blocks of trees, so a task's work is bounded by the square of a block, not of a dataset.
    """

    alone = b is None

    def run(batches):
        for f in batches:
            for name, i, j, trees in zip(f["dataset"], f["i"], f["j"], f["trees"], strict=True):
                known = [(t["side"], t["piece"], postorder([(r["depth"], r["node"], r["label"]) for r in t["tree"]])) for t in trees]
                left = [x for x in known if x[0] == 0]
                right = left if alone and i == j else [x for x in known if x[0] == 1]
                rows = []
                for _, p, x in left:
                    for _, q, y in right:
                        if alone and i == j and p >= q:
                            continue
                        u, v, s, t = (q, p, y, x) if alone and p > q else (p, q, x, y)
                        d = K.edit_distance(s, t)
                        rows.append((name, u, v, d, len(s), len(t), d / max(1, len(s), len(t)), d / max(1, len(s) + len(t))))
                yield pd.DataFrame(rows, columns=["dataset", *(c.split()[0] for c in PAIRS.split(", "))])

    found = pair_blocks(a, b, dataset, block).select(F.col(dataset).cast("string").alias("dataset"), "i", "j", "trees").mapInPandas(run, f"dataset string, {PAIRS}")
    return found.withColumnRenamed("dataset", dataset)


def tree_classes(trees: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, piece, form, depths, labels): trees with the name of their class; those of a class are equal in all nodes.

    Rows are (dataset, piece, node, depth, label) in preorder. A class is named by its least dataset and piece, as JSON.
    """
    packed = trees.groupBy(dataset, "piece").agg(F.array_sort(F.collect_list(F.struct("node", "depth", "label"))).alias("t"))
    one = packed.select(dataset, "piece", F.col("t.depth").alias("depths"), F.col("t.label").alias("labels"))
    # The group of a class is one row of two texts, not of its trees.
    named = one.groupBy("depths", "labels").agg(F.to_json(F.min(F.struct(dataset, "piece"))).alias("form"))
    return one.join(named, ["depths", "labels"]).select(dataset, "piece", "form", "depths", "labels")


def class_pairs(a: DataFrame, b: DataFrame | None = None, dataset: str = "dataset") -> DataFrame:
    """(dataset, form_a, form_b, pairs): for two classes how many pairs of trees with the same dataset they stand for.

    Rows are those of tree_classes, from one call. With b, trees of a meet those of b; without, each unordered pair of
    a's trees counts once, also those of one class.
    """
    count = lambda df, c, n: df.groupBy(dataset, F.col("form").alias(c)).agg(F.count("*").alias(n))
    both = count(a, "form_a", "n").join(count(a if b is None else b, "form_b", "m"), dataset)
    if b is not None:
        return both.select(dataset, "form_a", "form_b", (F.col("n") * F.col("m")).alias("pairs"))
    number = F.when(F.col("form_a") == F.col("form_b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("m"))
    return both.where("form_a <= form_b").select(dataset, "form_a", "form_b", number.alias("pairs")).where("pairs > 0")


def class_distances(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (..., form_a, form_b) with (ted, nodes_a, nodes_b, by_max, by_sum); each two classes are compared once, whatever the datasets."""
    forms = classes.select("form", "depths", "labels").dropDuplicates(["form"])
    side = lambda c: forms.select(F.col("form").alias(f"form_{c}"), F.col("depths").alias(f"d_{c}"), F.col("labels").alias(f"l_{c}"))
    low, high = F.least("form_a", "form_b"), F.greatest("form_a", "form_b")
    some = pairs.where("form_a <> form_b").select(low.alias("form_a"), high.alias("form_b")).distinct()
    rows = dealt(some.join(side("a"), "form_a").join(side("b"), "form_b"), "form_a", "form_b")

    def run(batches):
        for f in batches:
            known: dict[str, list[tuple[str, int]]] = {}

            def tree(name, depths, labels, known=known):
                if name not in known:
                    known[name] = postorder([(int(d), 0, x) for d, x in zip(depths, labels, strict=True)])
                return known[name]

            out = [(p, q, K.edit_distance(tree(p, a, b), tree(q, c, d))) for p, q, a, b, c, d in zip(f["form_a"], f["form_b"], f["d_a"], f["l_a"], f["d_b"], f["l_b"], strict=True)]
            yield pd.DataFrame(out, columns=["low", "high", "ted"])

    found = rows.mapInPandas(run, "low string, high string, ted long")
    size = lambda c: forms.select(F.col("form").alias(f"form_{c}"), F.size("depths").cast("long").alias(f"nodes_{c}"))
    told = pairs.withColumns({"low": low, "high": high}).join(found, ["low", "high"], "left").drop("low", "high").join(size("a"), "form_a").join(size("b"), "form_b")
    # A class is at distance 0 from itself.
    told = told.withColumn("ted", F.coalesce("ted", F.lit(0)))
    most, both = F.greatest(F.lit(1), "nodes_a", "nodes_b"), F.greatest(F.lit(1), F.col("nodes_a") + F.col("nodes_b"))
    return told.withColumns({"by_max": F.col("ted") / most, "by_sum": F.col("ted") / both})


BUNDLE = "piece string, raw_ted long, pruned_ted long, raw_by_max double, pruned_by_max double, raw_by_sum double, pruned_by_sum double, nodes long, reference_nodes long, pruned_nodes long, pruned_leaves long, segments long, depth int, centres int, widths int"


def edit_bundles(nodes: DataFrame, segments: DataFrame, totals: DataFrame, centres: int = 20, widths: int = 10) -> DataFrame:
    """Edit distances of each piece's tree, whole and pruned, to the flat tree of its segments, with all sizes, in one call.

    nodes: a node table, segments: (piece, seg, start, end), totals: (piece, total). The tree is pruned at the depth whose
    leaves are nearest in number to the segments, the shallower on ties. Labels are buckets of centre and width.
    Pieces without segments are left out.
    """
    tree = dealt(nodes.where("node is not null"), "piece").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("node", "depth", "start", "end", F.col("split").isNull().alias("leaf")))).alias("nodes"))
    flat = dealt(segments, "piece").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "end"))).alias("segs"))
    rows = tree.join(flat, "piece").join(totals.select("piece", "total"), "piece")

    def run(batches):
        for f in batches:
            out = []
            for piece, some, segs, total in zip(f["piece"], f["nodes"], f["segs"], f["total"], strict=True):

                def labelled(items, total=total):
                    bucket = lambda x, n: max(0, min(n - 1, int(np.floor(x * n / total)))) if total else 0
                    return postorder([(d, 0, f"c{bucket((s + e) / 2, centres)}w{bucket(e - s, widths)}") for d, s, e in items])

                target = len(segs)
                deepest = max(x["depth"] for x in some)
                size = [sum(x["depth"] == d or (x["leaf"] and x["depth"] < d) for x in some) for d in range(deepest + 1)]
                depth = min(range(deepest + 1), key=lambda d: (abs(size[d] - target), d))
                whole = labelled([(x["depth"], x["start"], x["end"]) for x in some])
                short = labelled([(x["depth"], x["start"], x["end"]) for x in some if x["depth"] <= depth])
                ref = labelled([(0, min(x["start"] for x in segs), max(x["end"] for x in segs)), *((1, x["start"], x["end"]) for x in segs)])
                raw, cut = K.edit_distance(whole, ref), K.edit_distance(short, ref)
                most = lambda d, t: d / max(1, len(t), len(ref))  # noqa: E731,B023
                both = lambda d, t: d / max(1, len(t) + len(ref))  # noqa: E731,B023
                out.append((piece, raw, cut, most(raw, whole), most(cut, short), both(raw, whole), both(cut, short), len(whole), len(ref), len(short), size[depth], target, depth, centres, widths))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BUNDLE.split(", ")])

    return rows.select("piece", "nodes", "segs", "total").mapInPandas(run, BUNDLE)


def edit_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(piece, ted, nodes_a, nodes_b, by_max, by_sum) of the trees of a and b with equal piece; rows (piece, node, depth, label)."""
    pack = lambda df, c: df.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("node", "depth", "label"))).alias(c))
    return packed_distances(pack(a, "a").join(pack(b, "b"), "piece"))


def packed_distances(pairs: DataFrame) -> DataFrame:
    """Edit distances of rows (piece, a, b) with two packed trees."""

    def run(batches):
        for f in batches:
            rows = []
            for piece, x, y in zip(f["piece"], f["a"], f["b"], strict=True):
                p, q = (postorder([(r["depth"], r["node"], r["label"]) for r in t]) for t in (x, y))
                d = K.edit_distance(p, q)
                rows.append((piece, d, len(p), len(q), d / max(1, len(p), len(q)), d / max(1, len(p) + len(q))))
            yield pd.DataFrame(rows, columns=["piece", "ted", "nodes_a", "nodes_b", "by_max", "by_sum"])

    return pairs.mapInPandas(run, "piece string, ted long, nodes_a long, nodes_b long, by_max double, by_sum double")
