"""Grids of settings in one kernel call against separate runs, loops and enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.functions import vectors as V
from ligature.operators import binning as B
from ligature.operators import grids as H
from ligature.operators import kernels as K
from ligature.operators import matching as M
from ligature.operators import trees as R

RNG = np.random.default_rng(4)
GRID = [(w, b) for w in (0.0, 0.4, 1.0) for b in (0.0, 0.2)]


def all_trees(i, j):
    if j - i == 1:
        yield []
        return
    for k in range(i + 1, j):
        for a, b in itertools.product(all_trees(i, k), all_trees(k, j)):
            yield [*a, *b, (i, j, k)]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 17])
@pytest.mark.parametrize("tie", ["earliest", "latest", "midpoint"])
def test_a_grid_of_programs_equals_a_loop(n, tie):
    for a in (R.matrix(RNG.random((n, 12)), "euclidean"), np.ones((n, n))):
        contrast = np.round(RNG.random(max(0, n - 1)), 1)
        trees, values = K.boundary_grid(a, contrast, GRID, tie)
        for g, nodes, value in zip(GRID, trees, values, strict=True):
            want, best = K.boundary_program(a, contrast, *g, tie) if n > 1 else ([], np.zeros((2, 2)))
            assert nodes == want and value == pytest.approx(best[0, n])


def test_mixtures_cost_least_of_all_trees():
    v, weights, scales = RNG.random((6, 12)), H.simplex(3, 3), [0.5, 0.3, 1.2]
    transforms = [R.TRANSFORMS[k] for k in ("euclidean", "circle_of_fifths", "key_profile")]

    def cost(tree, w):
        out = 0.0
        for i, j, k in tree:
            both = np.array([v[i:k].sum(0), v[k:j].sum(0)])
            out += sum(x / s * np.linalg.norm(np.subtract(*t(both))) for x, s, t in zip(w, scales, transforms, strict=True))
        return out

    trees, costs = K.mixture_grid(v, transforms, scales, weights)
    every = list(all_trees(0, 6))
    for w, tree, c in zip(weights, trees, costs, strict=True):
        assert c == pytest.approx(min(cost(t, w) for t in every)) and cost(tree, w) == pytest.approx(c)
    assert len(weights) == 10 and np.allclose(weights.sum(axis=1), 1) and weights.tolist() == sorted(weights.tolist())
    one, _ = K.mixture_grid(v, transforms, scales, np.array([[1.0, 0, 0]]))
    assert one[0] == K.additive(v, transforms[0])[0]


def test_most_matches_by_first_partners():
    for _ in range(300):
        p, r = (sorted(set(RNG.integers(0, 30, RNG.integers(0, 8)).tolist())) for _ in range(2))
        r = sorted(r + r[:2])
        fit = lambda a, b: abs(a - b) if abs(a - b) <= 3 else None
        n = len(M.ordered_match(p, r, fit))
        assert H.matches(p, r, 3) == (n, len(p) - n, len(r) - n)


def tables(spark, pieces=3, n=7):
    rows = [(f"p{p}", k, float(k), float(k + 1), RNG.random(12).tolist()) for p in range(pieces) for k in range(n)]
    leaves = spark.createDataFrame(rows, "piece string, leaf int, start double, end double, vec array<double>")
    marks = spark.createDataFrame([(f"p{p}", float(t)) for p in range(pieces) for t in (2, 4 + p % 2)], "piece string, t double")
    return leaves, marks


def test_trials_equal_single_trees(spark):
    leaves, marks = tables(spark)
    scores = {(kind, stage, p, k): float(RNG.random()) for kind in H.KINDS[1:] for stage in ("inner", "outer") for p in range(3) for k in range(1, 7)}
    rows = [(kind, stage, f"o{p}", "a", f"p{p}", k, s) for (kind, stage, p, k), s in scores.items()] + [(H.KINDS[0], "inner", "o", "a", "p0", k, 1.0) for k in range(1, 7)]
    contrasts = spark.createDataFrame(rows, "kind string, stage string, outer_work string, work string, piece string, split int, score double")
    got = H.trial_counts(leaves, marks, contrasts, GRID, [0.3], [0.5], 1.0).collect()
    # Two kinds, two stages, three pieces, six settings, two searches; oracle rows outside; the affinity trees alone once.
    assert len(got) == 2 * 3 * 6 * 2 * (2 + 3) + 2 * 2 * 2
    assert {r["weight"] for r in got if r["kind"] == H.KINDS[0]} == {0.0}
    vec = {f"p{p}": np.array([r["vec"] for r in leaves.where(f"piece = 'p{p}'").orderBy("leaf").collect()]) for p in range(3)}
    truth = {r["piece"]: r["m"] for r in marks.groupBy("piece").agg(F.sort_array(F.collect_list("t")).alias("m")).collect()}
    for r in got:
        p, c = r["piece"], np.array([scores.get((r["kind"], r["stage"], int(r["piece"][1]), k), 1.0) for k in range(1, 7)])
        a = R.matrix(vec[p], "euclidean")
        nodes = K.boundary_program(a, c, r["weight"], r["balance"])[0] if r["search"] == "exact" else K.boundary_linkage(a, c, r["weight"], r["balance"])
        value = {k: np.log(j - i) / np.log(7) * c[k - 1] for i, j, k in nodes}
        size = {k: j - i for i, j, k in nodes}
        best = sorted(value, key=lambda k: (-value[k], -size[k], k))
        take = [k for k in best if value[k] >= 0.3] if r["mode"] == "threshold" else best[: 3 if r["mode"] == "budget" else 2]
        assert (r["tp"], r["fp"], r["fn"]) == H.matches(sorted(map(float, take)), truth[p], 1.0), r


def test_chosen_weights_come_from_inner_folds(spark):
    def row(stage, mode, weight, balance, value, f1, search="exact", work="a"):
        return ("supervised", stage, "o", work if stage == "inner" else "o", "p", search, weight, balance, mode, value, f1, f1, f1)

    rows = []
    for mode, value in (("threshold", 0.2), ("threshold", 0.4), ("budget", 0.5)):
        for w, b in GRID:
            f = 0.9 if (w, b) == (0.4, 0.2) and value != 0.4 else 0.5
            rows += [row("inner", mode, w, b, value, f - d, s) for s, d in (("exact", 0.0), ("greedy", 0.1))]
            rows += [row("outer", mode, w, b, value, w / 2 + b)]
    rows += [row("outer", "oracle", w, b, None, w) for w, b in GRID]
    rated = spark.createDataFrame(rows, "kind string, stage string, outer_work string, work string, piece string, search string, weight double, balance double, mode string, value double, f1 double, recall double, precision double")
    got = {r["mode"]: (r["weight"], r["balance"], r["value"], r["inner_f1"], r["f1"]) for r in H.grid_select(rated).collect()}
    assert got == {"threshold": (0.4, 0.2, 0.2, 0.85, 0.4), "budget": (0.4, 0.2, 0.5, 0.85, 0.4), "oracle": (0.4, 0.2, None, 0.85, 0.4)}
    # Ties: the higher threshold, then the smaller balance and weight.
    tied = spark.createDataFrame([row(s, "threshold", w, b, v, 0.5) for s in ("inner", "outer") for w, b in GRID for v in (0.2, 0.4)], rated.schema)
    assert [(r["value"], r["balance"], r["weight"]) for r in H.grid_select(tied).collect()] == [(0.4, 0.0, 0.0)]


def test_configurations_equal_separate_runs(spark):
    notes = [(f"p{p}", float(t), float(RNG.random() * 3), int(RNG.integers(40, 80))) for p in range(4) for t in range(0, 24, 1 + p % 2)]
    notes = spark.createDataFrame(notes, "piece string, onset double, dur double, midi int")
    marks = spark.createDataFrame([(f"p{p}", float(t)) for p in range(3) for t in (6, 13, 20)], "piece string, t double")
    rows = B.leaves(B.of_sizes(notes, [2.0, 4.0]), "size")
    got = H.configurations(rows, marks, ["euclidean", "key_profile"], [1, 2], [3], [1.0, 2.0], replicates=2)
    found = {tuple(r[k] for k in ("piece", "size", "method", "kind", "budget", "tolerance")): (r["tp"], r["fp"], r["fn"]) for r in got.where("replicate = 0").collect()}
    checked = 0
    for size in (2.0, 4.0):
        leaves = B.leaves(notes, size)
        for name, method, distance in (("euclidean", "greedy", "euclidean"), ("key_profile", "greedy", "key_profile"), ("balanced", "balanced", "euclidean")):
            tree = R.trees(leaves, method, distance)
            for kind, budget, splits in (("depth", 1, R.top_splits(tree, 1)), ("depth", 2, R.top_splits(tree, 2)), ("budget", 3, R.k_splits(tree, 3))):
                for t in (1.0, 2.0):
                    for r in M.boundary_scores(splits, marks, t).collect():
                        assert found[r["piece"], size, name, kind, budget, t] == (r["tp"], r["fp"], r["fn"])
                        checked += 1
    assert checked == 2 * 3 * 3 * 2 * 4
    assert got.where("method = 'random'").select("replicate").distinct().count() == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffles_do_not_grow_with_the_grid(spark):
    leaves, marks = tables(spark)
    sized = lambda sizes: B.leaves(B.of_sizes(spark.createDataFrame([("p", 0.0, 1.0, 60)], "piece string, onset double, dur double, midi int"), sizes), "size")
    assert exchanges(sized([1.0])) == exchanges(sized([1.0, 2.0, 3.0, 4.0]))
    one = H.configurations(leaves.withColumn("size", F.lit(1.0)), marks, ["euclidean"], [1], [2], [1.0])
    many = H.configurations(leaves.withColumn("size", F.lit(1.0)), marks, ["euclidean", "key_profile"], [1, 2, 3], [2, 3, 4], [1.0, 2.0])
    assert exchanges(one) == exchanges(many)


def test_mixture_search(spark):
    leaves, marks = tables(spark, 4)
    names, scales = ["euclidean", "key_profile"], [0.5, 1.5]
    got = H.mixture_counts(leaves, marks, names, scales, 4, 2, 1.0)
    rated = M.with_rates(got).withColumn("work", F.concat(F.lit("w"), F.substring("piece", 2, 1).cast("int") % 2))
    rows = rated.collect()
    assert len(rows) == 4 * 5
    for r in rows:
        v = np.array([x["vec"] for x in leaves.where(F.col("piece") == r["piece"]).orderBy("leaf").collect()])
        assert r["objective"] == pytest.approx(K.mixture_grid(v, [R.TRANSFORMS[k] for k in names], scales, np.array([r["weights"]]))[1][0])
    means = {}
    for w in {tuple(r["weights"]) for r in rows}:
        works = [[r for r in rows if tuple(r["weights"]) == w and r["work"] == k] for k in ("w0", "w1")]
        mean = lambda c: round(float(np.mean([np.mean([r[c] for r in g]) for g in works])), 9)  # noqa: E731,B023
        means[w] = (-mean("f1"), -mean("recall"), mean("objective"), w)
    best = H.choose_mixture(rated).first()
    assert tuple(best["weights"]) == min(means.values())[3]


def test_negative_vectors_have_no_additive_tree():
    with pytest.raises(ValueError):
        K.mixture_grid(np.array([[1.0] * 12, [-1.0] * 12]), [R.TRANSFORMS["euclidean"]], [1.0], np.array([[1.0]]))


def test_bins_of_several_sizes_equal_each_alone(spark):
    notes = spark.createDataFrame([("p", 0.0, 2.5, 60), ("p", 7.0, 0.5, 62), ("q", 1.0, 9.0, 64)], "piece string, onset double, dur double, midi int")
    both = B.leaves(B.of_sizes(notes, [1.0, 3.0]), "size")
    for size in (1.0, 3.0):
        cols = ["piece", "leaf", "start", "end", V.total(F.col("vec")).alias("m")]
        assert sorted(map(tuple, both.where(F.col("size") == size).select(*cols).collect())) == sorted(map(tuple, B.leaves(notes, size).select(*cols).collect()))
