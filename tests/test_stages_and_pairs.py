"""Stages that go on after a stop, pairs of trees by blocks, edit-distance bundles, interval pairs and parts of works."""

from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.functions import scalars as S
from ligature.operators import examples as Y
from ligature.operators import matching as M
from ligature.operators import selection as C
from ligature.operators import trees as R
from ligature.plans import stages as P
from ligature.sources import forms

RNG = np.random.default_rng(6)


# Stages


def chain(calls, factor=2, stop=None):
    def doubled(spark, tables, settings):
        calls.append("double")
        return tables["numbers"].select((F.col("x") * settings["factor"]).alias("x"))

    def summed(spark, tables, settings):
        calls.append("sum")
        if stop == "sum":
            raise RuntimeError("the run is stopped")
        return tables["double"].agg(F.sum("x").alias("total"))

    def shares(spark, tables, settings):
        calls.append("share")
        return tables["double"].crossJoin(F.broadcast(tables["sum"])).select((F.col("x") / F.col("total")).alias("share"))

    return [P.Stage("double", doubled, ("numbers",), {"factor": factor}), P.Stage("sum", summed, ("double",)), P.Stage("share", shares, ("double", "sum"))]


def test_a_stopped_run_goes_on(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(5).select(F.col("id").alias("x")).write.parquet(source)
    calls = []
    with pytest.raises(RuntimeError):
        P.run(spark, folder, chain(calls, stop="sum"), {"numbers": source})
    assert calls == ["double", "sum"]
    calls.clear()
    tables, report = P.run(spark, folder, chain(calls), {"numbers": source})
    assert calls == ["sum", "share"] and [r[2] for r in report] == ["kept", "made", "made"]
    want = sorted(r["share"] for r in tables["share"].collect())
    assert want == pytest.approx([0, 0.1, 0.2, 0.3, 0.4])
    calls.clear()
    again, report = P.run(spark, folder, chain(calls), {"numbers": source})
    assert not calls and [r[2] for r in report] == ["kept"] * 3 and sorted(r["share"] for r in again["share"].collect()) == want


def test_settings_inputs_and_half_written_folders_are_made_anew(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(5).select(F.col("id").alias("x")).write.parquet(source)
    calls = []
    _, first = P.run(spark, folder, chain(calls), {"numbers": source})
    _, other = P.run(spark, folder, chain(calls, factor=3), {"numbers": source})
    assert [r[2] for r in other] == ["made"] * 3 and not {r[1] for r in first} & {r[1] for r in other}
    (tmp_path / "out" / f"sum-{first[1][1]}" / P.MARK).unlink()
    calls.clear()
    _, third = P.run(spark, folder, chain(calls), {"numbers": source})
    assert calls == ["sum"] and [r[2] for r in third] == ["kept", "made", "kept"]
    spark.range(7).select(F.col("id").alias("x")).write.mode("overwrite").parquet(source)
    tables, fourth = P.run(spark, folder, chain(calls), {"numbers": source})
    assert [r[2] for r in fourth] == ["made"] * 3 and tables["sum"].first()["total"] == 42
    with pytest.raises(ValueError):
        P.run(spark, folder, [P.Stage("a", None, ("missing",))])
    with pytest.raises(ValueError):
        P.run(spark, folder, [P.Stage("numbers", None)], {"numbers": source})


# Trees


def random_trees(n, dataset, seed):
    """Preorder rows (dataset, piece, node, depth, label) of n small trees."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(n):
        depth = 0
        for node in range(int(rng.integers(1, 6))):
            depth = 0 if node == 0 else int(rng.integers(1, depth + 2))
            rows.append((dataset, f"{dataset}{p:02d}", node, depth, "abc"[int(rng.integers(3))]))
    return rows


def distance(a, b):
    """Edit distance of two preorder lists of (depth, label), by its definition over forests."""

    def nested(rows):
        root, stack = [], [(-1, None)]
        stack = [(-1, root)]
        for d, label in rows:
            while stack[-1][0] >= d:
                stack.pop()
            node = (label, [])
            stack[-1][1].append(node)
            stack.append((d, node[1]))
        return freeze(root)

    def freeze(kids):
        return tuple((label, freeze(k)) for label, k in kids)

    def size(f):
        return sum(1 + size(k) for _, k in f)

    @cache
    def ted(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, fx), (y, gy) = f[-1], g[-1]
        return min(ted(f[:-1] + fx, g) + 1, ted(f, g[:-1] + gy) + 1, ted(f[:-1], g[:-1]) + ted(fx, gy) + (x != y))

    return ted(nested(a), nested(b))


def test_all_pairs_meet_in_bounded_blocks(spark):
    """Thirty trees of one dataset and four of another: each pair once, and no row holds more than its two blocks."""
    rows = random_trees(30, "d", 1) + random_trees(4, "e", 2)
    a = spark.createDataFrame(rows, "dataset string, piece string, node int, depth int, label string")
    trees = {}
    for dataset, piece, _, depth, label in rows:
        trees.setdefault((dataset, piece), []).append((depth, label))
    found = R.tree_pairs(a, block=4).collect()
    got = {(r["dataset"], r["piece_a"], r["piece_b"]): r["ted"] for r in found}
    want = {(d, p, q): distance(trees[d, p], trees[d, q]) for d, p in trees for e, q in trees if d == e and p < q}
    assert len(found) == len(got) == len(want) and got == want
    sizes = [r["n"] for r in R.pair_blocks(a, block=4).where("dataset = 'd'").select(F.size("trees").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) <= 20  # of 30 trees; blocks are dealt by a hash
    b = a.where("dataset = 'd' and piece < 'd07'")
    cross = R.tree_pairs(a, b, block=4).collect()
    got = {(r["piece_a"], r["piece_b"]): r["ted"] for r in cross}
    assert len(cross) == len(got) == 30 * 7 and all(v == distance(trees["d", p], trees["d", q]) for (p, q), v in got.items())


def test_bundles_by_definition(spark):
    rows = [("p", k, float(k), float(k + 1), RNG.random(12).tolist()) for k in range(6)]
    leaves = spark.createDataFrame(rows, "piece string, leaf int, start double, end double, vec array<double>")
    nodes = R.trees(leaves, "affinity")
    segs = spark.createDataFrame([("p", 0, 0.0, 2.0), ("p", 1, 2.0, 5.0), ("p", 2, 5.0, 6.0)], "piece string, seg int, start double, end double")
    got = R.edit_bundles(nodes, segs, spark.createDataFrame([("p", 6.0)], "piece string, total double"), 4, 3).first()
    label = lambda s, e: f"c{min(3, int((s + e) / 2 * 4 / 6))}w{min(2, int((e - s) * 3 / 6))}"
    tree = [(r["depth"], label(r["start"], r["end"]), r["split"] is None) for r in nodes.orderBy("node").collect()]
    ref = [(0, label(0, 6)), (1, label(0, 2)), (1, label(2, 5)), (1, label(5, 6))]
    size = {d: sum(x == d or (leaf and x < d) for x, _, leaf in tree) for d in range(6)}
    depth = min(size, key=lambda d: (abs(size[d] - 3), d))
    whole, short = [(d, x) for d, x, _ in tree], [(d, x) for d, x, _ in tree if d <= depth]
    raw, cut = distance(whole, ref), distance(short, ref)
    assert tuple(got) == ("p", raw, cut, raw / 11, cut / max(len(short), 4), raw / 15, cut / (len(short) + 4), 11, 4, len(short), size[depth], 3, depth, 4, 3)
    assert R.edit_bundles(nodes, segs.where("false"), spark.createDataFrame([("p", 6.0)], "piece string, total double")).count() == 0


# Examples and parts


def test_interval_pairs_and_balanced_samples(spark):
    vec = {(p, k): RNG.random(12) for p in "abc" for k in range(7)}
    leaves = spark.createDataFrame([(p, k, float(k), float(k + 1), v.tolist()) for (p, k), v in vec.items()], "piece string, leaf int, start double, end double, vec array<double>")
    marks = spark.createDataFrame([("a", 2.2), ("a", 2.4), ("b", 5.6)], "piece string, t double")
    rows = Y.interval_pairs(leaves, marks, (1, 3)).collect()
    assert {(r["piece"], r["split"], r["context"]) for r in rows} == {(p, s, c) for p in "abc" for c in (1, 3) for s in range(c, 8 - c)} and len(rows) == 3 * (6 + 2)
    for r in rows:
        p, s, c = r["piece"], r["split"], r["context"]
        assert r["left"] == pytest.approx(sum(vec[p, k] for k in range(s - c, s))) and r["right"] == pytest.approx(sum(vec[p, k] for k in range(s, s + c)))
        assert r["label"] == ((p, s) in {("a", 2), ("b", 6)})
    # Projected marks take distinct edges.
    assert {(r["piece"], r["split"]) for r in Y.interval_pairs(leaves, marks, (1,), "projected").where("label = 1").collect()} == {("a", 2), ("a", 3), ("b", 6)}
    works = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v")], "piece string, work string")
    some = Y.training_pairs(leaves, marks, works, (1, 3)).collect()
    assert {r["work"] for r in some} == {"u"} and sum(r["label"] for r in some) * 2 == len(some) == 4
    assert sorted(r["id"] for r in Y.training_pairs(leaves.repartition(5), marks, works, (1, 3)).collect()) == sorted(r["id"] for r in some)
    assert sum("Window" in line for line in Y.interval_pairs(leaves, marks)._jdf.queryExecution().executedPlan().toString().splitlines()) >= 1
    with pytest.raises(ValueError):
        Y.positive_splits(leaves, marks, "other")


def test_parts_of_works(spark):
    works = spark.createDataFrame([(f"w{k % 9}",) for k in range(30)], "work string")
    rows = {r["work"]: r["part"] for r in C.split_works(works, {"train": 5, "validation": 2, "test": 1}, 3).collect()}
    assert sorted(rows) == [f"w{k}" for k in range(9)]
    assert [list(rows.values()).count(p) for p in ("train", "validation", "test")] == [5, 2, 2]
    assert rows == {r["work"]: r["part"] for r in C.split_works(works.repartition(4), {"train": 5, "validation": 2, "test": 1}, 3).collect()}
    assert rows != {r["work"]: r["part"] for r in C.split_works(works, {"train": 5, "validation": 2, "test": 1}, 4).collect()}


def test_unreadable_numbers_are_null(spark):
    rows = spark.createDataFrame([("3/2",), ("0.5",), ("n/a",), ("1/0",), ("x",), (None,), ("4/",)], "t string")
    assert [r[0] for r in rows.select(S.fraction(F.col("t"))).collect()] == [1.5, 0.5, None, None, None, None, None]


def test_layers_of_forms():
    """A copy reads what stood before it, also where its ranges overlap, and keeps what a measure has."""
    text = "1,1,A,a\n2,1,B\n4,1,,d\n3-5=1-3,7,,c\n6=4,,\n5-4=9-8,1,x\n9=9,1,y\nRepeat: 3-12\n"
    rows = forms.form_events("p", text)
    got = {(m, level): (beat, label, how, source) for _, m, beat, level, label, how, source, _, issue in rows if not issue}
    assert got == {
        (1, 1): ("1", "A", "explicit", None), (1, 2): ("1", "a", "explicit", None), (2, 1): ("1", "B", "explicit", None), (4, 2): ("1", "d", "explicit", None),
        (3, 1): ("1", "A", "copy", 1), (3, 2): ("7", "c", "explicit", None), (4, 1): ("1", "B", "copy", 2), (6, 1): ("1", "B", "copy", 4), (6, 2): ("1", "d", "copy", 4),
    }
    assert [r[-1] for r in rows if r[-1]] == ["line 6: it copies from itself or later", "line 7: it copies from itself or later"] and {r[7] for r in rows} == {12}


def test_matches_need_no_packing_twice(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "piece string, t double")
    r = spark.createDataFrame([("a", 1.5), ("c", 2.0)], "piece string, t double")
    assert {(x["piece"], x["tp"], x["fp"], x["fn"]) for x in M.boundary_scores(p, r, 1.0).collect()} == {("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 0, 0, 1)}
