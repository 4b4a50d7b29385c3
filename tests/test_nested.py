"""Nested validation, pairs of trees, the trained diagonal, callers' distances and sinks, against plain loops."""

import numpy as np
import pytest

from ligature.operators import diagonal as D
from ligature.operators import nested as X
from ligature.operators import trees as R
from ligature.plans import registry
from ligature.sources import sinks


def test_inner_folds_cover_the_other_works_once(spark):
    works = spark.createDataFrame([(w,) for w in "abcdefg"] * 2, "work string")
    rows = X.inner_folds(works, 4, seed=3).collect()
    for outer in "abcdefg":
        mine = [(r["work"], r["fold"]) for r in rows if r["outer_work"] == outer]
        assert sorted(w for w, _ in mine) == sorted(set("abcdefg") - {outer})
        assert sorted(np.bincount([f for _, f in mine])) == [1, 1, 2, 2]
    assert sorted(rows) == sorted(X.inner_folds(works.repartition(3), 4, seed=3).collect())
    few = X.inner_folds(spark.createDataFrame([("a",), ("b",)], "work string"), 4).collect()
    assert [tuple(r) for r in sorted(few)] == [("a", "b", 0), ("b", "a", 0)]


def test_models_are_never_tried_on_their_own_works(spark):
    folds = X.inner_folds(spark.createDataFrame([(w,) for w in "abcde"], "work string"), 2)
    members, trials = (df.collect() for df in X.assignments(folds))
    seen = {(r["model"], r["work"]) for r in members}
    assert len(trials) == 5 * 4 + 5
    assert not any((r["model"], r["work"]) in seen for r in trials)
    for r in trials:
        fitted = {w for m, w in seen if m == r["model"]}
        assert r["outer_work"] not in fitted and (r["stage"] == "inner" or len(fitted) == 4)


def test_scorers_of_all_models_equal_those_fitted_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 2))
    data = [("abc"[k % 3], float(a), float(b), bool(a + 0.2 * rng.random() > 0.6)) for k, (a, b) in enumerate(x)]
    examples = spark.createDataFrame(data, "work string, u double, v double, positive boolean")
    both = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "model string, work string")
    fit = lambda m: {r["model"]: r for r in X.fit_scorers(examples, ["u", "v"], "positive", m, epochs=15).collect()}
    together, alone = fit(both), fit(both.where("model = 'm'"))
    assert np.allclose(together["m"]["weights"], alone["m"]["weights"], atol=1e-9) and abs(together["m"]["intercept"] - alone["m"]["intercept"]) < 1e-9
    assert together["m"]["weights"][0] > 0.6  # the first feature decides


def test_scorer_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, c = rng.random((9, 3)), (rng.random(9) > 0.5).astype(float), rng.random((9, 2))
    w = {"logits": rng.normal(size=(2, 3)), "raw_gain": rng.normal(size=2), "intercept": rng.normal(size=2)}
    _, g = X.scorer_gradient(x, y, c, w)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((X.scorer_gradient(x, y, c, up)[0] - X.scorer_gradient(x, y, c, down)[0]) / 2e-6, abs=1e-6)


def test_candidates_and_their_choice(spark):
    rows = [("inner", "o", "a", "p", 1, True, 0.9), ("inner", "o", "a", "p", 2, False, 0.5), ("inner", "o", "a", "p", 3, True, 0.5)]
    scored = spark.createDataFrame(rows, "stage string, outer_work string, work string, piece string, split int, positive boolean, score double")
    found = {(r["mode"], r["value"]): (r["tp"], r["fp"], r["fn"]) for r in X.candidate_counts(scored, [0.5, 0.6], [0.4, 0.7]).collect()}
    assert found == {("threshold", 0.5): (2, 1, 0), ("threshold", 0.6): (1, 0, 1), ("budget", 0.4): (1, 0, 1), ("budget", 0.7): (1, 1, 1)}
    score = lambda stage, mode, v, f: (stage, "o", "a" if stage == "inner" else "o", "p", mode, v, f, f, f)
    tied = [score(s, m, v, 0.5 if s == "inner" else v) for s in ("inner", "outer") for m in X.MODES for v in (0.2, 0.8)]
    rated = spark.createDataFrame(tied, "stage string, outer_work string, work string, piece string, mode string, value double, f1 double, recall double, precision double")
    assert {(r["mode"], r["value"], r["inner_f1"], r["f1"]) for r in X.nested_select(rated).collect()} == {("threshold", 0.8, 0.5, 0.8), ("budget", 0.2, 0.5, 0.2)}


def broadcasts(spark, make):
    """The columns of each table that the plan of make() broadcasts."""

    def upto(node):
        kids = [node.children().apply(k) for k in range(node.children().size())]
        own = [{node.output().apply(k).name() for k in range(node.output().size())}] if "BroadcastExchange" in node.nodeName() else []
        return own + [x for k in kids for x in upto(k)]

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return upto(make()._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_splits_are_not_broadcast(spark, tiny):
    found = broadcasts(spark, lambda: registry.split_examples(spark, tiny))
    assert found and not any({"split", "edge", "positive", "work"} & x for x in found)
    rows = spark.createDataFrame([("p", 1, "a", 0.2), ("p", 2, "a", 0.4)], "piece string, split int, work string, u double")
    trials = spark.createDataFrame([("m", "o", "a", "inner")], "model string, outer_work string, work string, stage string")
    models = spark.createDataFrame([("m", [1.0], 2.0, 0.5)], "model string, weights array<double>, gain double, intercept double")
    scored = lambda: X.scored_by(rows, ["u"], trials, models)
    found = broadcasts(spark, scored)
    assert found and not any("split" in x for x in found)
    assert {(r["split"], round(r["score"], 6)) for r in scored().collect()} == {(k, round(float(1 / (1 + np.exp(-(0.5 + 2 * (u - 0.5))))), 6)) for k, u in ((1, 0.2), (2, 0.4))}


def test_epochs_do_not_carry_the_steps_before_them(spark, tiny, monkeypatch):
    class Met(Exception):
        pass

    def fit(rows, *_, **__):
        raise Met(rows)

    monkeypatch.setattr(X, "fit_scorers", fit)
    for name in ("nested_validation", "nested_trees"):
        with pytest.raises(Met) as met:
            registry.queries()[name](spark, tiny)
        assert "InMemory" not in met.value.args[0]._jdf.queryExecution().executedPlan().toString()


def test_tests_before_the_freeze_are_found(spark):
    rows = [("x", 1, "load"), ("x", 2, "freeze"), ("x", 3, "test"), ("y", 1, "test"), ("y", 2, "freeze"), ("y", 3, "test"), ("z", 1, "test")]
    audit = spark.createDataFrame(rows, "run string, seq int, event string")
    assert sorted(tuple(r) for r in X.misused(audit, ["run"], ["seq"]).collect()) == [("x", 1, 0), ("y", 2, 1), ("z", 1, 1)]


def test_pairs_of_trees(spark):
    shapes = {"p": [(0, 0, "r"), (1, 1, "a"), (2, 1, "b")], "q": [(0, 0, "r"), (1, 1, "a"), (2, 1, "c")], "s": [(0, 0, "r")]}
    rows = [("d", p, *n) for p, nodes in shapes.items() for n in nodes] + [("e", "t", 0, 0, "r")]
    a = spark.createDataFrame(rows, "dataset string, piece string, node int, depth int, label string")
    assert {(r["piece_a"], r["piece_b"], r["ted"]) for r in R.tree_pairs(a).collect()} == {("p", "q", 1), ("p", "s", 2), ("q", "s", 2)}
    cross = R.tree_pairs(a, a.where("piece = 'q'")).collect()
    assert {(r["piece_a"], r["piece_b"], r["ted"]) for r in cross} == {("p", "q", 1), ("q", "q", 0), ("s", "q", 2)}
    assert R.tree_pairs(a.where("false")).count() == 0


def test_contrastive_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    left, right, label, at = rng.random((8, 12)), rng.random((8, 12)), np.arange(8.0) % 2, rng.normal(size=12)
    _, g = D.contrastive(left, right, label, 0.9, at)
    for k in range(12):
        step = np.eye(12)[k] * 1e-6
        slope = (D.contrastive(left, right, label, 0.9, at + step)[0] - D.contrastive(left, right, label, 0.9, at - step)[0]) / 2e-6
        assert g[k] == pytest.approx(slope, abs=1e-5)


def test_the_diagonal_learns_which_place_matters(spark):
    def vector(first, noise):
        v = np.full(12, 0.05)
        v[0], v[1 + noise % 11] = first, 0.5
        return [float(x) for x in v]

    rows = [(vector(0.1, k), vector(0.9 if k % 2 else 0.1, k + 4), k % 2) for k in range(44)]
    examples = spark.createDataFrame(rows, "left array<double>, right array<double>, label int")
    weights, margin, history = D.train_diagonal(examples, epochs=30)
    assert weights.sum() == pytest.approx(1) and weights.argmax() == 0 and margin > 0
    assert history[-1][1] < history[0][1]
    scores = iter([0.5, 0.7, 0.7])
    _, _, seen = D.train_diagonal(examples, epochs=5, every=2, validate=lambda w: next(scores))
    assert [s for _, _, s in seen] == [None, 0.5, None, 0.7, 0.7]
    assert D.train_diagonal(examples.where("false"), epochs=2)[0].tolist() == pytest.approx([1 / 12] * 12)


def leaf_rows(spark):
    rng = np.random.default_rng(9)
    rows = [("p", k, float(k), float(k + 1), [float(x) for x in rng.random(12)]) for k in range(6)]
    return spark.createDataFrame(rows, "piece string, leaf int, start double, end double, vec array<double>")


def test_a_callers_distance(spark):
    leaves = leaf_rows(spark)
    same = lambda v: R.unit(v)
    euclid = R.Metric(lambda a, b: float(np.linalg.norm(a / a.sum() - b / b.sum())))
    for method, own in (("affinity", same), ("affinity", euclid), ("greedy", same), ("linkage", euclid), ("boundary", euclid)):
        got, want = (R.trees(leaves, method, d).select("node", "first", "last", "split").orderBy("node").collect() for d in (own, "euclidean"))
        assert got == want
    assert R.trees(leaves, "greedy", euclid).first()["status"] == "failed: this method needs a transform instead of a metric"
    assert R.trees(leaves, "linkage", R.Metric(lambda a, b: -1.0)).first()["status"].startswith("failed: a metric")


def test_flat_trees(spark):
    seg = spark.createDataFrame([("p", 0, 0.0, 2.0, "I"), ("p", 1, 2.0, 5.0, "V")], "piece string, seg int, start double, end double, label string")
    rows = [tuple(r) for r in R.flat_tree(seg).orderBy("node").collect()]
    assert rows == [("p", 0, None, 0, 0, 1, 0.0, 5.0, "ROOT"), ("p", 1, 0, 1, 0, 0, 0.0, 2.0, "I"), ("p", 2, 0, 1, 1, 1, 2.0, 5.0, "V")]


def test_sinks_read_back(spark, tmp_path):
    weights = {"w": np.arange(6.0).reshape(2, 3), "b": np.asarray(0.5)}
    sinks.write_weights(spark, weights, f"file://{tmp_path}/w", seed=3, phase="done")
    got, facts = sinks.read_weights(spark, f"file://{tmp_path}/w")
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in weights.items()} and facts == {"seed": "3", "phase": "done"}
    table = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for form in sinks.FORMS:
        sinks.write_table(table, f"file://{tmp_path}/{form}", form)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == spark.read.json(f"file://{tmp_path}/json").count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(table, f"file://{tmp_path}/x", "xml")
    runs = spark.createDataFrame([("a", 2, 0.9, True, False), ("b", 1, 0.9, True, False), ("c", 0, 0.99, False, False), ("d", 0, 0.99, True, True)], "folder string, seed int, ap double, complete boolean, quick boolean")
    assert [tuple(r) for r in sinks.best_checkpoint(runs).collect()] == [("b", 1, 0.9)]
