"""Gradients against finite differences, and losses that fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.functions import encoders as E
from ligature.functions import gradients as G
from ligature.operators import learned as L
from ligature.operators import training as T
from ligature.plans import registry

RNG = np.random.default_rng(0)


def check(loss, grad, w, keys, step=1e-6):
    for k in keys:
        for at in list(np.ndindex(np.shape(w[k])))[:: max(1, np.size(w[k]) // 5)]:
            up, down = ({x: np.array(y, float) for x, y in w.items()} for _ in range(2))
            up[k][at] += step
            down[k][at] -= step
            assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / (2 * step), rel=1e-3, abs=1e-6), (k, at)


def test_pair_gradient():
    left, right, y, s = RNG.random((6, 12)), RNG.random((6, 12)), np.array([0, 1, 0, 1, 1, 0.0]), RNG.random(6)
    w = E.harmonic_weights(3) | {"raw_scale": np.asarray(0.3), "bias": np.asarray(-0.2)}
    _, g = G.pair_loss(left, right, y, s, w)
    check(lambda v: G.pair_loss(left, right, y, s, v)[0], g, w, w)
    assert {k: np.shape(v) for k, v in G.shaped(G.flat(w), w).items()} == {k: np.shape(v) for k, v in w.items()}


def test_policy_gradients():
    v, enc, pol = RNG.random((6, 12)), E.harmonic_weights(1), E.policy_weights(2)
    _, g = T.imitation(v, {3}, enc, pol)
    check(lambda w: T.imitation(v, {3}, enc, w)[0], g, pol, pol)


def test_encoders_are_invariant():
    a, b, w = RNG.random((5, 12)), RNG.random((5, 12)), E.harmonic_weights(1)
    d = lambda x, y: np.linalg.norm(E.harmonic(x, w) - E.harmonic(y, w), axis=1)
    assert d(a, b) == pytest.approx(d(np.roll(a, 5, 1), np.roll(b, 5, 1)))
    f = lambda x, y: E.pair_features(E.harmonic(x, w), E.harmonic(y, w))
    assert f(a, b) == pytest.approx(f(np.roll(a, 3, 1), np.roll(b, 3, 1))) and f(a, b).shape == (5, 40)
    assert np.linalg.norm(E.plain(a, E.plain_weights(0)), axis=1) == pytest.approx(np.ones(5))


def test_training_on_spark(spark):
    rows = []
    for k in range(60):
        x = RNG.random(12)
        y = x + 0.01 * RNG.random(12) if k % 2 else RNG.random(12) ** 3
        rows.append((k, x.tolist(), y.tolist(), float(k % 2 == 0), 1.0))
    examples = spark.createDataFrame(rows, "id int, left array<double>, right array<double>, label double, weight double").repartition(3)
    _, losses = T.train_metric(examples, epochs=12)
    assert losses[-1] < losses[0]
    leaves = spark.createDataFrame([(f"p{p}", [(i, float(i), float(i + 1), RNG.random(12).tolist()) for i in range(6)], [3]) for p in range(6)], "piece string, leaves array<struct<leaf:int,start:double,end:double,vec:array<double>>>, marks array<int>")
    enc = E.harmonic_weights(1)
    policy, losses = T.train_policy(leaves, enc, epochs=8, rate=1e-2)
    assert losses[-1] < losses[0]
    better, _ = T.train_policy(leaves, enc, epochs=2, start=policy)
    assert any((better[k] != policy[k]).any() for k in policy)


def test_scorer_learns(spark):
    rows = [(k, k % 10 / 10, RNG.random(), k % 10 >= 6) for k in range(300)]
    data = spark.createDataFrame(rows, "id int, a double, b double, y boolean")
    model = L.fit_scorer(data, ["a", "b"], "y", ["id"])
    assert model["weights"][0] > 0.9 and model["weights"].sum() == pytest.approx(1)
    got = L.scored(data, ["a", "b"], model).groupBy("y").agg(F.avg("score").alias("s"))
    means = {r["y"]: r["s"] for r in got.collect()}
    assert means[True] > means[False]


def test_joint_gradients_reach_the_encoder():
    """The sampled episode's gradient in both networks equals finite differences of its loss with the merges held."""
    v, edges = RNG.random((6, 12)), np.arange(7.0)
    enc, pol = E.harmonic_weights(4), E.policy_weights(5)

    def held(e, p, merges, gain, entropy):
        clusters, loss = [(i, i + 1) for i in range(6)], 0.0
        for at in merges:
            q = T.softmax(E.policy(E.candidates(v, clusters, e), p))
            loss += -gain * np.log(q[at]) + entropy / len(merges) * (q * np.log(q)).sum()
            clusters[at : at + 2] = [(clusters[at][0], clusters[at + 1][1])]
        return loss

    for seed in range(30):
        reward, base, loss, g, deep = T.episode(v, edges, {2, 4}, enc, pol, np.random.default_rng(seed), 0.05, joint=True)
        if abs(reward - base) > 0.01:
            break
    rng, clusters, merges = np.random.default_rng(seed), [(i, i + 1) for i in range(6)], []
    while len(clusters) > 1:
        q = T.softmax(E.policy(E.candidates(v, clusters, enc), pol))
        merges.append(int(rng.choice(len(q), p=q)))
        clusters[merges[-1] : merges[-1] + 2] = [(clusters[merges[-1]][0], clusters[merges[-1] + 1][1])]
    assert held(enc, pol, merges, reward - base, 0.05) == pytest.approx(loss)
    check(lambda w: held(enc, w, merges, reward - base, 0.05), g, pol, pol)
    check(lambda w: held(w, pol, merges, reward - base, 0.05), deep, enc, enc)
    assert T.episode(v, edges, {2}, enc, pol, np.random.default_rng(0), 0.05, joint=False)[4] == {}


def test_pair_feature_gradients():
    a, b, out = RNG.random((4, 16)), RNG.random((4, 16)), RNG.random((4, 40))
    d_a, d_b = G.pair_features_back(a, b, out)
    check(lambda w: (out * E.pair_features(w["a"], w["b"])).sum(), {"a": d_a, "b": d_b}, {"a": a, "b": b}, "ab")


def piece_rows(spark, seed, works=3):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(2 * works):
        first, second = rng.random(12) ** 6, rng.random(12) ** 6
        vec = [((first if i < 3 else second) + 0.02 * rng.random(12)).tolist() for i in range(6)]
        rows.append((f"w{p % works}", f"p{p}", [(i, float(i), float(i + 1), vec[i]) for i in range(6)], [3]))
    return spark.createDataFrame(rows, "work string, piece string, leaves array<struct<leaf:int,start:double,end:double,vec:array<double>>>, marks array<int>")


def test_joint_training_keeps_the_best_weights(spark):
    train, held = piece_rows(spark, 1), piece_rows(spark, 2)
    enc, pol = E.harmonic_weights(1), E.policy_weights(2)
    frozen, only, history = T.train_jointly(train, held, enc, pol, joint=False, epochs=6, every=2, patience=100, rate=1e-2)
    assert all((frozen[k] == enc[k]).all() for k in enc) and any((only[k] != pol[k]).any() for k in pol)
    assert [h["validation"] is not None for h in history] == [False, True] * 3
    both, policy, history = T.train_jointly(train, held, enc, pol, joint=True, epochs=6, every=1, patience=100, rate=1e-2, encoder_rate=1e-2)
    best = max(h["validation"] for h in history)
    assert T.policy_score(held, both, policy) == pytest.approx(best) and any((both[k] != enc[k]).any() for k in enc)
    again = T.train_jointly(train.repartition(5), held, enc, pol, joint=True, epochs=6, every=1, patience=100, rate=1e-2, encoder_rate=1e-2)
    assert [h["loss"] for h in again[2]] == pytest.approx([h["loss"] for h in history], abs=1e-6)
    _, _, short = T.train_jointly(train, held.where("false"), enc, pol, epochs=20, every=1, patience=3)
    assert len(short) == 4  # the first score is kept, and three more are not better
    assert T.train_jointly(train.where("false"), held, enc, pol, epochs=3)[2] == []


def test_metric_training_in_batches_stops_early(spark):
    """Labels of the training pairs are noise that can only be learned by heart, so the held-out score doesn't last."""
    rng = np.random.default_rng(8)

    def rows(n, start, honest):
        out = []
        for k in range(n):
            x = rng.random(12)
            label = k % 2
            y = (rng.random(12) ** 4 if label else x + 0.01 * rng.random(12)) if honest else rng.random(12)
            out.append((start + k, f"w{k % 3}", x.tolist(), y.tolist(), float(label)))
        return spark.createDataFrame(out, "id int, work string, left array<double>, right array<double>, label double")

    noise, good, held = rows(24, 0, False).cache(), rows(60, 100, True).cache(), rows(30, 200, True).cache()
    w, history = T.fit_metric(good, held, epochs=4, steps=3, rate=1e-2, patience=5)
    scores = [s for _, _, s in history]
    assert len(history) == 4 and T.metric_validation(held, w) == pytest.approx(max(scores)) and max(scores) > 0.9
    _, other = T.fit_metric(good.repartition(5), held, epochs=4, steps=3, rate=1e-2, patience=5)
    assert [x for _, x, _ in other] == pytest.approx([x for _, x, _ in history], abs=1e-6)
    w, history = T.fit_metric(noise, held, epochs=30, steps=2, rate=3e-2, patience=2)
    scores = [s for _, _, s in history]
    assert len(history) < 30 and scores.index(max(scores)) == len(scores) - 3
    assert T.metric_validation(held, w) == pytest.approx(max(scores))
    means = {r["work"]: r["m"] for r in T.work_weights(good).groupBy("work").agg(F.sum("weight").alias("m")).collect()}
    assert list(means.values()) == pytest.approx([20.0] * 3)


def test_policy_training_shows_what_was_learnt(spark, tiny, monkeypatch):
    """Its rows change with each of its stages, in all but the sizes of the trees."""
    train, rows = T.train_policy, {}
    for imitated, reinforced in ((2, 1), (0, 1), (2, 0), (0, 0)):
        with monkeypatch.context() as m:
            m.setattr(T, "train_policy", lambda pieces, encoder, a=imitated, b=reinforced, **o: train(pieces, encoder, **o | {"epochs": b if "start" in o else a}))
            rows[imitated, reinforced] = {r["piece"]: r.asDict() for r in registry.queries()["policy_training"](spark, tiny).collect()}
    whole = rows.pop((2, 1))
    assert all(r["nodes"] == 2 * r["leaves"] - 1 and (r["leaves"] == 1 or 0 < r["split"] < r["leaves"]) for r in whole.values())
    for other in rows.values():
        assert {p: r["leaves"] for p, r in other.items()} == {p: r["leaves"] for p, r in whole.items()}
        assert other != whole
    assert any(r["split"] != rows[0, 0][p]["split"] for p, r in whole.items())


def test_metric_in_batches_trains_until_patience_ends(spark, tiny, monkeypatch):
    """Training goes on until twenty epochs bring no better score, or to its last epoch, and its weights are those of the best."""
    fit, met = T.fit_metric, {}

    def told(examples, validation, **options):
        met["weights"], met["history"] = fit(examples, validation, **options)
        met["score"] = T.metric_validation(validation, met["weights"])
        return met["weights"], met["history"]

    monkeypatch.setattr(T, "fit_metric", told)
    assert registry.queries()["metric_in_batches"](spark, tiny).count() > 0
    scores = [score for _, _, score in met["history"]]
    assert len(scores) == 150 or len(scores) > 20 and max(scores[-20:]) <= max(scores[:-20]) + 1e-8
    assert met["score"] == pytest.approx(max(scores))


def test_steps_do_not_carry_the_plan_before_them(spark):
    rows = spark.range(2500).select(F.col("id").cast("string"), (F.col("id") % 3).alias("work")).groupBy("id").agg(F.max("work").alias("work"))
    kept = T.kept_once(rows)
    assert kept.rdd.getNumPartitions() == 3 and "Aggregate" not in kept.where("work = 1")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["work"] for r in kept.collect()) == sorted(r["work"] for r in rows.collect())
    kept.unpersist()
