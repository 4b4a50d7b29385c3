"""What must not grow with the tables: the rows of a task, the trees built, the pairs compared."""

import numpy as np
from pyspark.sql import functions as F

from ligature.functions import encoders as E
from ligature.functions import gradients as D
from ligature.llm import secret_scan
from ligature.operators import affinity as A
from ligature.operators import binning as B
from ligature.operators import dealing, views
from ligature.operators import grids as H
from ligature.operators import kernels as K
from ligature.operators import matching as M
from ligature.operators import training as G
from ligature.operators import trees as R
from ligature.plans import registry


def test_tasks_grow_with_the_events(spark, tiny, monkeypatch):
    """Notes, leaves and pairs stay in as many partitions as the events ask for, a piece in one of them."""
    n = spark.read.parquet(f"{tiny}/events.parquet").count()
    for most in (100, 40):
        monkeypatch.setattr(dealing, "ROWS_A_TASK", most)
        tasks = -(-n // most)
        for rows in (views.notes(spark, tiny), registry.leaves(spark, tiny), A.affinity(registry.pairs(spark, tiny)), B.pick_resolution(views.notes(spark, tiny), [24.0], 14, collapsed=True)):
            at = rows.select("piece", F.spark_partition_id().alias("at"))
            assert rows.rdd.getNumPartitions() == tasks
            assert at.groupBy("piece").agg(F.countDistinct("at").alias("n")).where("n > 1").count() == 0


def test_equal_trees_are_compared_once(spark, monkeypatch):
    """Classes and their counts give what all pairs of trees give, with the distances of few pairs."""
    forms = [[(0, 0, "r"), (1, 1, "a"), (2, 1, "b")], [(0, 0, "r"), (1, 1, "a"), (2, 2, "b")], [(0, 0, "r"), (1, 1, "c")]]
    rows = [(f"w{k % 2}", f"p{k}", *x) for k in range(24) for x in forms[(k // 2) % 3]]
    one = spark.createDataFrame(rows, "dataset string, piece string, node int, depth int, label string")
    two = one.where("dataset = 'w1'").withColumn("dataset", F.lit("w0"))
    mean = lambda df, n: {tuple(r) for r in df.groupBy("dataset").agg(F.sum(n).cast("long"), F.sum(F.col("ted") * n).cast("long"), F.round(F.sum(F.col("by_sum") * n), 9), F.round(F.sum(F.col("by_max") * n), 9)).collect()}
    classes = R.tree_classes(one)
    assert classes.select("form").distinct().count() == 3
    after = classes.where("dataset = 'w1'").withColumn("dataset", F.lit("w0"))
    for pairs, all_ in ((R.class_pairs(classes), R.tree_pairs(one)), (R.class_pairs(classes, after), R.tree_pairs(one, two))):
        found = R.class_distances(pairs, classes)
        assert found.count() <= 12 < all_.count()
        assert mean(found, F.col("pairs")) == mean(all_, F.lit(1))


def test_edit_distance_of_a_million_cells():
    """Two chains of a thousand nodes."""
    chain = lambda k: R.postorder([(d, 0, str(d % k)) for d in range(1000)])
    assert K.edit_distance(chain(1), chain(1)) == 0
    assert K.edit_distance(chain(1), chain(2)) == 500


def test_sums_of_trials_leave_a_task_by_work(spark):
    """trial_sums gives the rates of trial_counts, in rows that don't grow with the pieces."""
    rng = np.random.default_rng(5)
    pieces = [(f"p{k}", f"w{k % 2}", 2 + k % 5) for k in range(12)]
    leaves = spark.createDataFrame([(p, i, float(i), i + 1.0, rng.uniform(0, 1, 12).tolist()) for p, _, n in pieces for i in range(n)], "piece string, leaf int, start double, end double, vec array<double>")
    marks = spark.createDataFrame([(p, float(t)) for p, _, n in pieces for t in rng.uniform(0, n, 2)], "piece string, t double")
    found = [(p, w, k, *rng.uniform(0, 1, 2).tolist()) for p, w, n in pieces for k in range(1, n)]
    rows = spark.createDataFrame(found, "piece string, work string, split int, w1 double, w2 double")
    trials = [dict(stage=s, outer_work=o, work=w, weights=[0.3, 0.7], gain=g, intercept=0.1) for s, o, w, g in (("inner", "w1", "w0", 2.0), ("outer", "w0", "w0", 1.0), ("inner", "w0", "w1", 0.5), ("outer", "w1", "w1", 3.0))]
    grid = [(w, b) for w in (0.0, 0.5) for b in (0.0, 0.1)]
    scores = []
    for p, w, k, x, y in found:
        for t in (t for t in trials if t["work"] == w):
            logistic = 1 / (1 + np.exp(-(t["intercept"] + t["gain"] * (0.3 * x + 0.7 * y - 0.5))))
            scores += [(kind, t["stage"], t["outer_work"], w, p, k, float(v)) for kind, v in zip(H.KINDS, (1.0, (x + y) / 2, logistic), strict=True)]
    contrasts = spark.createDataFrame(scores, "kind string, stage string, outer_work string, work string, piece string, split int, score double")
    args = grid, [0.1, 0.3], [0.25, 0.5], 0.6
    keys = ["kind", "stage", "outer_work", "work", "search", "weight", "balance", "mode", "value"]
    one = M.with_rates(H.trial_counts(leaves, marks, contrasts, *args)).groupBy(*keys).agg(F.count("*"), *(F.round(F.sum(c), 9) for c in ("f1", "recall", "precision")))
    two = H.trial_sums(leaves, marks, rows, ["w1", "w2"], trials, *args).groupBy(*keys).agg(F.sum("pieces"), *(F.round(F.sum(c), 9) for c in ("f1", "recall", "precision")))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_secret_models_count_all_texts(spark):
    """Ordinary words come from every different text, however many there are."""
    docs = spark.range(6000).select(F.concat(F.lit("plainword "), F.lit("unique"), F.translate(F.col("id").cast("string"), "0123456789", "ghijklmnop")).alias("text"))
    words = secret_scan.samples(docs.unionByName(docs)).where("not random")
    assert words.where("s = 'plainword'").first()["n"] == 6000
    assert words.count() == 6001


def random_pieces(spark, seed, sizes):
    """(leaves with work and size, marks) of pieces of so many leaves."""
    rng = np.random.default_rng(seed)
    leaves = [(f"p{k}", f"w{k % 2}", 1.0, i, float(i), i + 1.0, rng.uniform(0, 1, 12).tolist()) for k, n in enumerate(sizes) for i in range(n)]
    marks = [(f"p{k}", float(t)) for k, n in enumerate(sizes) if k % 4 for t in rng.uniform(0, n, 2)]
    return spark.createDataFrame(leaves, "piece string, work string, size double, leaf int, start double, end double, vec array<double>"), spark.createDataFrame(marks, "piece string, t double")


def test_pieces_are_dealt_by_the_rows_read(spark, tiny, monkeypatch):
    """Packed pieces go to more tasks as the table grows, whatever lies in between."""
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 40)
    n = spark.read.parquet(f"{tiny}/events.parquet").count()
    assert dealing.dealt(registry.leaves(spark, tiny), "piece").rdd.getNumPartitions() == -(-n // 40)
    assert dealing.rows_read(spark.range(3).toDF("piece")) == 0


def test_sums_of_configurations_leave_a_task_by_work(spark):
    """configuration_sums gives the rates of configurations, in rows that don't grow with the pieces."""
    leaves, marks = random_pieces(spark, 6, [1 + k % 6 for k in range(18)])
    args = ["euclidean", "circle_of_fifths"], [1, 2], [1, 3], [0.4, 1.0], 2
    keys = ["work", "size", "method", "kind", "budget", "tolerance"]
    one = M.with_rates(H.configurations(leaves.drop("work"), marks, *args)).withColumn("budget", F.when(F.col("kind") != "oracle", F.col("budget")))
    one = one.join(leaves.select("piece", "work").distinct(), "piece").groupBy("piece", *keys).agg(*(F.avg(c).alias(c) for c in ("f1", "recall", "precision")))
    sums = lambda df: {tuple(r) for r in df.groupBy(*keys).agg(*(F.round(F.sum(c), 9) for c in ("f1", "recall", "precision"))).collect()}
    two = H.configuration_sums(leaves, marks, *args)
    assert sums(one) == sums(two)
    assert two.where("work = 'w0'").groupBy(*keys).agg(F.sum("pieces").alias("n")).where("n <> 9").count() == 0


def test_pieces_of_one_length_merge_together():
    """Trees and matches of many pieces equal those of each."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(0, 1, (20, 7, 12))
    vectors[3, 2:5] = vectors[3, 2]
    nodes = K.greedy_distances(vectors, R.unit)
    assert [[tuple(x) for x in p] for p in nodes.tolist()] == [K.greedy_distance(v, R.unit) for v in vectors]
    times, marks = np.sort(rng.integers(0, 9, (20, 6)), axis=1).astype(float), np.sort(rng.uniform(0, 9, (20, 4)), axis=1)
    marks[5, 2:] = np.inf
    chosen = rng.uniform(size=(20, 5, 6)) < 0.5
    for tolerance in (0.2, 1.5):
        got = H.match_counts(times, chosen, marks, tolerance)
        for p in range(20):
            for c in range(5):
                assert tuple(got[p, c]) == H.matches(sorted(set(times[p][chosen[p, c]].tolist())), [m for m in marks[p].tolist() if np.isfinite(m)], tolerance)


def test_episodes_of_one_length_run_together():
    """Merges, losses and gradients of many pieces are those of each, also for pieces of one leaf."""
    rng = np.random.default_rng(8)
    enc, pol = E.harmonic_weights(1), E.policy_weights(2)
    for n in (1, 2, 6):
        vectors, edges = rng.uniform(0, 1, (9, n, 12)), np.sort(rng.uniform(0, 9, (9, n + 1)), axis=1)
        marks = rng.uniform(size=(9, n + 1)) < 0.4
        marks[:, 0] = marks[:, n] = False
        sets = [set(np.flatnonzero(m).tolist()) for m in marks]
        nodes, logp = E.rollouts(vectors, enc, pol)
        each = [E.rollout(v, enc, pol) for v in vectors]
        assert [[tuple(x) for x in p] for p in nodes.tolist()] == [x for x, _ in each]
        assert np.allclose(logp, [x for _, x in each])
        assert np.allclose(G.average_precisions(nodes, edges, marks), [G.average_precision(x, e, m) for (x, _), e, m in zip(each, edges, sets, strict=True)])
        one = [G.imitation(v, m, enc, pol) for v, m in zip(vectors, sets, strict=True)]
        two = [G.reinforce(v, e, m, enc, pol, np.random.default_rng(k), 0.01)[1:] for k, (v, e, m) in enumerate(zip(vectors, edges, sets, strict=True))]
        chance = np.stack([np.random.default_rng(k).random(n - 1) for k in range(9)])
        for plain, (loss, g) in ((one, G.imitations(vectors, marks, enc, pol)), (two, G.reinforcements(vectors, edges, marks, enc, pol, chance, 0.01))):
            assert np.isclose(loss, sum(x for x, _ in plain))
            assert np.allclose(g, sum(D.flat(x) for _, x in plain))


def test_layers_are_products_of_matrices():
    """A layer gives what its sum over channels and taps gives."""
    rng = np.random.default_rng(9)
    x, w, b = rng.normal(size=(4, 3, 12)), rng.normal(size=(5, 3, 3)), rng.normal(size=5)
    for dilation in E.DILATIONS:
        want = np.zeros((4, 5, 12)) + b[None, :, None]
        for at in range(12):
            for k in range(3):
                want[:, :, at] += x[:, :, (at + (k - 1) * dilation) % 12] @ w[:, :, k].T
        assert np.allclose(E.circular(x, w, b, dilation), want)


def test_contrasts_need_only_near_leaves(spark, tiny):
    """Windows give what all pairs of leaves give."""
    reps = A.represented(registry.leaves(spark, tiny), "euclidean")
    for k in (1, 2, 3):
        one, two = (df.select("piece", "split", F.round("contrast", 9)).collect() for df in (A.contrasts(A.distances(reps), registry.leaves(spark, tiny), k), A.local_contrasts(reps, k)))
        assert one and set(one) == set(two)
