"""DataFrame operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from ligature.functions import scalars as S
from ligature.functions import vectors as V
from ligature.operators import affinity as A
from ligature.operators import binning as B
from ligature.operators import joins as J
from ligature.operators import matching as M
from ligature.operators import selection as C
from ligature.operators import statistics as T
from ligature.operators import trees as R
from ligature.sources import tables
from ligature.streaming.bins import streamed_bins


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_a_note_is_split_over_bins(spark):
    notes = spark.createDataFrame([("p", 1.0, 4.0, 60)], "piece string, onset double, dur double, midi int")
    assert rows(B.histogram(notes, 2.0), "bin") == [("p", 0, 0, 1.0), ("p", 1, 0, 2.0), ("p", 2, 0, 1.0)]
    assert rows(B.bounds(notes, 2.0), "bin") == [("p", 0, 0.0, 2.0), ("p", 1, 2.0, 4.0), ("p", 2, 4.0, 5.0)]
    with pytest.raises(ValueError):
        B.histogram(notes, 0)


def test_silence_goes_to_the_nearer_bin(spark):
    notes = spark.createDataFrame([("p", 0.0, 2.0, 60), ("p", 6.0, 2.0, 64)], "piece string, onset double, dur double, midi int")
    assert [r[1:4] for r in rows(B.leaves(notes, 2.0).select("piece", "leaf", "start", "end"), "leaf")] == [(0, 0.0, 4.0), (1, 4.0, 8.0)]


def test_sweep_counts_overlaps(spark):
    notes = spark.createDataFrame([("p", 0.0, 2.0, 60), ("p", 1.0, 2.0, 72), ("p", 1.5, 0.0, 61)], "piece string, onset double, dur double, midi int")
    assert rows(B.sweep(notes), "start") == [("p", 0.0, 1.0, 0, 1), ("p", 1.0, 2.0, 0, 2), ("p", 2.0, 3.0, 0, 1)]


def test_islands_end_where_the_next_starts(spark):
    data = spark.createDataFrame([("p", 0, 2.0, "I"), ("p", 1, 3.0, "I"), ("p", 2, 5.0, "V"), ("p", 3, 5.0, "I")], "piece string, row int, onset double, key string")
    out = B.islands(data, "key", ["onset", "row"], "onset", F.max(F.col("onset") + 1))
    assert rows(out, "seg") == [("p", 0, 2.0, 5.0, "I"), ("p", 1, 5.0, 5.0, "V"), ("p", 2, 5.0, 6.0, "I")]


def test_zero_vectors(spark):
    v = F.array(*(F.lit(0.0) for _ in range(12)))
    one = spark.range(1).select(V.l1_or_uniform(v).alias("u"), V.l1_or_zero(v).alias("z"), V.correlation(v, v).alias("c"), V.global_key(V.constant(V.rolled(V.MINOR, 9))).alias("k")).first()
    assert one["u"] == [1 / 12] * 12 and one["z"] == [0.0] * 12 and one["c"] == 0
    assert (one["k"]["tonic"], one["k"]["major"]) == (9, False) and one["k"]["correlation"] == pytest.approx(1)


def test_distances_are_invariant_where_they_should_be(spark):
    v = spark.createDataFrame([([float((7 * i) % 5) for i in range(12)], [float((3 * i) % 7) for i in range(12)])], "a array<double>, b array<double>")
    for name in ("euclidean", "circle_of_fifths", "key_profile"):
        d = lambda s, n=name: V.distance(n, V.transposed(F.col("a"), F.lit(s)), V.transposed(F.col("b"), F.lit(s)))
        x, y = v.select(d(0), d(5)).first()
        assert x == pytest.approx(y) and x > 0


def test_scalars(spark):
    one = spark.createDataFrame([("3/4", "a_b_c")], "f string, p string").select(S.fraction(F.col("f")), S.work_of(F.col("p")), S.label_bucket(F.lit(5.0), F.lit(4.0), F.lit(10.0), 10, 10), S.ratio(F.lit(1.0), F.lit(0.0)), V.span_weight(F.lit(1), F.lit(8))).first()
    assert tuple(one) == (0.75, "a_b", "c5w4", 0.0, 0.0)


def test_nearest_edges_collapse(spark):
    marks = spark.createDataFrame([("p", 1.4), ("p", 1.49), ("p", 4.1)], "piece string, t double")
    edges = spark.createDataFrame([("p", float(t)) for t in range(1, 5)], "piece string, t double")
    assert rows(A.nearest_edges(marks, edges), "edge") == [("p", 1.0), ("p", 4.0)]


def leaves(spark, n, piece="p"):
    return spark.createDataFrame([(piece, i, float(i), float(i + 1), [float((i * k + k) % 5) + 0.1 for k in range(12)]) for i in range(n)], "piece string, leaf int, start double, end double, vec array<double>")


def test_node_tables(spark):
    tree = R.trees(leaves(spark, 8), "balanced").cache()
    assert rows(R.counts(tree), "piece") == [("p", 15, 8)]
    assert R.pruned(tree, 1).where("split is null").count() == 2
    assert R.invalid(tree).count() == 0
    assert rows(R.top_splits(tree, 1), "t") == [("p", 4.0)]
    s = R.shape(tree).first()
    assert (s["leaves"], s["max_depth"], s["sackin"], s["colless"], s["root_ratio"], s["singleton_share"]) == (8, 3, 24, 0, 1.0, 8 / 14)
    for method in R.METHODS:
        assert R.counts(R.trees(leaves(spark, 5), method)).first()["leaves"] == 5
    assert R.trees(leaves(spark, 5), "greedy", most=4).first()["status"].startswith("skipped: 5 bins exceeds")
    assert "failed" in R.trees(leaves(spark, 3).withColumn("vec", F.transform("vec", lambda x: -x)), "additive").first()["status"]


def test_revenue_of_the_program_is_its_objective(spark):
    some = leaves(spark, 7)
    tree = R.trees(some, "affinity", "euclidean")
    aff = A.affinity(A.distances(A.represented(some, "euclidean")))
    assert R.revenue(tree, aff).first()["revenue"] == pytest.approx(tree.where("parent is null").first()["objective"])


def test_matching_counts(spark):
    t = lambda xs: spark.createDataFrame([("p", float(x)) for x in xs], "piece string, t double")
    s = M.boundary_scores(t([9, 11, 11]), t([10]), 2.0).first()
    assert (s["tp"], s["fp"], s["fn"], s["error"]) == (1, 1, 0, 1.0)
    s = M.boundary_scores(t([9]), t([50, 50]), 2.0).first()
    assert (s["tp"], s["fp"], s["fn"], s["f1"]) == (0, 1, 2, 0.0)


def test_union_iou(spark):
    iv = lambda xs: spark.createDataFrame([("p", float(a), float(b)) for a, b in xs], "piece string, start double, end double")
    assert M.union_iou(iv([(0, 2), (1, 3)]), iv([(2, 4)])).first()["iou"] == pytest.approx(1 / 4)


def test_average_precision(spark):
    data = spark.createDataFrame([("p", 3.0, True, 0), ("p", 2.0, False, 1), ("p", 1.0, True, 2), ("q", 1.0, False, 0)], "piece string, score double, positive boolean, at int")
    assert rows(M.average_precision(data, "piece"), "piece") == [("p", pytest.approx((1 + 2 / 3) / 2)), ("q", 0.0)]


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double").withColumn("g", F.lit(1))
    assert [r["adjusted"] for r in T.holm(p, "g").orderBy("name").collect()] == [pytest.approx(x) for x in (0.03, 0.06, 0.06)]
    data = spark.createDataFrame([(f"w{i}", m, x) for i in range(6) for m, x in (("a", 0.5 + i / 10), ("b", 0.1 + i / 10))], "work string, m string, x double")
    one = T.sign_flips(data, "work", "m", "x").first()
    assert (one["n"], one["difference"]) == (6, pytest.approx(0.4)) and one["p"] == pytest.approx(2 / 64)
    b = T.bootstrap(data, "m", "x", 500).orderBy("m").first()
    assert b["low"] < b["mean"] < b["high"] and b["n"] == 6
    same = T.bootstrap(data.repartition(7), "m", "x", 500).orderBy("m").first()
    assert same["low"] == b["low"]


def test_selection(spark):
    assert C.simplex_grid(spark, 3, 10).count() == 66
    assert [r[0] for r in spark.createDataFrame([(0.5, 4), (0.01, 9)], "r double, n int").select(C.budget_of(F.col("r"), F.col("n"))).collect()] == [2, 1]
    data = spark.createDataFrame([(w, c, f, f, f) for w, c, f in (("a", 0, 0.9), ("a", 1, 0.1), ("b", 0, 0.2), ("b", 1, 0.8), ("c", 0, 0.3), ("c", 1, 0.7))], "work string, cfg int, f1 double, recall double, precision double")
    assert rows(C.leave_one_work_out(data, ["cfg"]).select("work", "cfg", "f1"), "work") == [("a", 1, 0.1), ("b", 0, 0.2), ("c", 0, 0.3)]
    folds = C.folds(data, "work", 2)
    assert folds.select("work", "fold").distinct().count() == 3


def test_joins(spark):
    left = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    right = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    assert {r["k"]: r["reason"] for r in J.checked_lookup(left, right, "k").collect()} == {"x": "", "y": "ambiguous", "z": "missing", None: "unrecognised"}
    measures = spark.createDataFrame([(1, 0.0), (2, 4.0), (2, 9.0)], "measure int, offset double")
    beats = spark.createDataFrame([(1, ""), (2, "3"), (2, "-1"), (7, "1")], "measure int, beat string")
    assert [r["t"] for r in J.quarter_beats(beats, measures).orderBy("measure", "beat").collect()] == [0.0, 3.0, 6.0, None]


def test_readers(spark, tmp_path):
    (tmp_path / "a.notes.tsv").write_text("quarterbeats\tduration_qb\tmidi\n1/2\t1\t60\n\t1\t61\n")
    assert rows(tables.notes(spark, str(tmp_path / "*.notes.tsv")), "onset") == [("a", 0.5, 1.0, 60)]
    (tmp_path / "f.dez").write_text('{"labels":[{"type":"Cadence","start":4,"duration":0,"actual-duration":2,"tag":"PAC","staff":"1"},{"type":"CS1","start":1}]}')
    out = rows(tables.labels(spark, str(tmp_path / "*.dez")).select("piece", "kind", "start", "duration"), "start")
    assert out == [("f", "motive", 1.0, 0.0), ("f", "cadence", 4.0, 2.0)]
    assert tables.manifest(spark, str(tmp_path), "*.tsv").count() == 1


def test_streamed_bins(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{tiny}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in" / "x"))
    stream = streamed_bins(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "x")))
    q = stream.writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").count() > 0
