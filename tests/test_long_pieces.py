"""Pieces of hundreds of leaves, which a limit left out before, against SQL and plain loops."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.operators import grids as H
from ligature.operators import kernels as K
from ligature.operators import matching as M
from ligature.operators import trees as R
from ligature.plans import registry

#: Users with an event every four days, and how many: a leaf of 96 hours each.
LONG = {20001: 360, 20002: 400}


@pytest.fixture(scope="module")
def long(tiny, tmp_path_factory):
    """The smallest tables with longer pieces among the events."""
    folder = tmp_path_factory.mktemp("long")
    for f in Path(tiny).glob("*.parquet"):
        if f.name != "events.parquet":
            (folder / f.name).symlink_to(f)
    users = ", ".join(f"({u}, {n})" for u, n in LONG.items())
    duckdb.execute(f"""COPY (SELECT * FROM '{tiny}/events.parquet' UNION ALL SELECT e.* EXCLUDE (r) REPLACE ((u*1000+r)::bigint AS event_id, u::bigint AS user_id, (TIMESTAMP '2023-12-30' + INTERVAL 96 HOUR * r)::TIMESTAMP AS ts)
     FROM (SELECT *, row_number() OVER (ORDER BY event_id) r FROM '{tiny}/events.parquet') e(event_id, ts, user_id, event_type, value, props, r) JOIN (VALUES {users}) v(u, n) ON r<=n) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


def both(spark, folder, name):
    """The rows of a query and of its SQL, in order."""
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in df.select(*columns).collect()), sorted(want)


def test_salient_splits_of_long_pieces(spark, long):
    got, want = both(spark, long, "salient_splits")
    assert {f"u{u}" for u in LONG} <= {r[0] for r in want}
    assert got == want


def test_salient_budget_of_long_pieces(spark, long):
    got, want = both(spark, long, "salient_budget")
    assert sum(r[0] == f"u{max(LONG)}" for r in want) == 3
    assert got == want


def test_revenue_of_long_pieces(spark, long):
    got, want = both(spark, long, "revenue_recompute")
    assert [r[0] for r in got] == [r[0] for r in want] and f"u{max(LONG)}" in {r[0] for r in want}
    # A long piece adds up tens of thousands of pairs, in another order.
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], rel=1e-9)


def test_programs_of_long_pieces(spark, long):
    got, want = both(spark, long, "program_not_worse")
    assert got == want


def test_merges_equal_those_found_anew():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 40):
        a, c = rng.integers(1, 4, (n, n)).astype(float), rng.integers(0, 3, max(0, n - 1)) / 2
        a = a + a.T
        prefix = K.prefix2(a)

        def pick(clusters, c=c, prefix=prefix):
            pairs = [(i, k, j) for (i, k), (_, j) in zip(clusters, clusters[1:], strict=False)]
            mean = [K.cross_sums(prefix, i, np.array([k]), j)[0] / ((k - i) * (j - k)) for i, k, j in pairs]
            return int(np.argmax([0.7 * m - 0.3 * c[k - 1] - 0.1 * ((2 * k - i - j) / (j - i)) ** 2 for m, (i, k, j) in zip(mean, pairs, strict=True)]))

        assert K.boundary_linkage(a, c, 0.3, 0.1) == K.merged(n, pick)


def pieces(spark, sizes, work="w0"):
    """Leaves of so many for each piece, and a mark every seven leaves."""
    rng = np.random.default_rng(6)
    rows = [(f"p{p}", work, k, float(k), float(k + 1), rng.random(12).round(2).tolist()) for p, n in enumerate(sizes) for k in range(n)]
    leaves = spark.createDataFrame(rows, "piece string, work string, leaf int, start double, end double, vec array<double>")
    return leaves, leaves.where("leaf % 7 = 3").select("piece", (F.col("start") + 0.4).alias("t"))


def test_configurations_of_long_pieces(spark):
    leaves, marks = pieces(spark, [9, 360])
    got = H.configuration_sums(leaves.withColumn("size", F.lit(1.0)), marks, ["euclidean"], [2, 5], [40], [0.5])
    want: dict[tuple, list] = {}
    for n, p in ((9, "p0"), (360, "p1")):
        vectors = np.array([r["vec"] for r in leaves.where(F.col("piece") == p).orderBy("leaf").collect()])
        for method, nodes in (("euclidean", K.greedy_distance(vectors, R.TRANSFORMS["euclidean"])), ("balanced", K.balanced(n))):
            for kind, budget, splits in (*(("depth", d, H.above(nodes, d)) for d in (2, 5)), ("budget", 40, [k for _, _, k in nodes[::-1][:40]])):
                tp, fp, fn = H.matches(sorted(map(float, splits)), [k + 0.4 for k in range(n) if k % 7 == 3], 0.5)
                want.setdefault((method, kind, budget), []).append((tp / (tp + fn), tp / (tp + fp)))
    sums = {k: (2, *np.sum(v, axis=0)) for k, v in want.items()}
    found = got.where("method <> 'random' AND kind <> 'oracle'").groupBy("method", "kind", "budget").agg(*(F.sum(c) for c in ("pieces", "recall", "precision"))).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == {k: pytest.approx(v) for k, v in sums.items()}


def test_trials_of_long_pieces(spark):
    """Sums of rates count long pieces, as the counts of each do; programs of a piece go in blocks."""
    leaves, marks = pieces(spark, [9, 360])
    splits = leaves.where("leaf > 0").select("piece", "work", F.col("leaf").alias("split"), ((F.col("leaf") * 5 % 11) / 10).alias("u"), (F.pmod(F.col("leaf") * 3, F.lit(7)) / 6).alias("v"))
    fitted = [{"stage": s, "outer_work": o, "work": "w0", "weights": [0.7, 0.3], "gain": 2.0, "intercept": 0.1} for s, o in (("inner", "x"), ("outer", "w0"))]
    grid = [(0.0, 0.0), (0.6, 0.1)]
    score = lambda m: 1 / (1 + F.exp(-m))
    each = [("similarity", F.lit(1.0)), ("unsupervised", (F.col("u") + F.col("v")) / 2), ("supervised", score(F.lit(0.1) + 2 * (0.7 * F.col("u") + 0.3 * F.col("v") - 0.5)))]
    contrasts = None
    for t in fitted:
        for kind, c in each:
            one = splits.select(F.lit(kind).alias("kind"), F.lit(t["stage"]).alias("stage"), F.lit(t["outer_work"]).alias("outer_work"), "work", "piece", "split", c.alias("score"))
            contrasts = one if contrasts is None else contrasts.unionByName(one)
    plain = leaves.drop("work")
    counted = H.trial_counts(plain, marks, contrasts, grid, [0.3], [0.2], 0.5)
    keys = ["kind", "stage", "outer_work", "search", "weight", "balance", "mode", "value"]
    rated = M.with_rates(counted).groupBy(*keys).agg(F.count("*").alias("pieces"), *(F.sum(c).alias(c) for c in ("f1", "recall", "precision")))
    want = {tuple(r[:8]): tuple(r[8:]) for r in rated.collect()}
    summed = H.trial_sums(plain, marks, splits, ["u", "v"], fitted, grid, [0.3], [0.2], 0.5).groupBy(*keys).agg(*(F.sum(c) for c in ("pieces", "f1", "recall", "precision")))
    got = {tuple(r[:8]): tuple(r[8:]) for r in summed.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and {v[0] for v in got.values()} == {2}
