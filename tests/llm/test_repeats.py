"""Periodic runs, whitening and recompressed passages against brute force, and the ownership of intermediate tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ligature.llm import common, periodic, quality, queries, recompress, shingles, substrings, suffix_dedup, whiten

from .conftest import prose
from .test_llm import WORD, listed

# 11


def runs_of(words):
    """All runs by trying each period at each place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            b = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - b + q >= max(6, 4 * q):
                found.setdefault((b - q, i - b + q), q)
            i = max(i, b + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def described(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs_of_odd_texts(odd, empty):
    some = odd.where("doc_id is null or doc_id <> 10")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in periodic.periodic_runs(some).collect())
    assert got == Counter(described(i, t) for i, t in listed(some))
    assert periodic.periodic_runs(empty).count() == 0 and periodic.periodic_runs(empty).columns == COLUMNS


@pytest.mark.parametrize("seed", range(6))
def test_periodic_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters, words = "abcde"[: rng.choice([1, 2, 2, 3, 5])], []
        while len(words) < rng.choice([0, 5, 6, 7, 20, 60, 150]):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            words += (part * rng.randint(1, 9))[: rng.randint(1, 100)]
        ((got, runs),) = periodic.found([None], [" ".join(words)])
        assert [w.decode() for w in got] == words and runs == runs_of(words)


def test_nested_runs_ties_and_long_texts():
    words = (["a"] * 7 + ["b"]) * 5 + ["x"] + ["c", "d"] * 20
    ((_, runs),) = periodic.found([None], [" ".join(words)])
    assert runs == runs_of(words) and (0, 40, 8) in runs and (0, 7, 1) in runs and (41, 40, 2) in runs
    # Two texts at once don't see each other; a megabyte of one word takes one pass.
    both = list(periodic.found([None, None], ["a a a", "a a a"]))
    assert [r for _, r in both] == [[], []]
    ((_, one),) = periodic.found([None], ["word " * 250_000])
    assert one == [(0, 250_000, 1)]


def test_rewritten_ends_are_found(spark):
    docs = spark.createDataFrame([(k, prose(k, 80)) for k in range(200)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(docs).collect()}
    made = [k for k in rows if zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(made) > 10 and {tuple(rows[k][c] for c in COLUMNS) for k in made} == {described(k, prose(k, 80)) for k in made}
    assert any(rows[k]["n_runs"] for k in made) and all(r["n_runs"] == 0 for r in periodic.periodic_runs(docs, rewrite=False).collect())


# 12


def spectrum(kind, n, rng):
    return {
        "plain": rng.random(n), "equal": np.ones(n), "threes": np.repeat(rng.random(n // 3 + 1), 3)[:n],
        "wide": 10.0 ** -rng.integers(0, 9, n), "low rank": np.append(rng.random(min(n, 3)), np.zeros(max(0, n - 3))),
    }[kind]


@pytest.mark.parametrize("kind", ["plain", "equal", "threes", "wide", "low rank"])
def test_feast_finds_the_largest_eigenvalues(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 12, 30, 64):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = (q * spectrum(kind, n, rng)) @ q.T
        v = (v + v.T) / 2
        want = np.linalg.eigvalsh(v)[::-1]
        e, u = whiten.feast(v, 4)
        assert len(e) == min(4, int((want > 1e-10 * want.sum()).sum()))
        assert np.abs(e - want[: len(e)]).max() < 1e-10 * want.sum() and np.linalg.norm(v @ u - u * e) < 1e-10 * want.sum()
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-10
        bands = whiten.tridiagonal(v)
        for cut in np.linspace(0, 1, 7) * want[0] + 1e-3:
            if np.abs(want - cut).min() > 1e-9:
                assert whiten.above(bands, cut) == int((want > cut).sum())
    assert len(whiten.feast(np.zeros((3, 3)), 4)[0]) == 0


def test_whitening_equals_dense_eigenvectors(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet")
    twice = rows.unionByName(rows.where("vec_id < 40"))
    got = whiten.whitened(twice).toPandas()
    data = rows.toPandas().sort_values("vec_id")
    x = np.floor(np.array(data["embedding"].tolist(), float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    assert len(got) == 4 * (len(data) + 40) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for k in range(1, 5):
        one = got[got["component"] == k].drop_duplicates("vec_id").sort_values("vec_id")
        want = (x - fit.mean(axis=0)) @ u[:, -k] / np.sqrt(e[-k])
        assert np.abs(np.abs(one["whitened"]) - np.abs(want)).max() < 1e-8
        assert np.abs(one["explained"] - e[-k] / e.sum()).max() < 1e-10
        assert list(one["deviation"]) == [int(((n * v - sums) ** 2).sum()) for v in x]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [1.5, -2.0], 0), (3, None, 0), (4, [None, 1.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [], 0), (8, [1.0, 2.0, 3.0], 0), (None, [0.25, 0.125], 0), (2, [1.5, -2.0], 0), (9, [1e300, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    got = whiten.whitened(table).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter({(1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 2, (None, 1): 1, (None, 2): 1})
    assert {r["n"] for r in got} == {3} and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
    assert whiten.whitened(table.limit(0)).count() == 0 and whiten.whitened(table.where("vec_id = 1")).count() == 0
    # Sums beyond doubles stay exact; a deviation that is no long is null.
    big = spark.createDataFrame([(k, [float(2**44 + k), float(k * k)], 0) for k in range(6)], "vec_id long, embedding array<double>, x int")
    x = [(256 * (2**44 + k), 256 * k * k) for k in range(6)]
    sums = [sum(v[j] for v in x) for j in (0, 1)]
    want = {k: sum((6 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in whiten.whitened(big).collect()} == want
    far = spark.createDataFrame([(k, [float(k) * 2**50, 1.0], 0) for k in range(3)], "vec_id long, embedding array<double>, x int")
    assert {r["deviation"] for r in whiten.whitened(far).where("vec_id = 0").collect()} == {None}


# 13


def kept_words(docs, length=13):
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {k + d for k in range(len(w) - length + 1 if i is not None else 0) if first[tuple(w[k : k + length])] < i for d in range(length)}
        rest = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return Counter(out)


def words_kept(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.first_kept(df).collect())


def test_passages_of_earlier_documents_go(odd, empty):
    assert words_kept(odd) == kept_words(listed(odd))
    assert substrings.first_kept(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_random_and_periodic_texts(spark, seed):
    """Shared passages of 12 to 400 words, copies, runs of one word and near copies, in documents in any order."""
    rng = random.Random(seed)
    passages = [prose(rng.randrange(10**6), n) for n in (12, 13, 14, 20, 60, 400)] + ["same " * 40, "ab cd " * 30]
    docs = []
    for k in range(60):
        parts = [prose(rng.randrange(10**6), rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        docs.append((rng.randint(0, 70), " ".join(parts)))
    docs += [(100 + k, docs[5][1]) for k in range(5)] + [(200 + k, " ".join([*docs[7][1].split()[:30], "new", *docs[7][1].split()[30:]])) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = kept_words(docs)
    assert words_kept(df) == want and sum(n > 0 for _, _, n, _ in want) > 20


def test_full_filters_and_hot_groups_change_nothing(spark, monkeypatch):
    """With a filter that lets all anchors pass, and keys split from five rows on, results stay the same."""
    from ligature.llm import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    monkeypatch.setattr(substrings, "has_hash", lambda bits, h: np.ones(len(h), bool))
    docs = [(k, f"start{k} " + prose(3, 150) + f" middle{k % 7} " + prose(4, 30)) for k in range(40)]
    assert words_kept(spark.createDataFrame(docs, "doc_id long, text string")) == kept_words(docs)


def test_equal_stretches_get_equal_interior_symbols():
    """Symbols that a stretch of words decides on alone stand wherever the stretch does."""
    rng = random.Random(1)
    for _ in range(200):
        middle = [rng.choice("abcd") for _ in range(30)]
        sides = [[rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(4)]
        texts = [" ".join([*sides[0], *middle, *sides[1]]), " ".join([*sides[2], *middle, *sides[3]])]
        prints, counts = shingles.word_prints(texts)
        s = recompress.rounds(recompress.words(prints, counts), 4)
        seen = []
        for text, left in enumerate((len(sides[0]), len(sides[2]))):
            begin = text * (counts[0] + 2) + 1 + left
            seen.append({(n, a - begin, b - begin) for n, a, b, lo, hi, t in zip(s.name, s.start, s.end, s.low, s.high, s.text, strict=True) if t == text and lo >= begin and hi <= begin + 30})
        assert seen[0] == seen[1]
        assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()


# Intermediate tables


def folders(spark):
    place = common.shared_dir(spark).removeprefix("file:").replace("//", "/")
    return {f for f in os.listdir(place) if not f.count("-") == 4 or f.startswith("tables")}


def test_calls_remove_their_own_tables_only(spark, tiny):
    docs = common.documents(spark, tiny)
    before = folders(spark)
    good = quality.keep_good(docs)
    stripped = suffix_dedup.strip(docs)
    corpus_pipeline.run(spark, tiny).count()
    for name in ("op7_prefix_doubling_dedup", "op12_whitened_embeddings", "op13_recompressed_passages"):
        queries.queries()[name](spark, tiny).count()
    assert not {f for f in folders(spark) - before if f.startswith("tables")}
    # Results that weren't read before the pipeline ran can still be read.
    assert 0 < good.count() <= docs.count() and stripped.count() == docs.count()
    assert good.agg(F.sum(F.length("text"))).first()[0] > 0


def workers_of_a_task(df):
    """The most Python nodes of df's plan that one task runs, between exchanges."""
    deepest = 0

    def upto(node):
        nonlocal deepest
        kids = node.children()
        below = max((upto(kids.apply(k)) for k in range(kids.size())), default=0)
        if "Exchange" in node.nodeName():
            return 0
        n = below + any(k in node.nodeName() for k in ("InArrow", "InPandas", "EvalPython"))
        deepest = max(deepest, n)
        return n

    upto(df._jdf.queryExecution().executedPlan())
    return deepest


def test_no_task_of_the_last_steps_holds_two_workers(spark, tmp_path):
    same = prose(3, 90)
    spark.createDataFrame([(1, same), (2, "one " + same), (3, prose(4, 80)), (4, None), (5, "é")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, stripped = suffix_dedup.dedup(docs), suffix_dedup.strip(docs, unit=suffix_dedup.WORDS)
        assert workers_of_a_task(found) == 1 and workers_of_a_task(stripped) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    rows = {r["doc_id"]: r for r in found.collect()}
    for i, text in ((3, prose(4, 80)), (4, ""), (5, "é")):
        assert tuple(rows[i]) == (i, len(text.encode()), 0, 0, hashlib.sha256(text.encode()).hexdigest(), 0)
    assert rows[1]["n_removed"] == len(same) and rows[2]["n_passage_words"] == 90
    assert dict(listed(stripped)) == {1: "", 2: "one ", 3: prose(4, 80), 4: None, 5: "é"}


def test_new_queries_are_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


# Earlier operators


def test_only_letters_make_a_language(spark, tiny):
    from ligature.llm import lang_id

    assert lang_id.letter_runs("½²Ⅻ①x²y über日本_a1b") == ["x", "y", "über日本", "a", "b"]
    docs = common.documents(spark, tiny)
    odd = spark.createDataFrame([(10**6, "½ ² Ⅻ ① 123 _"), (10**6 + 1, "the ½ of it"), (10**6 + 2, None), (10**6 + 3, "")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs.unionByName(odd)).where("doc_id >= 1000000").collect()}
    assert {got[10**6 + k] for k in (0, 2, 3)} == {"und"} and got[10**6 + 1] != "und"


def test_the_sketch_filter_is_far_below_the_threshold():
    """A pair at the threshold stays under the filter with a probability of less than one in ten billion."""
    from math import comb

    from ligature.llm import near_dup

    for percent in (80, 85):
        least, j = near_dup.LEAST_ESTIMATE - (near_dup.PERCENT - percent) / 100, percent / 100
        upto = int(np.ceil(least * near_dup.SKETCH)) - 1
        assert sum(comb(near_dup.SKETCH, k) * j**k * (1 - j) ** (near_dup.SKETCH - k) for k in range(upto + 1)) < 1e-10


def test_members_that_fail_and_members_that_fail_once(spark, odd, tmp_path, monkeypatch):
    from ligature.llm import media

    path = str(tmp_path / "a")
    whole = media.store(odd, path)
    want = media.described(whole)
    bad = whole.where("doc_id = 10").first()
    with open(bad["archive"], "r+b") as f:
        f.seek(bad["at"] + 300)
        f.write(b"\0" * 40)
    again = spark.read.format("media_archive").option("path", path).load()
    assert [r["doc_id"] for r in media.described(again).collect() if r["error"]] == [10]
    with pytest.raises(Exception, match="can't be read"):
        media.described(again, on_error="fail").collect()
    with pytest.raises(ValueError):
        media.described(again, on_error="skip")
    assert want.columns == media.described(again, on_error="fail").columns
    # A failure that passes is tried again, for its member alone.
    reader, files = media.ArchiveReader(path, 1 << 20), media.filesystem(path)[0]
    calls, honest = [], media.ArchiveReader.payload

    def payload(files, archive, info):
        calls.append((archive, info.filename))
        if calls.count(calls[-1]) == 1:
            raise OSError("the store doesn't answer")
        return honest(files, archive, info)

    monkeypatch.setattr(reader, "payload", payload)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert files is not None and len(rows) == odd.count() and sum(r["error"] is not None for r in rows) == 1
    assert Counter(calls).most_common(1)[0][1] == media.TRIES and sorted(Counter(calls).values())[-2] == 2
