"""Manifests: reasons in their order, checksums, revisions."""

import hashlib
import subprocess

from pyspark.sql import functions as F

from ligature.sources import manifests as S


def tree(folder, **contents):
    folder.mkdir()
    for name, text in contents.items():
        stem, _, suffix = name.rpartition("_")
        (folder / f"{stem}.{suffix}").write_text(text)
    return f"file://{folder}"


def test_looked_up(spark, tmp_path):
    notes = tree(tmp_path / "notes", s1_csv="one", s2_csv="two", s3_csv="three", odd_csv="four", s5_csv="bad", readme_txt="no")
    scores = tree(tmp_path / "scores", p1_krn="x", p2_krn="y", q2_xml="z", p5_krn="w")
    key = F.nullif(F.regexp_extract("name", r"^[a-z](\d)", 1), F.lit(""))
    piece = F.regexp_extract("name", r"^(.*)\.", 1)
    issue = F.when(F.col("content").cast("string") == "bad", "odd token")
    a = S.files(spark, notes, ".csv").select(piece.alias("piece"), piece.alias("work"), key.alias("key"), "path", "sha256", issue.alias("issue"))
    s = S.files(spark, scores, ".krn", ".XML").select(key.alias("key"), "path", "sha256")
    rows = {r["piece"]: r for r in S.looked_up(a, s, "forms").collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {"s1": "", "s2": "paired_score_ambiguous", "s3": "paired_score_missing", "odd": "annotation_filename_unrecognised", "s5": "annotation_invalid: odd token"}
    assert [k for k, r in rows.items() if r["status"] == "included"] == ["s1"]
    assert rows["s1"]["annotation_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert rows["s1"]["score_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert rows["s1"]["score_path"].endswith("p1.krn")
    assert rows["s2"]["score_path"] == rows["s2"]["score_sha256"] == rows["s3"]["score_path"] == ""
    assert S.looked_up(a.where("false"), s, "forms").count() == 0


def test_matched(spark):
    a = spark.createDataFrame([("w_1", "a1", "h1"), ("w_2", "a2", "h2")], "piece string, path string, sha256 string")
    b = spark.createDataFrame([("w_2", "b2", "k2"), ("v_3", "b3", "k3")], "piece string, path string, sha256 string")
    rows = S.matched(a, b, "abc", F.regexp_replace("piece", "_[^_]*$", "")).orderBy("piece").collect()
    assert [tuple(r) for r in rows] == [
        ("abc", "v", "v_3", "", "b3", "excluded", "notes_or_harmony_missing", "", "k3"),
        ("abc", "w", "w_1", "a1", "", "excluded", "notes_or_harmony_missing", "h1", ""),
        ("abc", "w", "w_2", "a2", "b2", "included", "", "h2", "k2"),
    ]
    assert tuple(rows[0].asDict()) == S.COLUMNS


def test_revisions(spark, tmp_path):
    copy = tmp_path / "copy"
    subprocess.run(["git", "init", "-q", str(copy)], check=True)
    assert S.revision(copy) == ""
    subprocess.run(["git", "-C", str(copy), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "m"], check=True)
    one = S.revision(copy)
    assert len(one) == 40 and S.revision(tmp_path / "none") == ""
    table = spark.createDataFrame([("abc",), ("forms",), (None,)], "dataset string")
    got = S.with_revisions(table, {"abc": (one, ""), "fugues": ("x", "y")}).collect()
    assert [tuple(r) for r in got] == [("abc", one, ""), ("forms", "", ""), (None, "", "")]
    assert [tuple(r)[1:] for r in S.with_revisions(table, {}).collect()] == [("", "")] * 3
