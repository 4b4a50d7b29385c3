"""The pipeline on the smallest documents, each stage against brute force on what the stage before it kept."""

import re

import numpy as np

import corpus_pipeline
from ligature.llm import secret_scan

from .test_llm import classes, measures, packed_well, without_passages


def test_pipeline_stage_by_stage(spark, tiny, tmp_path):
    docs, tables = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs.toPandas() if k == 4 else docs.toPandas().set_index("doc_id").sort_index())
    raw = spark.read.parquet(f"{tiny}/documents.parquet").toPandas().set_index("doc_id").sort_index()
    good, single, cut, clean, packed = tables

    for i, t in raw["text"].items():
        n, _, _, _, repeated = measures(t)
        if n < 10 or 100 * repeated > 20 * n:
            assert i not in good.index
    labels = spark.read.parquet(f"{tiny}/labels.parquet").toPandas().set_index("doc_id")
    fine = [i for i in labels.index[labels["quality"] == 1] if (m := measures(raw["text"].get(i)))[0] >= 10 and 5 * m[4] <= m[0]]
    assert np.mean([i in good.index for i in fine]) > 0.98

    groups = classes(list(good["text"].items()), 80)
    assert list(single.index) == [i for i, (_, root) in groups.items() if i == root]
    assert list(cut["text"]) == [t for t, _ in without_passages(list(single["text"]))]
    assert list(cut.index) == list(clean.index) == list(single.index)
    for i, t in cut["text"].items():
        if t != clean["text"][i]:
            assert "[secret]" in clean["text"][i]
        assert not any(len(m[2]) >= 12 for m in re.finditer(secret_scan.ASSIGN, clean["text"][i]))
    packed_well(packed.to_dict("records"), list(clean["text"].items()), 2048)


def test_run_is_the_last_stage(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
