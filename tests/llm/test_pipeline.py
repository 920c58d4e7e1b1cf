"""The pipeline's stages one after the other, each against what its input demands."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import brute_groups, brute_removal

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs
    rows = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in kept.items() if n != "packing"}
    fold = {}
    for d, t in rows["toxicity"]:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        fold[key] = max(fold.get(key, d), d)
    assert sorted(d for d, _ in rows["exact_dedup"]) == sorted(fold.values())
    assert {d for d, _ in rows["near_dedup"]} == set(brute_groups(rows["exact_dedup"]).values())
    removed = brute_removal(rows["near_dedup"])
    assert {d: len(t.encode()) for d, t in rows["suffix_dedup"]}.keys() == removed.keys()
    assert all(removed[d][0] - removed[d][1] - 6 * removed[d][2] <= len(t.encode()) <= removed[d][0] - removed[d][1] for d, t in rows["suffix_dedup"])
    assert {r.doc_id for r in kept["packing"].collect()} == {d for d, _ in rows["suffix_dedup"]}
