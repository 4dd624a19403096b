import os

import corpus_pipeline
from granulon.llm import quality_rules
from granulon.llm.common import shared_dir
from tests.llm.test_simhash import near_copies
from tests.llm.test_substring_dedup import brute as substrings

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, f in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = f(spark, docs, SF)
        path = quality_rules.materialise(out, "test", lasting=True)
        if name == "packing":
            length = {}
            for r in path.collect():
                length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
                assert r["doc_tokens"] >= r["length"]
            assert length.keys() == before.keys()
            break
        docs = path
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near dedup":
            label = near_copies(before)
            assert after.keys() == set(label.values()) and len(label) > len(set(label.values()))
        elif name == "substring dedup":
            want = substrings(list(before.items()))
            assert after == {k: want[k][2] if want[k][1] else before[k] for k in before}
        else:
            assert all(before[k] == t for k, t in after.items())
            good = {k for k in before if quality.get(k) == 1}
            assert len(good - after.keys()) <= 0.06 * len(good)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "a b", "en", "s", 3)], docs.schema)
    for _, f in corpus_pipeline.STAGES:
        f(spark, nulls, SF).collect()


def test_results_outlast_later_stages_and_runs_agree(spark):
    """A stage's lazy result can be read after other stages ran; two runs give the same rows and leave only their results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.near_dedup(spark, docs, SF)
    corpus_pipeline.rules(spark, docs, SF)
    corpus_pipeline.substrings(spark, docs, SF)
    assert 0 < first.count() < docs.count()
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) for _ in range(2)]
    assert rows[0] == rows[1]
    assert len(set(os.listdir(folder)) - before) == 2
