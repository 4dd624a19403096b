import hashlib
import re

import pytest
from pyspark.sql import functions as F

from granulon.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length=13):
    """{doc_id: (n_words, n_removed, kept)} of (doc_id, text) with different ids."""
    split = {d: WORD.findall(t or "") for d, t in texts}
    first = {}
    for d, w in split.items():
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, d), d)
    out = {}
    for d, w in split.items():
        gone = {i + k for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for k in range(length)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def run(spark, texts, **more):
    docs = spark.createDataFrame([(d, t, "c", 1, "k") for d, t in texts], "doc_id long, text string, kept string, n_words int, _w string")
    rows = substring_dedup.parsed(docs, **more).select("_row.doc_id", "n_words", "n_removed", "kept").collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def test_cases(spark):
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = [(9, w(0, 40)), (8, w(0, 12)), (7, f"x {w(5, 18)} y {w(18, 31)}\n\t{w(31, 44)}"), (3, w(5, 30)), (2, None), (1, ""), (12, w(0, 40)), (13, "a " * 60), (14, "a " * 30), (-4, "b " * 13), (15, "c c " + "b " * 20), (16, w(20, 33) + " " + w(10, 23)), (17, "é\xa0ü " * 14), (18, "é\xa0ü " * 15 + " \x1f"), (19, w(0, 30_000)), (20, w(29_000, 31_000))]
    assert run(spark, texts) == brute(texts)
    assert run(spark, [(None, w(0, 40)), (5, w(0, 40)), (5, w(0, 40))])[5] == (40, 0, w(0, 40))
    assert run(spark, []) == {}


@pytest.mark.parametrize("apart", [False, True])
def test_rows_that_share_an_id(spark, apart):
    w = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = f"{w('a', 3)} {w('r', 14)} {w('b', 83)} {w('s', 14)} {w('c', 16)}"  # 130 words, factors at 3 and 100
    other = f"{w('d', 40)} {w('s', 14)} {w('e', 20)}"
    texts = [(1, w("r", 14)), (2, w("s", 14)), (5, twice), (5, other), (5, twice), (5, None), (6, w("e", 20))]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(texts, schema).coalesce(1)
    if apart:  # each row in a slice of its own
        docs = spark.createDataFrame(texts, schema).repartition(7)
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.parsed(docs).where("_row.doc_id = 5").collect())
    kept = (130, 28, f"{w('a', 3)} {w('b', 83)} {w('c', 16)}")
    assert got == [(0, 0, ""), (74, 14, f"{w('d', 40)} {w('e', 20)}"), kept, kept]
    assert [tuple(r)[1:] for r in substring_dedup.parsed(docs).where("_row.doc_id = 6").collect()] == [(20, 20, "")]


def test_slices_and_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    texts = [(d, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for d in rng.sample(range(1000), 150)]
    assert run(spark, texts, length=5) == brute(texts, 5)


def test_factors_name_their_reference(spark):
    """Each factor is a run of words that its reference, of a smaller doc_id, has at the named place; wrong references are not believed."""
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = {1: w(0, 30), 2: "x " + w(20, 60), 7: f"{w(0, 30)} {w(30, 60)} tail", 9: w(5, 25) + " gap " + w(40, 55)}
    rows = spark.createDataFrame(list(texts.items()), "_id long, _t string").withColumn("_copy", F.lit(0).cast("long"))
    found = substring_dedup.factors(rows).collect()
    split = {d: t.split() for d, t in texts.items()}
    seen = {}
    for r in found:
        for f in r["factors"]:
            assert f["ref"] < r["doc_id"] and f["n"] >= 13
            assert split[r["doc_id"]][f["start"] : f["start"] + f["n"]] == split[f["ref"]][f["at"] : f["at"] + f["n"]]
            seen.setdefault(r["doc_id"], []).append((f["start"], f["n"], f["ref"], f["at"]))
    # document 7: thirty words of document 1, then document 2's from the first phrase that crosses their end
    assert {k: sorted(v) for k, v in seen.items()} == {7: [(0, 30, 1, 0), (20, 40, 2, 1)], 9: [(0, 20, 1, 5), (21, 15, 2, 21)]}
    wrong = spark.createDataFrame([(7, 0, [(0, 20, "no such words"), (30, 20, w(30, 50)), (45, 10, w(45, 55))])], "doc_id long, copy long, factors array<struct<start:int,n:int,x:string>>")
    got = wrong.withColumn("w", F.split(F.lit(texts[7]), " ")).select(substring_dedup.spans("w", "factors").alias("s"))
    assert [tuple(x) for x in got.first()["s"]] == [(30, 25)]


def test_remove_keeps_columns(spark):
    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, line + "\nend", "a"), (2, "start " + line, "b")], "doc_id long, text string, _row string")
    got = substring_dedup.remove(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, line + "\nend", "a"), (2, "start", "b")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_test_data(spark, sf):
    from granulon.llm.queries import op10_substring_dedup

    d = f"/root/testdata/{sf}"
    want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substring_dedup(spark, d).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in want.items()}


def test_a_reference_is_split_once_for_many_factors(spark, monkeypatch):
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = [(0, w(0, 400)), *((k, f"x{k} {w(k, k + 20)} y{k} {w(k + 50, k + 64)}") for k in range(1, 60))]
    monkeypatch.setattr(substring_dedup, "TOGETHER", 10)
    assert run(spark, texts) == brute(texts)
    docs = spark.createDataFrame(texts, "_id long, _t string").selectExpr("_id", "0L as _copy", "_t")
    plan = substring_dedup.with_references(docs, substring_dedup.factors(docs))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda x: [k for k, line in enumerate(plan) if x in line]
    assert len(at("split(")) == 1 and at("split(")[0] > at("Generate explode(_all")[0]
