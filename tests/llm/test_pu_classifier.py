import zlib

import numpy as np

from granulon.llm import pu_classifier


def corpus(n=900):
    rows = []
    for i in range(n):
        junk = i % 6 == 0
        rows.append((i, " ".join((f"word{(i * 7 + k) % 997}" + ("###" if junk else "")) for k in range(12 + i % 40)) + ".", int(not junk)))
    return rows


def test_held_out_accuracy_and_folds(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, _row string")
    # labels of held-out rows are inverted: nothing may be learned from them
    inverted = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    labels = spark.createDataFrame([(i, inverted(i, y)) for i, _, y in rows if zlib.crc32(b"label%d" % i) % 5 < 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in pu_classifier.judge(docs, labels).select("_row.doc_id", "held_out", "score", "predicted").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.98
    kept = pu_classifier.keep(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b c"), (2, "x " * 5000), (2, "x " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([(2, 0), (1, None)], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in pu_classifier.judge(docs, none).collect()] == [(0.5, 1)] * 5
    some = spark.createDataFrame([(2, 1), (4, 1)], "doc_id long, quality int")
    assert pu_classifier.judge(docs, some).count() == 5
    assert pu_classifier.judge(docs.limit(0), some).count() == 0


def test_a_task_that_runs_again_keeps_its_branch(spark):
    binned = spark.range(0, 600, 1, 12).selectExpr("cast(id % 4 as int) as kind", "cast(id % 3 as int) as b")

    class Spy:
        def mapInArrow(self, f, kind):
            self.sums = binned.mapInArrow(f, kind)
            return self.sums

    spy = Spy()
    assert pu_classifier._moments(spy, [3])[:, 0, 0].tolist() == [150] * 4
    runs = [[(r["branch"], bytes(r["total"])) for r in spy.sums.collect()] for _ in range(2)]
    assert runs[0] == runs[1] and {b for b, _ in runs[0]} == set(range(12))


def test_moments_equal_brute_force(spark, monkeypatch):
    """Over more tasks than a level merges, every sum is that of the rows."""
    monkeypatch.setattr(pu_classifier, "TREE", 3)
    rng = np.random.default_rng(8)
    rows = [tuple(int(x) for x in (rng.integers(4), rng.integers(3), rng.integers(5))) for _ in range(400)]
    binned = spark.createDataFrame(rows, "kind int, a int, b int").repartition(11)
    got = pu_classifier._moments(binned, [3, 5])
    want = np.zeros((4, 9, 9))
    for kind, a, b in rows:
        x = np.zeros(9)
        x[[0, 1 + a, 4 + b]] = 1
        want[kind] += np.outer(x, x)
    assert (got == want).all()


def test_scores_equal_brute_force(spark):
    """Scores are the sums of the weights of a document's bins, whatever the partitions; a second run gives the same."""
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, y in rows if y and i % 3], "doc_id long, quality int")
    runs = [{r["doc_id"]: r["score"] for r in pu_classifier.judge(d, labels).select("_row.doc_id", "score").collect()} for d in (docs, docs, docs.repartition(9))]
    assert runs[0] == runs[1] == runs[2]


def test_risk_is_least():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((400, 1)), rng.normal(size=(400, 4))])
    good = x[:, 1] + x[:, 2] > -1
    p, u = x[good][:100].T @ x[good][:100] / 100, x.T @ x / 400
    prior, penalty = good.mean(), 1e-3

    def risk(w):
        l = lambda s, m: (1 + 2 * s * (w @ m[0]) + w @ m @ w) / 4  # noqa: E731, E741
        return prior * l(-1, p) + max(0, l(1, u) - prior * l(1, p)) + penalty * w @ w / 4

    w = pu_classifier.minimise(p, u, prior, penalty)
    assert all(risk(w) <= risk(w + d) + 2e-4 for d in rng.normal(scale=0.05, size=(300, 5)))
    assert np.mean((x @ w > 0) == good) > 0.9
