import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.llm import topk


def brute(rows, k):
    ok = sorted({(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for q, x in ok:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out += [(q, r, i, int(-s)) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, label int, q string")


@pytest.mark.parametrize("block", [1024, 8])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 10, 6) * (1 + i % 3)]) for i in range(300)]
    rows += [(int(i), [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (505, []), (510, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (515, [float("nan")] * 6), (520, [float("inf")] * 6), (None, [1.0] * 6), (525, [0.0] * 6), (530, [1.0, 2.0]), (531, [2.0, 2.0]), (0, rows[0][1]), (5, [9.0] * 6)]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=4).collect())
    assert got == brute(rows, 4)


def test_small_tables(spark):
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(frame(spark, [(5, [1.0])]), F.col("vec_id") % 5 == 0).count() == 0
    assert [tuple(r) for r in topk.top_k(frame(spark, [(5, [0.0, 0.0]), (6, [0.0, 0.0])]), F.col("vec_id") % 5 == 0).collect()] == [(5, 1, 6, 0)]
