import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.llm import hard_negatives


def brute(rows, positives, k):
    ok = sorted({(i, lab, tuple(float(np.floor(256 * x)) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a in ok:
        if a[0] % 5:
            continue
        score = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in ok if b != a and len(a[2]) == len(b[2])]
        for p, pid, _ in sorted(s for s in score if s[2])[:positives]:
            fit = sorted((s, i) for s, i, alike in score if not alike and 30 * -p <= 100 * -s <= 90 * -p)[:k]
            out += [(a[0], pid, n, i, int(-p), int(-s)) for n, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, positives=3, k=4):
    df = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, q int, bucket int")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 5 == 0, positives, k).collect())


@pytest.mark.parametrize("bucket", [4096, 16])
def test_equals_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2 * bucket)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) / 256 for x in rng.integers(-9, 10, 6) * (1 + i % 4)], int(rng.integers(4))) for i in range(260)]
    rows += [(int(i), [1.0, 2.0, 3.0, 0.0, 0.0, 1.0], i % 2) for i in range(300, 380)]  # one very common vector
    rows += [(500, None, 1), (505, [], 1), (510, [1.0, None], 1), (515, [float("nan")] * 6, 1), (520, [1.0] * 6, None), (None, [1.0] * 6, 1), (525, [0.0] * 6, 1), (530, [1.0, 2.0], 1), (531, [2.0, 2.0], 1), (532, [1.5, 1.0], 2)]
    rows += [rows[0], (0, [9.0] * 6, 1), (5, rows[5][1], 3)]  # a repeated row, and rows that share an id
    want = brute(rows, 3, 4)
    assert len(want) > 200 and mined(spark, rows) == want


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.5], 2), (8, [1.0], 2)]) == [(5, 6, 1, 7, 65536, 32768)]
