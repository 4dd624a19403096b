import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granulon.llm import drake


def brute(rows, k, rounds, dimension):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    c = [v for _, v in seeds]
    d2 = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((d2(v, w), n) for n, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in ok]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(ok, own, strict=True) if o == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    best = [(i, *near(v)) for i, v in ok] if c else []
    of = {n: sum(d for _, d, m in best if m == n) for n in range(len(c))}
    return sorted((-1 if i is None else i, n, d, of[n], sum(of.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in best)


def got(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (20, 6), (2, 3), (1, 2)])
def test_equals_brute_force(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (i % 9)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 420)] + [(400, [0.0] * 4), (7, rows[7][1]), (None, [5.0] * 4)]  # one very common vector, repeated ids
    rows += [(500, None), (501, []), (502, [1.0, None, 2.0, 0.0]), (503, [float("nan")] * 4), (504, [float("inf")] * 4), (505, [1.0] * 5)]
    assert got(drake.cluster(frame(spark, rows), k, rounds, 4)) == brute(rows, k, rounds, 4)


def test_ties_and_small_tables(spark):
    grid = [(i, [float(i % 3) / 512, float(i // 3) / 512]) for i in range(9)]  # many equal distances
    assert got(drake.cluster(frame(spark, grid), 4, 5, 2)) == brute(grid, 4, 5, 2)
    same = [(i, [1.0, 1.0]) for i in range(6)]  # equal centroids: the smaller number has all
    assert got(drake.cluster(frame(spark, same), 4, 3, 2)) == brute(same, 4, 3, 2)
    assert drake.cluster(frame(spark, []), 4, 3, 2).count() == 0
    assert got(drake.cluster(frame(spark, grid[:2]), 8, 2, 2)) == brute(grid[:2], 8, 2, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 12), st.integers(1, 60))
def test_bounds_are_bounds(seed, k, n):
    """After any moves of the centroids: assignments are exact, the upper bound is over the distance, and every lower one under those it stands for."""
    rng = np.random.default_rng(seed)
    x, c = (np.floor(rng.normal(size=(m, 3)) * 40) for m in (n, k))
    listed = max(1, min(3, k - 1))
    near, lower, upper = drake.scan(x, c, listed)
    for _ in range(6):
        moved = c + np.floor(rng.normal(size=c.shape) * rng.choice([0.2, 3, 30]))
        drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-9)
        c = moved
        drake.reassign(x, near, lower, upper, c, drift)
        d = drake.squared(x, c)
        assert (near[:, 0] == d.argmin(1)).all()
        far = np.sqrt(d)
        assert (upper >= far[np.arange(n), near[:, 0]] - 1e-6).all()
        assert (lower[:, :listed] <= np.take_along_axis(far, near[:, 1:].astype(int), 1) + 1e-6).all()
        rest = far.copy()
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        assert (lower[:, listed] <= rest.min(1) + 1e-6).all()
