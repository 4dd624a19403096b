"""Linking with memory against a sequential brute force, and the stream against the batch."""

import itertools

import numpy as np
import pytest

from granulon.operators import linking, subnets
from granulon.streaming.linking import link_stream
from tests.test_growth import shuffled

SCHEMA = "frame long, id long, x double, y double, z double, material string"


def brute(rows, search, memory):
    """Frame after frame: of all ways to link what is remembered and present to the new places, the cheapest (search^2 for what stays unlinked)."""
    particle = {}
    for material in {r[5] for r in rows}:
        tracks = {}  # particle: (place, seen)
        for frame in sorted({r[0] for r in rows}):
            new = [r for r in rows if r[0] == frame and r[5] == material]
            old = [(p, x) for p, (x, seen) in tracks.items() if seen >= frame - 1 - memory]
            options = [[None, *(k for k, r in enumerate(new) if sum((a - b) ** 2 for a, b in zip(x, r[2:5], strict=True)) <= search**2)] for _, x in old]
            best = (np.inf, ())
            for choice in itertools.product(*options):
                taken = [k for k in choice if k is not None]
                if len(set(taken)) == len(taken):
                    cost = sum(search**2 if k is None else sum((a - b) ** 2 for a, b in zip(x, new[k][2:5], strict=True)) for (_, x), k in zip(old, choice, strict=True))
                    best = min(best, (cost, choice), key=lambda c: c[0])
            links = {k: p for (p, _), k in zip(old, best[1], strict=True) if k is not None}
            for k, r in enumerate(new):
                particle[r[1]] = links.get(k, r[1])
                tracks[particle[r[1]]] = (r[2:5], frame)
    return particle


def scene(seed=3, frames=4):
    """Particles of two materials that move, vanish for a frame or more, and come back."""
    rng, rows = np.random.default_rng(seed), []
    for material in ("gel", "sed"):
        at = rng.uniform(0, 5, (7, 3))
        for frame in range(frames):
            at = at + rng.normal(0, 0.4, at.shape)
            rows += [(frame, len(rows) + n, *map(float, p), material) for n, p in enumerate(at[rng.random(7) < 0.7])]
    return rows


def test_memory_equals_brute_force(spark):
    rows = scene()
    got = {r["id"]: r["particle"] for r in linking.link_with_memory(spark.createDataFrame(rows, SCHEMA), 1.5, 2).collect()}
    assert got == brute(rows, 1.5, 2)


def test_remembered_and_present_compete(spark):
    """The remembered particle 1 lies nearer to the new place than the present 2, which takes the other; gap after gap would cross them."""
    rows = [(0, 1, 0.0, "gel"), (0, 2, 2.0, "gel"), (1, 3, 1.8, "gel"), (2, 4, 0.5, "gel"), (2, 5, 3.0, "gel")]
    df = spark.createDataFrame([(f, i, x, 0.0, 0.0, m) for f, i, x, m in rows], SCHEMA)
    got = {r["id"]: r["particle"] for r in linking.link_with_memory(df, 1.4, 1).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2}


def test_rows_without_a_place_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, "gel"), (1, 2, 0.1, 0.0, 0.0, "gel"), (1, 3, None, 0.0, 0.0, "gel"), (None, 4, 0.0, 0.0, 0.0, "gel"), (1, 5, 0.0, 0.0, 0.0, None), (1, 6, float("nan"), 0.0, 0.0, "gel")], SCHEMA)
    assert {r["id"]: r["particle"] for r in linking.link_with_memory(df, 1.0, 1).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert linking.link_with_memory(df.limit(0), 1.0, 1).count() == 0


def test_stream_equals_batch_and_late_frames_go_aside(spark, tmp_path):
    rows = scene(5)
    for frame in range(4):
        part = [r for r in rows if r[0] == frame]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(frame)))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = link_stream(stream, f"file://{tmp_path}/out", str(tmp_path / "cp"), 1.5, 1).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.createDataFrame([(2, 900, 0.0, 0.0, 0.0, "gel"), (9, 901, None, 0.0, 0.0, "gel")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "late"))
    link_stream(stream, f"file://{tmp_path}/out", str(tmp_path / "cp"), 1.5, 1).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["particle"] for r in spark.read.parquet(f"{tmp_path}/out/linked").collect()}
    assert got == brute(rows, 1.5, 1)
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/out/late").collect()} == {900, 901}
    assert len(list((tmp_path / "out" / "tracks").glob("batch=*"))) <= 2


def dense(n, m, seed):
    """Two frames of places that nearly all lie within reach of each other."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.6, (n, 3)), rng.normal(0, 0.6, (m, 3))


def as_locations(spark, *frames):
    rows = [(f, i, *map(float, p)) for f, side in enumerate(frames) for i, p in enumerate(side, 100_000 * f)]
    return spark.createDataFrame(rows, "frame long, id long, x double, y double, z double")


def brute_subnets(p, q, search, most=30, shrink=0.95, stop=0.1):
    """Every candidate written out, subnets by flooding, and the dense assignment of each."""
    d2, out = ((p[:, None] - q[None]) ** 2).sum(2), set()
    work = [(set(range(len(p))), set(range(len(q))), search)]
    while work:
        a, b, limit = work.pop()
        while a:
            left, right, new = set(), set(), {a.pop()}
            while new:
                left |= new
                reached = {j for j in b - right if any(d2[i, j] <= limit * limit for i in new)}
                right |= reached
                new = {i for i in a - left if any(d2[i, j] <= limit * limit for j in reached)}
            a, b = a - left, b - right
            if len(left) > most and limit > stop * search:
                work.append((left, right, limit * shrink))
            elif right:
                src, dst = sorted(left), sorted(right)
                cost = np.full((len(src), len(dst) + len(src)), 1e12)
                part = d2[np.ix_(src, dst)]
                cost[:, : len(dst)] = np.where(part <= limit * limit, part, 1e12)
                cost[np.arange(len(src)), len(dst) + np.arange(len(src))] = search * search
                out |= {(src[i], 100_000 + dst[c]) for i, c in enumerate(linking.assign(cost)) if c < len(dst)}
    return out


@pytest.mark.parametrize("whole", [20_000, 50])
def test_dense_frames_shuffle_places_and_not_candidates(spark, whole):
    """150 and 170 places have some 20,000 candidates; one task a frame, or blocks and subnets."""
    p, q = dense(150, 170, 8)
    df = as_locations(spark, p, q)
    found, rows = shuffled(spark, lambda: {(r["a"], r["b"]) for r in linking.links(df, 1.5, whole=whole).collect()})
    assert found == brute_subnets(p, q, 1.5)
    assert whole < 320 or rows < 2_000


def test_a_subnet_that_no_range_splits_is_assigned_along_its_candidates(spark):
    """5,000 places each: the dense matrix of this subnet would have 50 million entries and the table of candidates 24 million rows."""
    rng = np.random.default_rng(9)
    p = rng.normal(0, 0.6, (5000, 3))
    q = rng.permutation(p + rng.normal(0, 0.002, p.shape))
    found = linking.links(as_locations(spark, p, q), 1.5).collect()
    # no place stays alone, and the sum of squares is at most that of the true partners
    cost = sum(((p[r["a"]] - q[r["b"] - 100_000]) ** 2).sum() for r in found)
    assert len(found) == len({r["a"] for r in found}) == len({r["b"] for r in found}) == 5000
    assert cost <= 5000 * 3 * 0.002**2 * 1.1


def test_bids_and_paths_give_the_least_cost():
    rng = np.random.default_rng(10)
    for _ in range(100):
        n, m = rng.integers(1, 25, 2)
        p, q, limit, unlinked = rng.uniform(0, 3, (n, 3)), rng.uniform(0, 3, (m, 3)), rng.uniform(0.5, 3), rng.uniform(0.1, 9)
        d2 = ((p[:, None] - q[None]) ** 2).sum(2)
        i, j = np.nonzero(d2 <= limit * limit)
        cost = np.full((n, m + n), 1e12)
        cost[i, j] = d2[i, j]
        cost[np.arange(n), m + np.arange(n)] = unlinked
        want = linking.assign(cost)
        assert (subnets.assign_sparse(n, m, i, j, d2[i, j], unlinked) == np.where(want < m, want, -1)).all()
        near = [tuple(map(np.concatenate, zip(*subnets.near_pairs(p, q, limit, most=20), strict=True)))] if len(i) else []
        assert not near or sorted(zip(*near[0][:2], strict=True)) == sorted(zip(i, j, strict=True))


def test_more_sources_than_targets_are_assigned_from_the_side_of_the_targets(monkeypatch):
    rng = np.random.default_rng(11)
    p, q, rows = rng.uniform(0, 3, (180, 3)), rng.uniform(0, 3, (90, 3)), []
    solve = linking.assign_sparse
    monkeypatch.setattr(linking, "assign_sparse", lambda n, *more: rows.append(n) or solve(n, *more))
    d2 = ((p[:, None] - q[None]) ** 2).sum(2)
    cost = np.full((180, 90 + 180), 1e12)
    cost[:, :90] = np.where(d2 <= 1.0, d2, 1e12)
    cost[np.arange(180), 90 + np.arange(180)] = 4.0
    want = linking.assign(cost)
    row, col = linking._solved(p, q, 1.0, 2.0)
    assert dict(zip(row.tolist(), col.tolist(), strict=True)) == {i: c for i, c in enumerate(want.tolist()) if c < 90}
    assert rows == [90]


def test_frames_of_some_ten_thousand_places_take_few_jobs(spark, monkeypatch):
    """Three frames of 7,500 places were over the bound of one task, and each frame some hundred jobs."""
    def refuse(*a):
        raise AssertionError("blocks")

    monkeypatch.setattr(linking, "_in_blocks", refuse)
    rng = np.random.default_rng(12)
    frames = [rng.uniform(0, 300, (7500, 3)) for _ in range(3)]
    rows = [(f, 10_000 * f + i, *p, "gel") for f, side in enumerate(frames) for i, p in enumerate(side.tolist())]
    got = linking.link_with_memory(spark.createDataFrame(rows, SCHEMA), 1.5, 1).collect()
    assert len(got) == 22_500
