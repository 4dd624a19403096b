"""Work that must not grow faster than the rows: what a query shuffles is counted, and its results are compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.operators import balls, clusters, fits, reports, spatial, strain
from granulon.plans import adapters


def shuffled(spark, run):
    """Result of ``run`` and how many rows it shuffled."""
    def written():
        g = spark.sparkContext._gateway
        none = g.jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, g.new_array(g.jvm.double, 0), none)
        return {x.stageId(): x.shuffleWriteRecords() for x in g.jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)}

    before = written()
    found = run()
    return found, sum(n for k, n in written().items() if k not in before)


def places(n, seed, size=4.0):
    return np.random.default_rng(seed).normal(0, size, (n, 3))


def as_tracks(spark, ref, cur):
    rows = [(k, i, *(None if v is None else float(v) for v in p)) for k, side in enumerate((ref, cur)) for i, p in enumerate(side)]
    return spark.createDataFrame(rows, "frame long, particle long, x double, y double, z double")


def brute_sums(ref, cur, r):
    found = {}
    for i in range(len(ref)):
        near = [j for j in range(len(ref)) if sum((ref[j][c] - ref[i][c]) ** 2 for c in range(3)) <= r * r]
        a, b = ref[near] - ref[i], cur[near] - cur[i]
        found[i] = (len(near), b.T @ a, a.T @ a, (b * b).sum())
    return found


@pytest.mark.parametrize("most", [20_000, 40])
def test_neighbour_sums_in_slices(spark, most):
    ref, cur = places(300, 1), places(300, 2)
    ref[200:], cur[200:] = ref[:100], cur[:100]  # copies
    want, pairs = brute_sums(ref, cur, 2.5), spark.createDataFrame([(0, 1)], "ref long, cur long")
    got = strain.neighbour_sums(as_tracks(spark, ref, cur), pairs, 2.5, most=most).collect()
    assert len(got) == 300
    for row in got:
        n, x, y, cc = want[row["particle"]]
        assert row["nnb_count"] == n
        assert np.allclose([row[f"x{a}{b}"] for a in "xyz" for b in "xyz"], x.ravel(), atol=1e-9)
        assert np.allclose([row[f"y{k}"] for k in ("xx", "xy", "xz", "yy", "yz", "zz")], y[np.triu_indices(3)], atol=1e-9)
        assert np.isclose(row["cc"], cc)


def test_neighbour_sums_skip_nulls_of_the_current_frame(spark):
    ref, cur = [(0.0, 0, 0), (1.0, 0, 0), (0.0, 1, 0)], [(0.0, 0, 0), (2.0, None, 0), (0.0, 3, None)]
    rows = {x["particle"]: x for x in strain.neighbour_sums(as_tracks(spark, ref, cur), spark.createDataFrame([(0, 1)], "ref long, cur long"), 1.0).collect()}
    assert [rows[k]["nnb_count"] for k in range(3)] == [3, 2, 2]
    assert rows[0]["xxx"] == 2.0 and rows[0]["xyy"] == 3.0 and rows[0]["cc"] == 0.0
    assert rows[1]["xxx"] == 2.0 and rows[1]["xyx"] is None and rows[1]["cc"] is None


@pytest.fixture
def no_broadcast(spark):
    """Joins shuffle both sides, as those of large tables do."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_neighbour_sums_send_no_edges(spark, no_broadcast):
    n = 1000
    ref, cur = places(n, 3, 0.5), places(n, 4, 0.5)  # all within reach of most
    t = as_tracks(spark, ref, cur)
    found, rows = shuffled(spark, lambda: strain.neighbour_sums(t, spark.createDataFrame([(0, 1)], "ref long, cur long"), 2.0).collect())
    assert len(found) == n and sum(x["nnb_count"] for x in found) > 100 * n
    assert rows < 60 * n


def test_neighbour_sums_of_copies_send_tracks_and_particles_once(spark, no_broadcast):
    n, frames = 300, 10
    rows = [(f, i, float(f), 0.5 * f, float(i % 3)) for f in range(frames) for i in range(n)]  # copies of three places
    t = spark.createDataFrame(rows, "frame long, particle long, x double, y double, z double")
    pairs = spark.createDataFrame(sorted({(0, f) for f in range(1, frames)} | {(f - 1, f) for f in range(1, frames)}), "ref long, cur long")
    found, sent = shuffled(spark, lambda: strain.neighbour_sums(t, pairs, 2.0).collect())
    met = n * (2 * frames - 3)
    assert len(found) == met and {x["nnb_count"] for x in found} == {n}
    assert sent < n * frames + met + 3000  # and some rows of places


def test_neighbour_sums_of_copies_send_no_row_for_each_pair(spark, no_broadcast):
    n, frames = 300, 10
    rows = [(f, i, float(f), 0.5 * f, float(i % 3)) for f in range(frames) for i in range(n)]  # copies of three places
    t = spark.createDataFrame(rows, "frame long, particle long, x double, y double, z double")
    pairs = spark.createDataFrame(sorted({(0, f) for f in range(1, frames)} | {(f - 1, f) for f in range(1, frames)}), "ref long, cur long")
    found, sent = shuffled(spark, lambda: strain.neighbour_sums(t, pairs, 2.0).collect())
    met = n * (2 * frames - 3)
    assert len({(x["ref"], x["cur"], x["particle"]) for x in found}) == len(found) == met
    assert sent < n * frames + met / 2


def test_neighbour_sums_of_distinct_places_are_sent_once(spark, no_broadcast):
    n, frames = 300, 10
    rng = np.random.default_rng(12)
    rows = [(f, i, *map(float, rng.uniform(0, 4, 3))) for f in range(frames) for i in range(n)]
    t = spark.createDataFrame(rows, "frame long, particle long, x double, y double, z double")
    pairs = spark.createDataFrame(sorted({(0, f) for f in range(1, frames)} | {(f - 1, f) for f in range(1, frames)}), "ref long, cur long")
    found, sent = shuffled(spark, lambda: strain.neighbour_sums(t, pairs, 2.0).collect())
    met = n * (2 * frames - 3)
    assert len(found) == met
    assert sent < n * frames + 1.5 * met  # one block: tracks, then the rows of pairs, and no sums


@pytest.mark.parametrize("most", [200_000, 400])
def test_strain_of_crowded_places(spark, most):
    """Far more neighbours than are summed one by one: leaves within reach by their sums, ties at the radius, places of several particles, a NaN."""
    rng = np.random.default_rng(13)
    ref = rng.integers(0, 40, (1200, 3)) * 0.25
    cur = ref @ np.array([[1.1, 0.2, 0], [0, 0.9, 0], [0.1, 0, 1]]) + rng.normal(0, 0.3, ref.shape)
    ref[1000:1100], cur[1000:1100] = ref[:100], cur[:100]
    cur[7, 2] = np.nan
    t, pairs = as_tracks(spark, ref, cur), spark.createDataFrame([(0, 1)], "ref long, cur long")
    want = brute_sums(ref, cur, 4.0)
    got = {x["particle"]: x for x in strain.neighbour_sums(t, pairs, 4.0, most=most).collect()}
    assert len(got) == 1200 and max(n for n, *_ in want.values()) > 150
    for i, (n, x, y, cc) in want.items():
        assert got[i]["nnb_count"] == n
        assert np.allclose([got[i][f"x{a}{b}"] for a in "xyz" for b in "xyz"], x.ravel(), rtol=1e-9, atol=1e-8, equal_nan=True)
        assert np.allclose([got[i][f"y{k}"] for k in ("xx", "xy", "xz", "yy", "yz", "zz")], y[np.triu_indices(3)], rtol=1e-9, atol=1e-8)
        assert np.isclose(got[i]["cc"], cc, rtol=1e-9, equal_nan=True)
    strains = {x["particle"]: x for x in strain.local_strain(t, pairs, 4.0, most=most).collect()}
    columns = {x["particle"]: x for x in strain.affine(strain.neighbour_sums(t, pairs, 4.0), ["ref", "cur", "particle"]).collect()}
    show = lambda v: np.nan if v is None else float(v)
    assert all(np.allclose([show(v) for v in strains[i]], [show(columns[i][c]) for c in strains[i].asDict()], rtol=1e-7, atol=1e-7, equal_nan=True) for i in strains)


def _counted(spark, rows):
    """A table of strain, and how many of its rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "ref long, cur long, particle long, nnb_count long, d2_min double, exz double"
    return spark.createDataFrame(rows, schema).mapInArrow(count, schema), made


def test_filtered_strain_and_interface_map_make_the_strain_once(spark, no_broadcast):
    rng = np.random.default_rng(15)
    rows = [(0, c, i, int(rng.integers(3, 40)) if i % 9 else 30, float(rng.normal(5, 1)), float(rng.normal(0, 1))) for c in (1, 2, 3) for i in range(200)]
    rows = [r if r[2] != 3 else (*r[:3], None, *r[4:]) for r in rows]
    table, made = _counted(spark, rows)
    kept = [r for r in rows if r[3] is not None and r[3] > 4]
    for k in (4, 5):
        low, high = np.quantile([r[k] for r in kept], [0.25, 0.75])
        kept = [r for r in kept if low - (high - low) <= r[k] <= high + (high - low)]
    assert sorted(map(tuple, reports.filtered_strain(table, ["d2_min", "exz"], 4, 1.0).collect())) == sorted(kept)
    assert made.value == len(rows)

    table, made = _counted(spark, rows)
    at = {i: (float(rng.uniform(0, 8)), float(rng.uniform(0, 8)), float(rng.uniform(0, 20))) for i in range(210)}
    places = spark.createDataFrame([(i, *p) for i, p in at.items()], "particle long, x double, y double, dist double")
    got = {(r["cur"], r["x_bin"], r["y_bin"]): (r["n"], r["percent"]) for r in reports.interface_map(table, places, "exz", 15.0, 9, 2).collect()}
    assert made.value == len(rows)
    poor = {r[2] for r in rows if r[3] is None or r[3] < 9}
    chosen = [i for i in range(200) if i not in poor and at[i][2] < 15]
    cell = {}
    for k in (0, 1):
        low, high = min(at[i][k] for i in chosen), max(at[i][k] for i in chosen)
        for i in chosen:
            cell.setdefault(i, []).append(1 if at[i][k] <= (low + high) / 2 else 2)
    want = {}
    for r in rows:
        if r[2] in cell:
            want.setdefault((r[1], *cell[r[2]]), []).append(r[5])
    assert got == {k: (len(v), pytest.approx(100 * np.mean(v))) for k, v in want.items()}


def test_few_of_the_distances_are_looked_at(monkeypatch):
    p, looked, within = places(6000, 14, 0.5), [], balls._within
    monkeypatch.setattr(balls, "_within", lambda p, q, r2: looked.append(len(p) * len(q)) or within(p, q, r2))
    on = np.ones(len(p), bool)
    found, _, _, _, count = balls.offset_sums(p, p, np.zeros(p.shape, bool), np.ones(len(p)), on, on, 2.0)
    assert len(found) == 6000 and (count == [(((p - q) ** 2).sum(1) <= 4).sum() for q in p]).all()
    assert sum(looked) < 0.8 * count.sum()  # cells of the radius compare several times that


def test_tracks_meet_by_frame_and_particle_where_they_are(spark, no_broadcast):
    t = adapters.tracks(spark, "/root/testdata/sf0.001")
    one = t.select("frame", "particle").limit(1).collect()
    few = spark.createDataFrame(one, "frame long, particle long")
    count, alone = shuffled(spark, lambda: len(t.collect()))
    got, met = shuffled(spark, lambda: t.join(few, ["frame", "particle"], "left_semi").collect())
    assert len(got) == 1 and count > 100 and met < alone + 10


def test_paired_is_the_join_of_both_frames(spark):
    rows = [(0, 1, 1.0), (0, 1, 2.0), (1, 1, 3.0), (1, 1, 4.0), (0, 2, 5.0), (1, 3, 6.0), (1, None, 7.0), (0, None, 8.0), (None, 4, 9.0), (2, 2, None), (1, 2, 0.0)]
    t = spark.createDataFrame([(f, p, x, 0.0, 0.0) for f, p, x in rows], "frame long, particle long, x double, y double, z double")
    pairs = [(0, 1), (1, 2), (1, 1)]
    got = sorted(((r["ref"], r["cur"], r["particle"], r["x0"], r["x1"]) for r in strain.paired(t, spark.createDataFrame(pairs, "ref long, cur long")).collect()), key=str)
    want = sorted(((a, b, p, x, u) for a, b in pairs for f, p, x in rows for g, q, u in rows if f == a and g == b and p == q and p is not None), key=str)
    assert got == want


@pytest.mark.parametrize("copies", [1, 3])
def test_theil_sen_sends_no_slopes(spark, no_broadcast, copies):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=400).round(2), rng.normal(size=400).round(2)
    rows = [(0, k * 1000 + i, float(a), float(b)) for k in range(copies) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    t = spark.createDataFrame(rows, "frame long, particle long, x double, y double")
    got, sent = shuffled(spark, lambda: fits.theil_sen(t, "x", "y", "particle", ["frame"]).collect())
    xs, ys = np.tile(x, copies), np.tile(y, copies)
    i, j = np.triu_indices(len(xs), 1)
    use = xs[i] != xs[j]
    slopes = np.sort((ys[j] - ys[i])[use] / (xs[j] - xs[i])[use])
    n, pairs = len(xs), len(slopes)
    half = 1.959963984540054 * np.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    want = [np.median(slopes), slopes[round((pairs - half) / 2) - 1], slopes[round((pairs + half) / 2) - 1]]
    assert [got[0]["m"], got[0]["ci_lo"], got[0]["ci_hi"]] == pytest.approx(want, rel=1e-12)
    assert got[0]["n"] == n and sent < 40_000


def test_slopes_in_several_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 2, float(a), float(b), 1) for k, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    points = spark.createDataFrame(rows, "frame long, x double, y double, w long")
    ranks = lambda pairs: pairs.selectExpr("frame", "explode(sequence(1L, pairs, 211L)) as rank").selectExpr("frame", "cast(rank as int) as which", "rank")
    got = {(r["frame"], r["which"]): r["slope"] for r in fits._slopes_at(fits._slope_blocks(points, ["frame"], size=16), ["frame"], ranks).collect()}
    for f in (0, 1):
        p = [(a, b) for k, a, b, _ in rows if k == f]
        slopes = sorted((p[j][1] - p[i][1]) / (p[j][0] - p[i][0]) for i in range(60) for j in range(i + 1, 60))
        assert {w: s for (k, w), s in got.items() if k == f} == {w: slopes[w - 1] for w in range(1, len(slopes) + 1, 211)}


@pytest.mark.parametrize("most", [20_000, 30])
def test_clusters_by_cells(spark, monkeypatch, most):
    groups = spatial.block_groups
    monkeypatch.setattr(spatial, "block_groups", lambda *a: groups(*a, most=most))
    p, r = places(300, 7, 2.0), 0.7
    p[0], p[1], p[2] = (50, 0, 0), (50 + r, 0, 0), (50 + 2.5 * r, 0, 0)
    root = list(range(300))
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= r * r
    for _ in range(300):
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(300)]
    t = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)] + [(0, 300, float("nan"), 0.0, 0.0)], "frame long, id long, x double, y double, z double")
    got = {x["id"]: x["cluster"] for x in clusters.find_clusters(t, F.lit(True), r, ["frame"]).collect()}
    sizes = {k: root.count(k) for k in set(root)} | {300: 1}
    rank = {k: n for n, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k)), 1)}
    assert got == {i: rank[k] for i, k in enumerate([*root, 300])}
    members = spark.createDataFrame([(0, i, c) for i, c in got.items()], "frame long, id long, cluster long")
    big = [sizes[k] >= 5 for k in root]
    assert {x["id"] for x in clusters.near_large(t, members, 5, r, ["frame"]).collect()} == {i for i in range(300) if any(big[j] for j in np.flatnonzero(near[i]))}


def test_clusters_send_no_pairs(spark, no_broadcast):
    n = 800
    t = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(places(n, 8, 0.4))], "frame long, id long, x double, y double, z double")
    found, rows = shuffled(spark, lambda: clusters.find_clusters(t, F.lit(True), 1.0, ["frame"]).collect())
    assert len(found) == n and rows < 100 * n


def test_nearest_in_a_dense_group_looks_at_few_pairs(spark, monkeypatch):
    n, p, join, radii = 1200, places(1200, 9, 1.0), spatial.radius_join, []
    monkeypatch.setattr(spatial, "radius_join", lambda a, b, r, *more: radii.append(r) or join(a, b, r, *more))
    t = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "frame long, id long, x double, y double, z double")
    got = spatial.nearest(t, 3, 4.0, ["frame"]).collect()
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    first = (d2 <= radii[0] ** 2).sum()
    np.fill_diagonal(d2, np.inf)
    assert {(x["i"], x["rank"]): x["j"] for x in got} == {(i, k + 1): int(j) for i in range(n) for k, j in enumerate(np.argsort(d2[i])[:3])}
    assert first < 100 * n
