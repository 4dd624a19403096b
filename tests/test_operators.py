"""Operators against numpy on made-up particles whose answer is known."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granulon.functions import tensor
from granulon.operators import clusters, fits, linking, quality, resampling, spatial, strain, volume
from granulon.sources import tables
from granulon.streaming import frames as stream

slow = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def lattice(n=4):
    return np.array([(i, j, k) for i in range(n) for j in range(n) for k in range(n)], float) + 0.07 * np.random.default_rng(0).normal(size=(n**3, 3))


def tracks(spark, *frames):
    return spark.createDataFrame([(f, i, *map(float, p)) for f, ps in enumerate(frames) for i, p in enumerate(ps)], "frame long, particle long, x double, y double, z double")


@slow
@given(st.lists(st.floats(-0.2, 0.2), min_size=9, max_size=9))
def test_affine_strain_is_recovered(spark, values):
    f = np.eye(3) + np.array(values).reshape(3, 3)
    ref = lattice()
    got = strain.local_strain(tracks(spark, ref, ref @ f.T + 3), spark.createDataFrame([(0, 1)], "ref long, cur long"), 1.6).collect()
    assert len(got) == len(ref)
    e = (f + f.T) / 2 - np.eye(3)
    for r in got:
        assert [r["exx"], r["exy"], r["exz"], r["eyy"], r["eyz"], r["ezz"]] == pytest.approx([e[0, 0], e[0, 1], e[0, 2], e[1, 1], e[1, 2], e[2, 2]], abs=1e-9)
        assert r["rxy"] == pytest.approx((f[0, 1] - f[1, 0]) / 2, abs=1e-9) and r["d2_min"] == pytest.approx(0, abs=1e-9)


def test_incomplete_tracks_leave_before_neighbours(spark):
    ref = lattice(3)
    got = strain.local_strain(tracks(spark, ref, ref[:-1]), spark.createDataFrame([(0, 1)], "ref long, cur long"), 1.6).collect()
    near = (np.linalg.norm(ref[:-1][:, None] - ref[:-1][None], axis=2) <= 1.6).sum(1)
    assert {r["particle"]: r["nnb_count"] for r in got} == dict(enumerate(near))


def test_rotation_of_strain_equals_strain_of_rotation(spark):
    ref = lattice()
    cur = ref + 0.05 * np.random.default_rng(1).normal(size=ref.shape)
    r = tensor.rotation("y", 33) @ tensor.rotation("x", 12)
    pairs = spark.createDataFrame([(0, 1)], "ref long, cur long")
    a = strain.local_strain(strain.rotate_positions(tracks(spark, ref, cur), r), pairs, 1.6).orderBy("particle").collect()
    b = strain.local_strain(tracks(spark, ref, cur), pairs, 1.6)
    b = b.select("particle", *(c.alias(f"e{k}") for k, c in tensor.rotate_tensor(r, *(F.col(f"e{k}") for k in tensor.SYM)).items())).orderBy("particle").collect()
    assert max(abs(x[f"e{k}"] - y[f"e{k}"]) for x, y in zip(a, b, strict=True) for k in tensor.SYM) < 1e-9


def test_eigen(spark):
    m = np.random.default_rng(2).normal(size=(40, 6))
    m[0] = [1, 0, 0, 1, 0, 1]
    df = spark.createDataFrame([tuple(map(float, x)) for x in m], [f"e{k}" for k in tensor.SYM])
    c = [F.col(f"e{k}") for k in tensor.SYM]
    for r in df.select("*", tensor.eigenvalues(*c).alias("v"), tensor.eigenvectors(*c).alias("u"), tensor.von_mises(*c).alias("vm")).collect():
        a = np.array([[r[0], r[1], r[2]], [r[1], r[3], r[4]], [r[2], r[4], r[5]]])
        assert r["v"] == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-8)
        u = np.array(r["u"]).reshape(3, 3)
        assert np.allclose(u @ a @ u.T, np.diag(r["v"]), atol=1e-7)


def test_eigenvectors_of_special_tensors(spark):
    """Double and triple roots give orthonormal axes, by descending eigenvalue; what is null or not finite gives null."""
    rows = [(1, 0, 0, 1, 0, 1), (0, 0, 0, 0, 0, 0), (2, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 3), (1, 1, 1, 1, 1, 1), (3, 0, 0, 2, 0, 1), (1e-9, 0, 0, 5e5, 0, 1), (float("nan"), 0, 0, 1, 0, 1), (float("inf"), 0, 0, 1, 0, 1)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in rows] + [(None, 0.0, 0.0, 1.0, 0.0, 1.0)], [f"e{k}" for k in tensor.SYM])
    found = df.select("*", tensor.eigenvectors(*(F.col(f"e{k}") for k in tensor.SYM)).alias("u")).collect()
    assert [r["u"] for r in found[7:]] == [None, None, None]
    for r in found[:7]:
        a = np.array([[r[0], r[1], r[2]], [r[1], r[3], r[4]], [r[2], r[4], r[5]]])
        u = np.array(r["u"]).reshape(3, 3)
        assert np.allclose(u @ u.T, np.eye(3), atol=1e-12)
        assert np.allclose(u @ a @ u.T, np.diag(np.linalg.eigvalsh(a)[::-1]), atol=1e-9 * max(1, abs(a).max()))


def test_polar_decomposition(spark):
    rng = np.random.default_rng(12)
    names = [f"f{a}{b}" for a in "xyz" for b in "xyz"]
    m = rng.normal(size=(60, 3, 3)) + np.eye(3)
    m[0], m[1], m[2] = np.eye(3), np.diag([1.0, 1.0, -1.0]), np.diag([1.0, 2.0, 0.0])
    m[3] = np.diag([1e3, 1.0, 1e-3])
    df = spark.createDataFrame([(i, *map(float, x.ravel())) for i, x in enumerate(m)] + [(99, *[None] * 9)], "i long, " + ", ".join(f"{n} double" for n in names))
    for r in tensor.with_polar(df).collect():
        f = m[r["i"]] if r["i"] < 99 else None
        if f is None or np.linalg.det(f) <= 0:
            assert r["angle"] is None and r["uxx"] is None and r["qzz"] is None
            continue
        w, s, v = np.linalg.svd(f)
        q = np.array([[r[f"q{a}{b}"] for b in "xyz"] for a in "xyz"])
        u = np.array([[r["u" + "".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
        assert np.allclose(q, w @ v, atol=1e-9) and np.allclose(u, v.T @ np.diag(s) @ v, atol=1e-9 * max(1, s[0]))
        assert np.cos(r["angle"]) == pytest.approx((np.trace(w @ v) - 1) / 2, abs=1e-6)


def test_cluster_strain_is_that_of_the_map(spark):
    """Members moved by one affine map: its strain, about the member nearest the centre; a pair, and a flat cluster, have none."""
    rng = np.random.default_rng(13)
    f = np.eye(3) + rng.normal(size=(3, 3)) * 0.05
    ref = rng.normal(size=(9, 3))
    rows = [(0, i, *(x for a, b in zip(p, f @ p + 2, strict=True) for x in (float(a), float(b)))) for i, p in enumerate(ref)]
    rows += [(0, 20 + i, float(i), float(i), 0.0, 0.0, 0.0, 0.0) for i in range(2)] + [(0, 30 + i, float(i), float(i), float(i * i), 0.0, 0.0, 0.0) for i in range(5)]
    both = spark.createDataFrame(rows, "frame long, id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    members = spark.createDataFrame([(0, r[1], 1 if r[1] < 20 else r[1] // 10) for r in rows], "frame long, id long, cluster long")
    got = {r["cluster"]: r for r in strain.cluster_strain(both, members, ["frame"]).collect()}
    e = (f + f.T) / 2 - np.eye(3)
    assert [got[1][f"e{k}"] for k in tensor.SYM] == pytest.approx([e[0, 0], e[0, 1], e[0, 2], e[1, 1], e[1, 2], e[2, 2]], abs=1e-9)
    assert got[1]["d2_min"] == pytest.approx(0, abs=1e-9) and got[2]["exx"] is None and got[3]["exx"] is None


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(4000).selectExpr("0L as frame", "id", "0.0D as x")
    a, b = ({(r["id"], r["replicate"]): r["x"] for r in resampling.resample(df.repartition(n), 2, {"x": 3.0}).collect()} for n in (1, 5))
    x = np.array([v for (_, k), v in a.items() if k > 0])
    assert a == b and abs(x.mean()) < 0.15 and x.std() == pytest.approx(3, rel=0.03) and all(v == 0 for (_, k), v in a.items() if k == 0)


def test_resampled_strain_has_the_spread_of_the_noise(spark):
    """Without noise there is no spread; with it the spread is in proportion."""
    ref = lattice(3)
    df, pairs = tracks(spark, ref, ref), spark.createDataFrame([(0, 1)], "ref long, cur long")
    spread = [np.mean([r["exx_std"] for r in strain.resampled_strain(df, pairs, 1.6, 12, {c: s for c in "xyz"}).collect()]) for s in (0.0, 0.002, 0.004)]
    assert spread[0] == pytest.approx(0, abs=1e-12) and spread[2] == pytest.approx(2 * spread[1], rel=0.05)


def test_radius_pairs_and_neighbours(spark):
    p = np.random.default_rng(3).uniform(-3, 3, (120, 3))
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "g long, id long, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert {(r["i"], r["j"]) for r in spatial.radius_pairs(df, 1.1, ["g"]).collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 1.1}
    got = {}
    for r in spatial.nearest(df, 5, 0.4, ["g"]).collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    assert all([got[i][k] for k in range(1, 6)] == np.argsort(d[i], kind="stable")[1:6].tolist() for i in range(120))


def test_nearest_far_points_and_null_coordinates(spark):
    rows = [(0, 1, 0.0), (0, 2, 1.0), (0, 3, 5000.0), (0, 4, None), (0, 5, float("nan")), (1, 1, 0.0), (1, 2, 1e6), (1, 3, 1e6 + 1)]
    df = spark.createDataFrame([(g, i, x, 0.0, 0.0) for g, i, x in rows], "g long, id long, x double, y double, z double")
    got = {(r["g"], r["i"], r["rank"]): r["j"] for r in spatial.nearest(df, 3, 0.4, ["g"]).collect()}
    assert got == {(0, 1, 1): 2, (0, 1, 2): 3, (0, 2, 1): 1, (0, 2, 2): 3, (0, 3, 1): 2, (0, 3, 2): 1, (1, 1, 1): 2, (1, 1, 2): 3, (1, 2, 1): 3, (1, 2, 2): 1, (1, 3, 1): 2, (1, 3, 2): 1}


def test_resolve_doubles_rule(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.3), (0, 2, 0.1, 0.0, 0.0, 0.2), (0, 3, 0.2, 0.0, 0.0, 0.1), (0, 4, 5.0, 0.0, 0.0, 0.2), (0, 5, 5.1, 0.0, 0.0, 0.2), (0, 6, 9.0, 0.0, 0.0, None), (0, 7, 9.1, 0.0, 0.0, 0.9)], "g long, id long, x double, y double, z double, error double")
    assert {r["id"] for r in spatial.resolve_doubles(df, 0.11, ["g"]).where("keep").collect()} == {3, 5, 7}


def test_plane_and_lines(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 200, (150, 2))
    z = 0.02 * xy[:, 0] - 0.01 * xy[:, 1] + 7 + rng.normal(size=150)
    df = spark.createDataFrame([(0, i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z, strict=True))], "frame long, id long, x double, y double, z double")
    design = np.column_stack([xy, np.ones(150)])
    want, rest, _, s = np.linalg.lstsq(design, z, rcond=None)
    got = fits.plane_fit(df, ["frame"]).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(want, abs=1e-9) and got["residual"] == pytest.approx(rest[0]) and list(got["s"]) == pytest.approx(s, rel=1e-6)
    slopes = sorted((z[j] - z[i]) / (xy[j, 0] - xy[i, 0]) for i in range(150) for j in range(i + 1, 150))
    ts = fits.theil_sen(df, "x", "z", "id", ["frame"]).first()
    assert ts["m"] == pytest.approx(np.median(slopes)) and ts["ci_lo"] < ts["m"] < ts["ci_hi"]
    assert fits.t_quantile(10) == pytest.approx(2.228139, abs=1e-5)


def test_linking_follows_walkers(spark):
    rng = np.random.default_rng(5)
    rows, truth, at = [], {}, rng.uniform(0, 40, (25, 3))
    for f in range(6):
        at = at + rng.normal(scale=0.2, size=at.shape)
        for k, p in enumerate(at):
            if not (k == 3 and f >= 3) and not (k == 7 and f < 2):
                rows.append((f, len(rows), *map(float, p), "sed"))
                truth[rows[-1][1]] = k
    df = spark.createDataFrame(rows, "frame long, id long, x double, y double, z double, material string")
    for got in (linking.link(df, 2.0).collect(), linking.link_with_memory(df, 2.0, 1).collect()):
        group = {}
        for r in got:
            group.setdefault(r["particle"], set()).add(truth[r["id"]])
        assert len(got) == len(rows) and len(group) == 25 and all(len(x) == 1 for x in group.values())


def test_memory_bridges_a_gap_within_a_material(spark):
    """A particle that is unseen for a frame goes on; another material's at the same place does not."""
    rows = [(0, 1, 0.0, "gel"), (1, 2, 0.1, "gel"), (3, 3, 0.3, "gel"), (3, 4, 0.3, "sed"), (6, 5, 0.4, "gel")]
    df = spark.createDataFrame([(f, i, x, 0.0, 0.0, m) for f, i, x, m in rows], "frame long, id long, x double, y double, z double, material string")
    got = {r["id"]: r["particle"] for r in linking.link_with_memory(df, 1.0, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_assignment_is_least():
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(30):
        c = rng.uniform(size=(4, 6))
        got = linking.assign(c)
        assert c[np.arange(4), got].sum() == pytest.approx(min(c[np.arange(4), list(p)].sum() for p in itertools.permutations(range(6), 4)))


def test_array_kernels():
    a = np.zeros((20, 20, 20))
    spots = [(5, 5, 5), (14, 6, 12), (8, 15, 9)]
    for s in spots:
        a[s] = 500
    a = volume.gaussian(a, 1.3)
    assert a.sum() == pytest.approx(1500)
    found = volume.locate_rounds(a, (3.0, 3.0, 3.0), quantile=0.9)
    assert all(min(np.linalg.norm(found[:, :3] - s, axis=1)) < 0.3 for s in map(np.array, spots))
    flat = np.full((3, 9, 9), 4.0)
    for kind in ("tv", "mean", "gaussian", "bernstein"):
        assert np.allclose(volume.curvature_filter(flat, kind), flat)
    assert volume.rescale_xy(flat, 2).shape == (3, 18, 18) and np.allclose(volume.rescale_xy(flat, 2), 4)
    assert np.allclose(volume.local_threshold(flat, 4), 0) and np.allclose(volume.band_pass(flat, (1, 1, 1), (2, 2, 2)), 0, atol=1e-9)
    k = np.exp(-0.5 * ((np.arange(64) - 32) / 2.0) ** 2)
    k /= k.sum()
    signal = np.zeros(64)
    signal[[20, 40]] = 1
    blurred = np.real(np.fft.ifft(np.fft.fft(signal) * np.fft.fft(np.fft.ifftshift(k))))
    back = clusters.wiener_deconvolve(blurred, k, 1e6)
    assert set(np.argsort(back)[-2:]) == {20, 40}


def test_fence_filters_follow_each_other(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)] + [(1e6, 3.0), (5.0, 1e6)], "x double, y double")
    assert quality.tukey_filter(df, ["x", "y"]).count() == 50


def test_sources(spark, tmp_path):
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles/hv00012_sed_t0003.csv").write_text("z y x mass raw_mass size_x size_y size_z\n1 2 3 4 5 6 7 8\n")
    assert tuple(tables.tile_csv(spark, str(tmp_path / "tiles")).first())[-3:] == (12, "sed", 3)
    (tmp_path / "ids.txt").write_text("header\nid\n 4\n9\n")
    assert [r["particle"] for r in tables.id_list(spark, str(tmp_path / "ids.txt"), "upper").collect()] == [4, 9]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.yml").write_text("hv: 3\nlocating: {particles: 20}\n")
    (tmp_path / "log/b.yml").write_text("hv: 4\n")
    assert sorted(map(tuple, tables.yaml_counts(spark, str(tmp_path / "log")).collect())) == [(3, 20), (4, -1)]
    (tmp_path / "r.xml").write_text('<run><point><stress unit="Pa">2.5</stress></point><point><stress unit="Pa">3</stress></point></run>')
    assert sorted(r[0]["_VALUE"] for r in tables.rheology_xml(spark, str(tmp_path / "r.xml"), "point").collect()) == [2.5, 3.0]
    t = spark.createDataFrame([(0, 2, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "frame long, particle long, x double")
    tables.write_xyz(t, str(tmp_path / "xyz"), ["particle", "x"])
    lines = "".join(p.read_text() for p in (tmp_path / "xyz/frame=0").glob("*.txt")).splitlines()
    assert lines == ["2", "Properties=particle:R:1:x:R:1", "1 2.0", "2 1.0"]
    for e in (0.1, 0.2):
        s = spark.createDataFrame([("fl", 0, 1 if e < 0.15 else 2, 0, e)], "strain_type string, ref int, cur int, replicate int, exx double")
        tables.write_strain(s, str(tmp_path / "strain"))
    assert tables.read_strain(spark, str(tmp_path / "strain")).count() == 2 and tables.read_strain(spark, str(tmp_path / "strain"), cur=2).first()["exx"] == 0.2


def test_stream_averages(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    q = stream.stage_averages(stream.frame_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("averages").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from averages").first()[0] == src.count()


def test_inclusion_field_at_points_worked_by_hand(spark):
    """Radius 2, strain 0.1, Poisson ratio 1/3: constant inside, and the far field on each axis (c = 3/28, e0 = 7/150)."""
    g = spark.createDataFrame([(0.5, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 4.0), (0.0, 3.0, 3.0)], "x double, y double, z double")
    got = [r["field"] for r in clusters.inclusion_field(g, 2.0, 0.1).collect()]
    c, e0 = 3 / 28, 7 / 150
    assert got[0] == pytest.approx(e0)
    # on the x axis only the fourth and sixth powers of x remain
    assert got[1] == pytest.approx(8 * e0 / 4 / 4**9 * (6 * 4 * c * 4 * 4**4 + 4 * (1 - 6 * c) * 4**6))
    # on the y and z axes cos 4t = 1
    axis = 8 * e0 / 4 / 4**9 * (36 * c * 4**4 - (2 + 3 * c) * 4**6 + 15 * c * 4**4 * (5 * 16 - 28))
    assert got[2] == pytest.approx(axis) and got[3] == pytest.approx(axis)
    # at 45 degrees cos 4t = -1
    h = math.sqrt(18)
    assert got[4] == pytest.approx(8 * e0 / 4 / h**9 * (36 * c * h**4 - (2 + 3 * c) * h**6 - 15 * c * h**4 * (5 * h**2 - 28)))


def test_t_quantiles_and_bounds_of_few_points(spark):
    #: Published two-sided 95 % values.
    for df, t in ((1, 12.7062047), (2, 4.30265273), (3, 3.18244631), (10, 2.22813885), (30, 2.04227246), (100, 1.98397152)):
        assert fits.t_quantile(df) == pytest.approx(t, rel=1e-7)
    rows = spark.createDataFrame([(1, float(x), y) for x, y in enumerate([1.0, 3.1, 4.9, 7.2, 8.8])] + [(2, 0.0, 1.0), (2, 1.0, 2.0)], "g int, x double, y double")
    one, two = fits.line_fit(rows, "x", "y", ["g"]).orderBy("g").collect()
    se = math.sqrt(sum((y - one["b"] - one["m"] * x) ** 2 for x, y in enumerate([1.0, 3.1, 4.9, 7.2, 8.8])) / 3 / 10)
    assert one["se_m"] == pytest.approx(se) and one["ci_hi"] - one["m"] == pytest.approx(3.18244631 * se) and one["b_hi"] - one["b"] == pytest.approx(3.18244631 * se * math.sqrt(6))
    assert two["ci_lo"] is None and two["m"] == pytest.approx(1)
    far = spark.range(1).select(*(fits.t_column(F.lit(k)).alias(f"t{k}") for k in (101, 500))).first()
    assert far[0] == pytest.approx(fits.t_quantile(101), abs=1e-9) and far[1] == pytest.approx(fits.t_quantile(500), abs=1e-9)


def test_curvature_stencils_on_a_textured_image():
    """Each pixel of each set moves by the smallest of its tangent estimates, found here neighbour by neighbour."""
    image = np.random.default_rng(3).normal(size=(9, 8))

    def estimates(u, i, j, kind):
        v = lambda dy, dx: u[i + dy, j + dx]
        n, s, w, e, nw, ne, sw, se = v(-1, 0), v(1, 0), v(0, -1), v(0, 1), v(-1, -1), v(-1, 1), v(1, -1), v(1, 1)
        if kind == "tv":
            return [(n + s + w + nw + sw) / 5, (n + s + e + ne + se) / 5, (w + e + nw + n + ne) / 5, (w + e + sw + s + se) / 5, (nw + n + ne + w + sw) / 5, (nw + n + ne + e + se) / 5, (sw + s + se + e + ne) / 5, (sw + s + se + w + nw) / 5]
        if kind == "mean":
            return [(2.5 * (n + s) + 5 * e - ne - se) / 8, (2.5 * (n + s) + 5 * w - nw - sw) / 8, (2.5 * (w + e) + 5 * n - nw - ne) / 8, (2.5 * (w + e) + 5 * s - sw - se) / 8]
        return [(n + s) / 2, (w + e) / 2, (nw + se) / 2, (sw + ne) / 2, (n + nw + w) / 3, (n + ne + e) / 3, (sw + w + s) / 3, (e + se + s) / 3]

    for kind in ("tv", "mean", "gaussian"):
        want = image.copy()
        for y, x in ((1, 1), (2, 1), (1, 2), (2, 2)):
            old = want.copy()
            for i in range(y, 8, 2):
                for j in range(x, 7, 2):
                    want[i, j] = min(estimates(old, i, j, kind), key=lambda t: abs(t - old[i, j]))
        assert np.allclose(volume.curvature_filter(image[None], kind, 1)[0], want)
        flat = np.add.outer(np.arange(9.0), 2 * np.arange(8.0))  # a plane is its own tangent
        assert kind != "gaussian" or np.allclose(volume.curvature_filter(flat[None], kind, 3)[0], flat)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
