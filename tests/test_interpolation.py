"""Linear interpolation against a brute-force triangulation: all fours of points whose sphere is empty."""

import itertools

import numpy as np
import pytest

from granulon.operators.interpolation import linear_interpolation

SCHEMA = "frame long, id long, x double, y double, z double"


def table(spark, at, values=None, frame=0):
    rows = [(frame, k, *map(float, p)) + (() if values is None else (float(values[k]),)) for k, p in enumerate(at)]
    return spark.createDataFrame(rows, SCHEMA + ("" if values is None else ", v double"))


def brute(points, values, places, reach):
    """Value at each place by the tetrahedra whose circumsphere holds no point; nan where the sphere leaves the ball of reach about the place."""
    out = np.full(len(places), np.nan)
    for four in itertools.combinations(range(len(points)), 4):
        p = points[list(four)]
        edges = 2 * (p[1:] - p[0])
        if abs(np.linalg.det(edges)) < 1e-9:
            continue
        centre = np.linalg.solve(edges, (p[1:] ** 2).sum(1) - (p[0] ** 2).sum())
        radius = np.linalg.norm(centre - p[0])
        if (np.linalg.norm(points - centre, axis=1) < radius - 1e-9).any():
            continue
        w = np.linalg.solve(np.vstack([p.T, np.ones(4)]), np.vstack([places.T, np.ones(len(places))])).T
        inside = (w >= -1e-12).all(1) & (np.linalg.norm(places - centre, axis=1) + radius <= reach)
        out[inside] = w[inside] @ values[list(four)]
    return out


@pytest.mark.parametrize("reach", [4.0, 7.0, 60.0])
def test_equals_brute_force_triangulation(spark, reach):
    rng = np.random.default_rng(int(reach))
    points, places = rng.uniform(0, 10, (45, 3)), rng.uniform(1, 9, (60, 3))
    values = np.sin(points).sum(1)
    got = linear_interpolation(table(spark, places), table(spark, points, values), "v", reach, ["frame"], cells=500).collect()
    got = np.array([np.nan if r["v"] is None else r["v"] for r in sorted(got, key=lambda r: r["i"])])
    want = brute(points, values, places, reach)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, equal_nan=True)
    assert np.isfinite(got).sum() > {4.0: 0, 7.0: 20, 60.0: 35}[reach]


def test_linear_fields_come_back_and_points_keep_their_value(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.uniform(0, 10, (300, 3)), np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3)])
    plane = lambda p: 1 + 2 * p[:, 0] - p[:, 1] + 0.5 * p[:, 2]
    places = np.concatenate([points[:50], rng.uniform(0, 10, (100, 3)), points[300:] + 0.5])
    got = {r["i"]: r["v"] for r in linear_interpolation(table(spark, places), table(spark, points, plane(points)), "v", 6.0, ["frame"]).collect()}
    assert all(got[k] is not None for k in range(50)) and sum(v is not None for v in got.values()) > 150
    assert all(v is None or v == pytest.approx(plane(places[k : k + 1])[0]) for k, v in got.items())


def test_nulls_repeats_groups_and_empty_tables(spark):
    corners = [(0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4)]
    points = table(spark, corners, [0, 4, 4, 4])
    odd = spark.createDataFrame([(0, 9, 0.0, 0.0, 0.0, 99.0), (0, 10, 1.0, 1.0, 1.0, None), (0, 11, None, 1.0, 1.0, 5.0), (0, 12, float("nan"), 1.0, 1.0, 5.0), (None, 13, 1.0, 1.0, 1.0, 7.0)], points.schema)
    places = spark.createDataFrame([(0, 1, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0), (0, 2, -0.0, 0.0, 0.0), (0, 3, None, 1.0, 1.0), (0, 4, 9.0, 9.0, 9.0), (1, 1, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)], SCHEMA)
    got = sorted(((r["frame"], r["i"], r["v"]) for r in linear_interpolation(places, points.unionAll(odd), "v", 20.0, ["frame"]).collect()), key=str)
    want = sorted([(0, 1, 3.0), (0, 1, 3.0), (0, 2, 0.0), (0, 3, None), (0, 4, None), (1, 1, None), (None, 1, None)], key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or g[2] == pytest.approx(w[2])) for g, w in zip(got, want, strict=True))
    assert linear_interpolation(places.limit(0), points, "v", 2.0, ["frame"]).count() == 0
    assert [r["v"] for r in linear_interpolation(places, points.limit(0), "v", 2.0, ["frame"]).collect()] == [None] * 7
    # coplanar and few points have no simplex
    assert linear_interpolation(places, points.where("id < 3"), "v", 20.0, ["frame"]).where("v is not null and i <> 2").count() == 0


def test_query_gives_its_linear_field(spark):
    """The query's values are those of the field at its places, wherever they are not null."""
    from granulon.plans import adapters, catalogue

    sf = "/root/testdata/sf0.001"
    places = {(r["frame"], r["id"]): r["x"] + 2 * r["y"] - r["z"] for r in catalogue._beside(adapters.points(spark, sf)).collect()}
    got = {(r["frame"], r["i"]): r["v"] for r in catalogue.queries()["linear_interpolation"](spark, sf).collect()}
    assert got.keys() == places.keys() and sum(v is not None for v in got.values()) > len(got) / 20
    assert all(v is None or v == pytest.approx(places[k], abs=1e-6) for k, v in got.items())


def test_dense_points_are_not_all_looked_at(spark, monkeypatch):
    """A quarter of the reach holds some 800 points about a place; the first radius must hold few, and the values are those of long radii."""
    from granulon.operators import interpolation

    rng, radii = np.random.default_rng(12), []
    points, places = rng.uniform(0, 1, (6000, 3)), rng.uniform(0.4, 0.6, (50, 3))
    join = interpolation.radius_join
    monkeypatch.setattr(interpolation, "radius_join", lambda a, b, r, *rest: radii.append(r) or join(a, b, r, *rest))
    values = rng.normal(size=len(points))
    run = lambda: {r["i"]: r["v"] for r in linear_interpolation(table(spark, places), table(spark, points, values), "v", 1.5, ["frame"]).collect()}
    got = run()
    assert len(points) * radii[0] ** 3 <= 64 and radii[-1] == 1.5
    monkeypatch.setattr(interpolation, "_densest", lambda *_: 0)
    want = run()
    assert len(got) == 50 and None not in got.values() and got == pytest.approx(want)
