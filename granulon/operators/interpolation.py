"""Linear interpolation of scattered values in space, by the Delaunay simplex about each place.

The simplex about a place q is the least-cost way to write q as a mean of points, sum w p = q with sum w = 1 and w >= 0, where a point costs its
squared distance; the same weights interpolate. So no triangulation is built: every place solves a program of four equations over the points near
it, and the sphere about its four points tells whether points farther off could change it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators.lineage import checkpointed
from granulon.operators.spatial import radius_join

#: Corners far outside the unit ball that hold every place until points do, and what one costs: more than any simplex within the ball can need.
FAR = 8.0 * np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]]) / np.sqrt(3)
PRICE = 100.0


def simplex_mean(p: np.ndarray, v: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Value at the origin of many small sets at once: points p (sets, points, 3) in the unit ball, values v, and which of them are points.

    NaN where the simplex about the origin has its sphere not wholly in the unit ball, or where there is none.
    """
    sets, most = usable.shape
    column = np.concatenate([np.concatenate([p, np.ones((sets, most, 1))], 2), np.broadcast_to(np.hstack([FAR, np.ones((4, 1))]), (sets, 4, 4))], 1)
    cost = np.concatenate([np.where(usable, (p**2).sum(2), np.inf), np.full((sets, 4), PRICE)], 1)
    basis, every = np.tile(np.arange(most, most + 4), (sets, 1)), np.arange(sets)
    target, open_, turn = np.array([0.0, 0.0, 0.0, 1.0]), every, 0
    weight, dual = np.full((sets, 4), 0.25), np.zeros((sets, 4))
    while len(open_):
        b = column[open_[:, None], basis[open_]].transpose(0, 2, 1)
        weight[open_] = np.linalg.solve(b, np.broadcast_to(target[:, None], (len(open_), 4, 1)))[..., 0]
        dual[open_] = np.linalg.solve(b.transpose(0, 2, 1), cost[open_[:, None], basis[open_]][..., None])[..., 0]
        gain = cost[open_] - np.einsum("sij,sj->si", column[open_], dual[open_])
        # the greatest gain; the first one if many turns have gone, which cannot go round in circles
        enter = gain.argmin(1) if turn < 100 else (gain < -1e-11).argmax(1)
        going = gain[np.arange(len(open_)), enter] < -1e-11
        open_, enter, b = open_[going], enter[going], b[going]
        if not len(open_):
            break
        step = np.linalg.solve(b, column[open_, enter][..., None])[..., 0]
        ratio = np.where(step > 1e-12, np.maximum(weight[open_], 0) / np.where(step > 1e-12, step, 1), np.inf)
        leave = ratio.argmin(1)
        if turn >= 100:  # among ties the first in the order of columns
            ties = ratio <= ratio.min(1, keepdims=True) + 1e-15
            leave = np.where(ties, basis[open_], np.iinfo(int).max).argmin(1)
        basis[open_, leave] = enter
        turn += 1
    real = (basis < most).all(1)
    centre = dual[:, :3] / 2
    reach = np.linalg.norm(centre, axis=1) + np.sqrt(np.maximum(dual[:, 3] + (centre**2).sum(1), 0))
    value = (weight * np.take_along_axis(np.concatenate([v, np.zeros((sets, 4))], 1), basis, 1)).sum(1)
    value = np.where(real & (reach <= 1 + 1e-9), value, np.nan)
    # at a point itself the value is the point's, whatever lies around
    here = usable & ((p**2).sum(2) == 0)
    return np.where(here.any(1), v[every, here.argmax(1)], value)


def _densest(points: DataFrame, r: float, by: list[str]) -> int:
    """Points in the fullest cell of side r."""
    cell = [F.floor(F.col(c) / r).alias(f"_{c}") for c in "xyz"]
    return points.groupBy(*by, *cell).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def linear_interpolation(grid: DataFrame, points: DataFrame, value: str, reach: float, by: list[str], cells: int = 1_000_000, dense: int = 64) -> DataFrame:
    """(by..., i, value): linear interpolation of the points' values at each place of a grid (by..., id, x, y, z), in the Delaunay simplex about it.

    A simplex counts if the sphere through its corners lies wholly within ``reach`` of the place: then no point elsewhere can be inside it, so the
    result is that of a triangulation of all points. Elsewhere (outside the hull, in gaps, in the thin simplices of the hull with vast spheres) the
    value is null; a longer reach fills more. Shorter radii come first, from one whose fullest cell has at most ``dense`` points, which changes no
    value. A task holds the points within reach of some places at a time (``cells`` of them), never a group.
    Of points in one place the smallest id counts; points without a value or a finite place are none; places without a finite place get null;
    repeated ids of places are one row each. Where more than four points lie on one empty sphere, the choice among them is by order of id.
    """
    finite = " and ".join(f"abs({c}) < double('inf')" for c in "xyz")
    known = points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).where(finite)
    known = known.groupBy(*by, "x", "y", "z").agg(F.min(F.struct(F.col("id"), F.col(value).cast("double").alias("v"))).alias("_p"))
    grid = grid.select(*by, "id", *((F.col(c) + 0.0).alias(c) for c in "xyz"))  # one zero, not two
    places = grid.where(finite).distinct().withColumn("_q", F.struct("id", "x", "y", "z"))

    def solve(batches):
        for pdf in batches:
            size = pdf["v"].str.len().to_numpy()
            order, start = np.argsort(size, kind="stable"), 0
            while start < len(order):
                stop = start + 1
                while stop < len(order) and (stop + 1 - start) * size[order[stop]] <= cells:
                    stop += 1
                part, most = pdf.iloc[order[start:stop]], size[order[stop - 1]]
                p, v, usable = np.zeros((len(part), most, 3)), np.zeros((len(part), most)), np.arange(most) < size[order[start:stop], None]
                v[usable] = np.concatenate(part["v"].to_numpy())
                for k, c in enumerate(("dx", "dy", "dz")):
                    p[..., k][usable] = np.concatenate(part[c].to_numpy()) / part["_r"].iloc[0]
                got = simplex_mean(p, v, usable)
                yield part[[*by, "_i"]].assign(**{value: pd.Series(got, index=part.index)})
                start = stop

    kinds = ", ".join(f"`{c}` {grid.schema[c].dataType.simpleString()}" for c in by)
    # most places are settled by points much nearer than reach; the others look farther. The first radius has few points even where they are
    # densest, and a place that goes on has few within the radius before, so what a place looks at does not grow with the table
    found, todo, known = None, checkpointed(places.withColumn("_i", F.to_json("_q"))), checkpointed(known)
    radii = [reach, reach / 2, reach / 4]
    while len(radii) < 20 and _densest(known, radii[-1], by) > dense:
        radii.append(radii[-1] / 2)
    for radius in reversed(radii):
        near = radius_join(todo, known, radius, by, "_i", "_p").groupBy(*by, F.col("i").alias("_i")).agg(F.sort_array(F.collect_list(F.struct(F.col("j.id").alias("id"), F.col("j.v").alias("v"), "dx", "dy", "dz"))).alias("near"))
        got = near.select(*by, "_i", F.lit(radius).alias("_r"), *(F.col(f"near.{c}").alias(c) for c in ("v", "dx", "dy", "dz"))).mapInPandas(solve, f"{kinds + ', ' if by else ''}_i string, `{value}` double")
        got = checkpointed(got.where(F.col(value).isNotNull() & ~F.isnan(value)))  # Arrow makes nulls of NaN
        found = got if found is None else found.unionAll(got)
        todo = todo.join(got, [*by, "_i"], "left_anti")
    every = grid.withColumn("_i", F.to_json(F.struct("id", "x", "y", "z")))
    return every.join(found, [*by, "_i"], "left").select(*by, F.col("id").alias("i"), value)
