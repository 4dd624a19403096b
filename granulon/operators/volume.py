"""Image volumes: voxel tables for what SQL expresses, and numpy kernels on one block at a time.

A block is a row (hv, z0, y0, x0, nz, ny, nx, dtype, data); kernels see one block, whose size the tiling bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "hv long, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"


def as_array(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["nz"], row["ny"], row["nx"])


def map_blocks(blocks: DataFrame, f) -> DataFrame:
    """Apply an array function to each block; it may change type and shape."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = np.ascontiguousarray(f(as_array(row)))
                out.append(row | {"nz": a.shape[0], "ny": a.shape[1], "nx": a.shape[2], "dtype": a.dtype.name, "data": a.tobytes()})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return blocks.mapInPandas(run, BLOCK)


def voxels(blocks: DataFrame) -> DataFrame:
    """(hv, z, y, x, v), with places in the whole volume; a slice of z at a time."""

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y, x = np.indices((row["ny"], row["nx"])).reshape(2, -1)
                for z, plane in enumerate(as_array(row)):
                    yield pd.DataFrame({"hv": row["hv"], "z": z + row["z0"], "y": y + row["y0"], "x": x + row["x0"], "v": plane.reshape(-1).astype(float)})

    return blocks.mapInPandas(run, "hv long, z int, y int, x int, v double")


def quilt(voxel: DataFrame) -> DataFrame:
    """Mean and count of overlapping tiles at each place."""
    return voxel.groupBy("z", "y", "x").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def z_profile(voxel: DataFrame) -> DataFrame:
    """Mean by z and its central difference (one-sided at the ends)."""
    w = W.orderBy("z")
    p = voxel.groupBy("z").agg(F.avg("v").alias("mean"))
    lo, hi = F.lag("mean").over(w), F.lead("mean").over(w)
    return p.withColumn("gradient", F.when(lo.isNull(), hi - F.col("mean")).when(hi.isNull(), F.col("mean") - lo).otherwise((hi - lo) / 2))


def max_entropy_threshold(histogram: DataFrame, by: list[str]) -> DataFrame:
    """From (by..., level, n): the level that maximises the summed entropies of both sides, ties to the lowest."""
    w = W.partitionBy(*by).orderBy("level")
    upto, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    h = histogram.where("n > 0").withColumn("p", F.col("n") / F.sum("n").over(whole))
    h = h.withColumns({"c": F.sum("p").over(upto), "s": F.sum(F.expr("p * ln(p)")).over(upto), "all": F.sum(F.expr("p * ln(p)")).over(whole)})
    h = h.withColumn("entropy", F.expr("case when c < 1 - 1e-12 then ln(c) - s / c + ln(1 - c) - (all - s) / (1 - c) end")).where("entropy is not null")
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("entropy", 9)), "level"))
    return h.withColumn("_r", best).where("_r = 1").select(*by, F.col("level").alias("threshold"), "entropy")


def recast(rows: DataFrame, column: str, bits: int, by: list[str]) -> DataFrame:
    """0.99 of the least to 1.01 of the greatest value of each group, onto 0 to 2^bits - 1, half to even."""
    ends = rows.groupBy(*by).agg((0.99 * F.min(column)).alias("_a"), (1.01 * F.max(column)).alias("_b"))
    return rows.join(ends, by).withColumn("level", F.rint((F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a")) * (2**bits - 1)).cast("long")).drop("_a", "_b")


def saturate(column, low: float, high: float):
    """A linear map onto 0 to 1 that stays at its ends."""
    return F.least(F.greatest((column - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def master_dark(stacks: DataFrame) -> DataFrame:
    """From (y, x, mean, n_slices): the mean by pixel, weighted by slices."""
    return stacks.groupBy("y", "x").agg((F.sum(F.col("mean") * F.col("n_slices")) / F.sum("n_slices")).alias("dark"))


def flat_field(raw: np.ndarray, dark: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """(raw - dark) * mean(flat - dark) / (flat - dark), clipped to its 0.01 and 99.99 percentiles, as uint16."""
    gain = np.maximum(flat.astype(float) - dark, 1e-9)
    out = (raw - dark) * gain.mean() / gain
    lo, hi = np.percentile(out, [0.01, 99.99])
    return np.rint((np.clip(out, lo, hi) - lo) / max(hi - lo, 1e-9) * 65535).astype(np.uint16)


def gaussian(a: np.ndarray, sigma: float | tuple) -> np.ndarray:
    """Separable blur with mirrored edges."""
    out = a.astype(float)
    for axis, s in enumerate(sigma if isinstance(sigma, tuple) else (sigma,) * a.ndim):
        if s > 0:
            m = int(4 * s + 0.5)
            k = np.exp(-0.5 * (np.arange(-m, m + 1) / s) ** 2)
            pad = np.pad(out, [(m, m) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
            out = np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), axis, pad)  # noqa: B023
    return out


def local_threshold(a: np.ndarray, size: int, quantile: float = 0.5) -> np.ndarray:
    """Each cell's quantile, interpolated linearly between cell centres, subtracted; below it 0."""
    surface = a.astype(float)
    for axis in range(a.ndim):
        n = max(1, math.ceil(surface.shape[axis] / size))
        parts = [np.quantile(x, quantile, axis=axis) for x in np.array_split(surface, n, axis=axis)]
        centre = [x.mean() for x in np.array_split(np.arange(surface.shape[axis]), n)]
        grid = np.stack(parts, axis=-1).reshape(-1, n)
        line = np.stack([np.interp(np.arange(a.shape[axis]), centre, g) for g in grid])
        surface = np.moveaxis(line.reshape(*[s for i, s in enumerate(surface.shape) if i != axis], a.shape[axis]), -1, axis)
    return np.maximum(a - surface, 0)


#: Places (y, x) of the eight neighbours, clockwise from above.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def tangent_stencils(kind: str) -> list[dict[tuple[int, int], float]]:
    """Weights by neighbour of the tangent estimates of a pixel, in the order in which the first of equally near ones is taken.

    tv: the mean of each half ring (five neighbours in a row); mean: one side at 5/8, the two across at 5/16, its two corners at -1/8;
    gaussian: the means of opposite neighbours and of each corner with its two sides; bernstein: the means of opposite sides.
    """
    n, ne, e, se, s, sw, w, nw = range(8)
    arc = lambda k, reach: [(k + d) % 8 for d in range(-reach, reach + 1)]
    even = lambda places: {RING[k]: 1 / len(places) for k in places}
    if kind == "tv":
        return [even(arc(k, 2)) for k in (w, e, n, s, nw, ne, se, sw)]
    if kind == "mean":
        return [{RING[k]: 5 / 8, RING[k - 2]: 5 / 16, RING[(k + 2) % 8]: 5 / 16, RING[k - 1]: -1 / 8, RING[(k + 1) % 8]: -1 / 8} for k in (e, w, n, s)]
    sides = [even([n, s]), even([w, e])]
    if kind == "bernstein":
        return sides
    if kind == "gaussian":
        return sides + [even([nw, se]), even([sw, ne])] + [even(arc(k, 1)) for k in (nw, ne, sw, se)]
    raise ValueError(kind)


def curvature_filter(a: np.ndarray, kind: str = "gaussian", steps: int = 10) -> np.ndarray:
    """Each z slice moves to its nearest tangent estimate, one of four interleaved pixel sets at a time; the border of one pixel stays."""
    out = a.astype(float)
    stencils = tangent_stencils(kind)
    for u in out:
        for _ in range(steps):
            for y, x in ((1, 1), (2, 1), (1, 2), (2, 2)):
                at = lambda dy, dx: u[y + dy : u.shape[0] - 1 + dy : 2, x + dx : u.shape[1] - 1 + dx : 2]  # noqa: B023, E731
                moves = np.stack([sum(v * at(*k) for k, v in stencil.items()) for stencil in stencils]) - at(0, 0)
                if moves.size:
                    at(0, 0)[...] += np.take_along_axis(moves, np.abs(moves).argmin(0)[None], 0)[0]
    return out


def rescale_xy(a: np.ndarray, factor: int) -> np.ndarray:
    """Larger in y and x by a whole factor, by cubic interpolation with edge values held."""
    out = a.astype(float)
    for axis in (1, 2):
        n = out.shape[axis]
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        i, t = np.floor(at).astype(int), at - np.floor(at)
        w = [-0.5 * t**3 + t**2 - 0.5 * t, 1.5 * t**3 - 2.5 * t**2 + 1, -1.5 * t**3 + 2 * t**2 + 0.5 * t, 0.5 * t**3 - 0.5 * t**2]
        shape = [-1 if k == axis else 1 for k in range(3)]
        out = sum(np.take(out, np.clip(i + k - 1, 0, n - 1), axis) * w[k].reshape(shape) for k in range(4))
    return out


def band_pass(a: np.ndarray, noise: tuple, size: tuple) -> np.ndarray:
    """Blur at the noise scale less a box mean at the feature scale, at least 0."""
    box = a.astype(float)
    for axis, n in enumerate(size):
        n = 2 * int(n) + 1
        pad = np.pad(box, [(n // 2, n // 2) if i == axis else (0, 0) for i in range(3)], mode="edge")
        box = np.apply_along_axis(lambda v: np.convolve(v, np.ones(n) / n, "valid"), axis, pad)  # noqa: B023
    return np.maximum(gaussian(a, noise) - box, 0)


def ellipsoid(radius: tuple) -> np.ndarray:
    """Offsets (dz, dy, dx) inside an ellipsoid."""
    r = [int(math.floor(x)) for x in radius]
    grid = np.stack(np.meshgrid(*(np.arange(-k, k + 1) for k in r), indexing="ij"), axis=-1).reshape(-1, 3)
    return grid[((grid / np.array(radius)) ** 2).sum(1) <= 1]


def locate(a: np.ndarray, radius: tuple, quantile: float = 0.7, separation: float | None = None, refine: int = 10) -> np.ndarray:
    """Bright local maxima over a quantile, brightest first with a least separation, refined to centroids of mass in the mask.

    Rows are z, y, x, mass, radius of gyration, peak.
    """
    a, off = a.astype(float), ellipsoid(radius)
    r = np.abs(off).max(0)
    pad = np.pad(a, [(k, k) for k in r])
    place = np.argwhere(a > np.quantile(a, quantile))
    around = pad[tuple((place[:, None, :] + r + off).transpose(2, 0, 1))]
    value = a[tuple(place.T)]
    place, value = place[value >= around.max(1)], value[value >= around.max(1)]
    # the brightest first; what is kept lies in cells as wide as the separation, so only the cells around are looked at
    apart = separation or 2 * min(radius)
    kept: list[np.ndarray] = []
    cells: dict[tuple, list[np.ndarray]] = {}
    for k in np.argsort(-value, kind="stable"):
        p, cell = place[k], tuple((place[k] // apart).astype(int))
        near = (q for step in np.ndindex(3, 3, 3) for q in cells.get(tuple(c + d - 1 for c, d in zip(cell, step, strict=True)), ()))
        if all(((p - q) ** 2).sum() >= apart * apart for q in near):
            kept.append(p)
            cells.setdefault(cell, []).append(p)
    out = []
    for c in kept:
        for _ in range(refine):
            w = pad[tuple((c + r + off).T)]
            if w.sum() <= 0:
                break
            shift = (off * w[:, None]).sum(0) / w.sum()
            step = np.where(np.abs(shift) > 0.6, np.sign(shift), 0).astype(int)
            new = np.clip(c + step, 0, np.array(a.shape) - 1)
            if (new == c).all():
                break
            c = new
        w = pad[tuple((c + r + off).T)]
        if w.sum() > 0:
            out.append([*(c + (off * w[:, None]).sum(0) / w.sum()), w.sum(), math.sqrt(((off**2).sum(1) * w).sum() / w.sum()), a[tuple(c)]])
    return np.array(out).reshape(-1, 6)


def locate_rounds(a: np.ndarray, radius: tuple, rounds: int = 3, **options) -> np.ndarray:
    """Locate, blank what was found, and locate again in what is left, until a round finds nothing; the last column is the round."""
    left, found = a.astype(float).copy(), []
    for n in range(rounds):
        new = locate(left, radius, **options)
        if not len(new):
            break
        found.append(np.hstack([new, np.full((len(new), 1), n)]))
        for c in np.rint(new[:, :3]).astype(int):
            at = c + ellipsoid(radius)
            at = at[((at >= 0) & (at < a.shape)).all(1)]
            left[tuple(at.T)] = 0
    return np.vstack(found) if found else np.zeros((0, 7))


def locations(blocks: DataFrame, radius: tuple, rounds: int = 3, **options) -> DataFrame:
    """Located particles of every tile: hv, z, y, x in the volume, mass, gyration, peak, round."""
    names = ["z", "y", "x", "mass", "gyration", "peak", "round"]

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                found = pd.DataFrame(locate_rounds(as_array(row), radius, rounds, **options), columns=names)
                for c in "zyx":
                    found[c] += row[f"{c}0"]
                found.insert(0, "hv", row["hv"])
                yield found

    return blocks.mapInPandas(run, "hv long, " + ", ".join(f"{n} double" for n in names))


def integrate_around(voxel: DataFrame, centres: DataFrame, radius: tuple) -> DataFrame:
    """Mean and sum of voxels in an ellipsoid about each rounded centre: an equality join on the offsets' places."""
    offsets = ", ".join(f"({a}, {b}, {c})" for a, b, c in ellipsoid(radius).tolist())
    spark = voxel.sparkSession
    places = centres.crossJoin(F.broadcast(spark.sql(f"select * from values {offsets} as t(oz, oy, ox)"))).select("id", *(F.expr(f"cast(rint({c}) as int) + o{c}").alias(c) for c in "zyx"))
    return places.join(voxel, ["z", "y", "x"]).groupBy("id").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.count("*").alias("n"))


def probability_mask(p: DataFrame, weights: dict[str, float], cutoff: float) -> DataFrame:
    """Null where the weighted class probabilities stay below a cutoff."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return p.withColumn("v", F.when(total >= cutoff, F.col("v")))


def smart_crop(profile: np.ndarray, low: int, high: int) -> int:
    """The slice of steepest change of a z profile between two limits, the nearer limit if it lies outside them."""
    return int(np.clip(np.abs(np.gradient(profile)).argmax(), low, high))


def filter_chain(blocks: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Named array filters in order, in one pass over the blocks: tv, mean, gaussian, bernstein (curvature), blur, threshold, band_pass, rescale."""
    named = {"blur": gaussian, "threshold": local_threshold, "band_pass": band_pass, "rescale": rescale_xy}

    def run(a: np.ndarray) -> np.ndarray:
        for name, more in steps:
            a = named[name](a, **more) if name in named else curvature_filter(a, name, **more)
        return a

    return map_blocks(blocks, run)
