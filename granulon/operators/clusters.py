"""Clusters of high strain, their shapes, averages about them, and correlations in space."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.functions.tensor import SYM, eigenvectors
from granulon.operators.lineage import checkpointed
from granulon.operators.spatial import linked_cells, near_any, radius_join

SIX = [f"e{k}" for k in SYM]


def components(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, root): the smallest id that each node reaches along (i, j) edges of its group; labels jump to their label's label each round."""
    both = edges.select(*by, "i", "j").unionAll(edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    labels = nodes.select(*by, "id", F.col("id").alias("root"))
    both = checkpointed(both)
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "j", "root": "r"}), [*by, "j"]).groupBy(*by, F.col("i").alias("id")).agg(F.min("r").alias("r"))
        step = labels.join(near, [*by, "id"], "left").select(*by, "id", F.least("root", "r").alias("new"), "root")
        # a root takes the smallest label that any of its members has found
        lift = step.groupBy(*by, F.col("root").alias("id")).agg(F.min("new").alias("low"))
        step = step.join(lift, [*by, "id"], "left").select(*by, "id", F.least("new", "low").alias("new"), "root")
        jump = step.select(*by, F.col("id").alias("new"), F.col("new").alias("new2"))
        after = checkpointed(step.join(jump, [*by, "new"], "left").select(*by, "id", F.least("new", "new2").alias("root"), (F.least("new", "new2") < F.col("root")).alias("moved")))
        labels = after.select(*by, "id", "root")
        if after.where("moved").isEmpty():
            return labels


def find_clusters(points: DataFrame, selected, r: float, by: list[str]) -> DataFrame:
    """(by..., id, cluster): numbered by descending size, ties to the smallest member; 0 where not selected."""
    high = points.where(selected)
    whose, links = linked_cells(high, r, by)
    whose = checkpointed(whose)
    cells = components(whose.select(*by, F.col("cell").alias("id")).distinct(), links, by)
    found = whose.join(cells.withColumnRenamed("id", "cell"), [*by, "cell"]).select(*by, "id", "root")
    sizes = found.groupBy(*by, "root").agg(F.count("*").alias("size"))
    ranks = sizes.withColumn("cluster", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("size"), "root")))
    members = found.join(ranks, [*by, "root"]).select(*by, "id", "cluster")
    return points.select(*by, "id").join(members, [*by, "id"], "left").select(*by, "id", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def cluster_table(points: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Size, centre and gyration tensor with its radius, for each cluster."""
    rows = points.join(members.where("cluster > 0"), [*by, "id"])
    return rows.groupBy(*by, "cluster").agg(F.count("*").alias("size"), *(F.avg(c).alias(f"com_{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"g{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))).withColumn("gyration", F.expr("sqrt(gxx + gyy + gzz)"))


def size_counts(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by, "size").agg(F.count("*").alias("n"))


def near_large(points: DataFrame, members: DataFrame, least: int, r: float, by: list[str]) -> DataFrame:
    """Points with a neighbour (or themselves) in a cluster of at least so many members."""
    sizes = members.where("cluster > 0").groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    big = members.join(sizes, [*by, "cluster"]).where(F.col("size") >= least).select(*by, "id", F.lit(True).alias("_big"))
    return near_any(points.join(big, [*by, "id"], "left").withColumn("_big", F.coalesce("_big", F.lit(False))), "_big", r, by)


def about_centres(points: DataFrame, centres: DataFrame, r: float, by: list[str]) -> DataFrame:
    """Points within r of each centre, in its frame: (by..., cluster, id, dx, dy, dz, d2); centres are (by..., cluster, x, y, z)."""
    return radius_join(centres, points, r, by, "cluster", "id").withColumnsRenamed({"i": "cluster", "j": "id"})


def cluster_axes(points: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """``axes`` (nine numbers, see ``eigenvectors``) of the mean strain of each cluster's members."""
    rows = points.join(members.where("cluster > 0"), [*by, "id"])
    return rows.groupBy(*by, "cluster").agg(*(F.avg(e).alias(e) for e in SIX)).withColumn("axes", eigenvectors(*map(F.col, SIX)))


def inclusion_average(points: DataFrame, members: DataFrame, r: float, by: list[str], least: int = 7, most: int = 17, edge: float = 7.5, mode: str = "average", subtract: bool = True, strains: DataFrame | None = None) -> DataFrame:
    """Mean strain about clusters of middling size, in axes of each cluster, by unit cell.

    ``points`` hold exx to ezz. With ``subtract`` the mean strain of the particles of no cluster within the same ball goes off first (nothing where there are none). The axes are those of the mean strain of the
    cluster's members (``average``), those of the cluster's own strain as ``cluster_strain`` gives it in ``strains``, less that mean (``cluster``), or none (``identity``).
    Positions turn by R' and strain by R' e R for R of column eigenvectors.
    """
    keys = [*by, "cluster"]
    table = cluster_table(points, members, by).where((F.col("size") > least) & (F.col("size") < most))
    centres = table.select(*keys, *(F.col(f"com_{c}").alias(c) for c in "xyz"))
    whose = points.select(*by, "id", *SIX).join(members.withColumnRenamed("cluster", "_own"), [*by, "id"])
    ball = about_centres(points, centres, r, by).join(whose, [*by, "id"])
    outside = ball.groupBy(*keys).agg(*(F.coalesce(F.avg(F.when(F.col("_own") == 0, F.col(e))), F.lit(0.0)).alias(f"m{e}") for e in SIX))
    if mode == "average":
        turned = cluster_axes(points, members, by)
    elif mode == "cluster":
        own = strains.join(outside, keys).select(*keys, *((F.expr(f"{e} - m{e}") if subtract else F.col(e)).alias(e) for e in SIX))
        turned = own.withColumn("axes", eigenvectors(*map(F.col, SIX)))
    elif mode == "identity":
        turned = centres.select(*keys, F.array(*(F.lit(float(i == j)) for i in range(3) for j in range(3))).alias("axes"))
    else:
        raise ValueError(f"no such mode: {mode}")
    ball = ball.join(outside, keys).join(turned.select(*keys, "axes").where("axes is not null"), keys)
    e = {k: F.expr(f"e{k} - me{k}") if subtract else F.col(f"e{k}") for k in SYM}
    u = [[F.get("axes", 3 * i + j) for j in range(3)] for i in range(3)]
    at = lambda i, j: e["".join(sorted("xyz"[i] + "xyz"[j]))]
    place = [F.floor(sum((u[i][j] * F.col(f"d{'xyz'[j]}") for j in range(3)), F.lit(0.0)) + edge).cast("int").alias(f"{'xyz'[i]}_bin") for i in range(3)]
    turn = [sum((u["xyz".index(k[0])][i] * u["xyz".index(k[1])][j] * at(i, j) for i in range(3) for j in range(3)), F.lit(0.0)).alias(f"e{k}") for k in SYM]
    return ball.select(*place, *turn).groupBy("x_bin", "y_bin", "z_bin").agg(*(F.avg(x).alias(x) for x in SIX), F.count("*").alias("n"))


def inclusion_field(grid: DataFrame, radius: float, strain: float, poisson: float = 1 / 3) -> DataFrame:
    """Shear strain (yz) of a sphere with the given transformation strain in an elastic matrix.

    Inside it is constant, 2 e (4 - 5 v) / (15 (1 - v)). Outside it depends on x, on the distance h from the x axis and on the angle about it
    through cos 4t = 8 u^4 - 8 u^2 + 1 with u = z / h (0 on the axis).
    """
    inside, c = 2 * strain * (4 - 5 * poisson) / (15 * (1 - poisson)), 1 / (4 * (4 - 5 * poisson))
    a2 = radius**2
    rows = grid.withColumns({"_h": F.expr("y * y + z * z"), "_x": F.expr("x * x")}).withColumn("_u", F.expr("if(_h = 0, 0D, z * z / _h)"))
    # by powers of x^2, with _h the square of h
    terms = [
        f"{9 * a2 * c}D * _h * _h - {2 + 3 * c}D * _h * _h * _h",
        f"{9 * c}D * _h * _x * (5 * _h - {8 * a2}D)",
        f"6 * _x * _x * (_h + {4 * c}D * ({a2}D + _h))",
        f"{4 * (1 - 6 * c)}D * _x * _x * _x",
        f"{15 * c}D * _h * _h * (5 * (_h + _x) - {7 * a2}D) * (8 * _u * _u - 8 * _u + 1)",
    ]
    outside = f"{radius**3 * inside / 4}D * ({' + '.join(terms)}) / power(_h + _x, 4.5D)"
    return rows.withColumn("r", F.sqrt(F.col("_h") + F.col("_x"))).withColumn("field", F.expr(f"if(r < {radius}D, {inside}D, {outside})")).drop("_h", "_x", "_u")


def spatial_correlation(a: DataFrame, b: DataFrame, shifts: DataFrame, value: str = "v") -> DataFrame:
    """Pearson correlation of two voxel fields (i, j, k, v) at each shift (si, sj, sk), over the overlap; shifts are a small listed table."""
    moved = a.crossJoin(F.broadcast(shifts)).select("si", "sj", "sk", F.col(value).alias("va"), *(F.expr(f"{c} + s{c}").alias(c) for c in "ijk"))
    return moved.join(b.select("i", "j", "k", F.col(value).alias("vb")), ["i", "j", "k"]).groupBy("si", "sj", "sk").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))


def density_estimate(rows: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """Gaussian kernel density on a grid with Scott's width n^(-1/5) sigma; one aggregate after the width is known."""
    w = rows.agg((F.stddev_samp(column) * F.pow(F.count(column).cast("double"), F.lit(-0.2))).alias("_w"))
    one = rows.select(F.col(column).alias("_x")).crossJoin(F.broadcast(w)).agg(*(F.avg(F.exp(-F.pow((F.lit(float(g)) - F.col("_x")) / F.col("_w"), F.lit(2)) / 2) / (F.col("_w") * math.sqrt(2 * math.pi))).alias(f"g{i}") for i, g in enumerate(grid)))
    return one.select(F.expr(f"stack({len(grid)}, " + ", ".join(f"cast({g} as double), g{i}" for i, g in enumerate(grid)) + ") as (at, density)"))


def pmf_moments(pmf: DataFrame, by: list[str], x: str = "x", p: str = "p") -> DataFrame:
    """norm, mean, std, skewness and kurtosis of weights p on places x."""
    m = pmf.groupBy(*by).agg(F.sum(p).alias("norm"), (F.sum(F.expr(f"{p} * {x}")) / F.sum(p)).alias("mean"))
    d = pmf.join(m, by).groupBy(*by, "norm", "mean").agg(*(F.sum(F.expr(f"{p} / norm * power({x} - mean, {k})")).alias(f"m{k}") for k in (2, 3, 4)))
    return d.select(*by, "norm", "mean", F.sqrt("m2").alias("std"), F.expr("try_divide(m3, power(m2, 1.5))").alias("skew"), F.expr("try_divide(m4, m2 * m2)").alias("kurt"))


def wiener_deconvolve(signal: np.ndarray, kernel: np.ndarray, snr: float) -> np.ndarray:
    """Regularised deconvolution of one short distribution: G = H* / (|H|^2 + 1 / snr)."""
    h = np.fft.fft(np.fft.ifftshift(kernel), len(signal))
    return np.real(np.fft.ifft(np.fft.fft(signal) * np.conj(h) / (np.abs(h) ** 2 + 1 / snr)))


def snap(rows: DataFrame, column: str, low: float, step: float) -> DataFrame:
    """To the nearest place of a grid; a tie goes up."""
    return rows.withColumn(column, low + F.floor((F.col(column) - low) / step + 0.5) * step)


def close_packed(spark, n: int, layers: str) -> DataFrame:
    """Points of stacked triangular layers A, B, C with unit spacing."""
    shift = {"A": (0.0, 0.0), "B": (0.5, math.sqrt(3) / 6), "C": (1.0, math.sqrt(3) / 3)}
    stack = ", ".join(f"({k}, {shift[s][0]}D, {shift[s][1]}D)" for k, s in enumerate(layers))
    h, up = math.sqrt(3) / 2, math.sqrt(2 / 3)
    return spark.sql(f"""select layer * {n * n} + j * {n} + i as id, i + 0.5 * j + sx as x, j * {h}D + sy as y, layer * {up}D as z
        from (select explode(sequence(0, {n - 1})) as i), (select explode(sequence(0, {n - 1})) as j), (values {stack}) as t(layer, sx, sy)""")
