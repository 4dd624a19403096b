"""Tables behind the reports: filtered strain, joint distributions, residuals, maps and scalar criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.operators import binning, quality


def filtered_strain(strain: DataFrame, columns: list[str], least: int = 4, k: float = 3.0) -> DataFrame:
    """Rows of over ``least`` neighbours inside the fence of each column in turn.

    The fences and the rows read one shuffle of the strain, which is worked out once: rows wait as lists, past which no condition or choice of columns goes.
    """
    whole = strain.where(F.col("nnb_count") > least).groupBy("particle").agg(F.collect_list(F.struct(*strain.columns)).alias("_rows"))
    return quality.tukey_filter(whole.where("size(_rows) > 0").select(F.inline("_rows")), columns, k)


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row of count, mean, std, min, quartiles and max for each column; the columns are stacked, so one pass serves all."""
    long = rows.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns) + ") as (name, value)"))
    return binning.describe(long, "value", ["name"])


def residual_table(rows: DataFrame, intervals: list[tuple[float, float]], height: str = "z_scaled") -> DataFrame:
    """Positions and xy residuals of tracers that have all of them, with the number of the listed interval of their scaled height."""
    kept = ["frame", "particle", "x", "y", "z", height, "dx_r", "dy_r"]
    found = rows.select(*kept).dropna(subset=kept[2:])
    return found.withColumn("z_bin", binning.listed(F.col(height), intervals))


def relative_residual(a: Column, b: Column) -> Column:
    """(a - b) / b; null where b is 0."""
    return F.try_divide(a - b, b)


def joint_measures(strain: DataFrame, x: str = "d2_min", y: str = "exz", most_x: float = 1.0, between_y: tuple[float, float] = (-0.02, 0.03)) -> DataFrame:
    """(ref, cur, particle, x, y) where both of two measures are inside their limits."""
    return strain.where((F.col(x) < most_x) & (F.col(y) > between_y[0]) & (F.col(y) < between_y[1])).select("ref", "cur", "particle", x, y)


def flagged_positions(tracks: DataFrame, strain: DataFrame, cut: float, measure: str = "d2_min") -> DataFrame:
    """Positions of the particles whose measure at the current frame is over the cut, by that frame: what an XYZ file of each frame holds."""
    high = strain.where(F.col(measure) > cut).select(F.col("cur").alias("frame"), "particle").distinct()
    return tracks.join(high, ["frame", "particle"], "left_semi").select("frame", "particle", "x", "y", "z")


def interface_map(strain: DataFrame, positions: DataFrame, value: str = "eyz", height: float = 15.0, least: int = 9, cells: int = 40) -> DataFrame:
    """Mean of a strain component in percent by pair and cell of x and y, over particles near the interface with enough neighbours in every pair.

    ``positions`` has particle, x, y and dist of the reference frame.
    """
    near = positions.where(F.col("dist") < height).select("particle", "x", "y")
    poor = F.coalesce(F.col("nnb_count") < least, F.lit(True))
    whole = strain.groupBy("particle").agg(F.max(poor).alias("_poor"), F.collect_list(F.struct("ref", "cur", F.col(value).alias("_v"))).alias("_rows"))
    # the second condition is true, but it makes the ranges and the rows need the same columns, so that the strain is worked out and shuffled once
    chosen = near.join(whole.where("not _poor and size(_rows) > 0"), "particle")
    binned = binning.equal_width(binning.equal_width(chosen, "x", cells).withColumnRenamed("bin", "x_bin").drop("bin_mid"), "y", cells).withColumnRenamed("bin", "y_bin").drop("bin_mid")
    rows = binned.select("x_bin", "y_bin", F.inline("_rows"))
    return rows.groupBy("ref", "cur", "x_bin", "y_bin").agg((100 * F.avg("_v")).alias("percent"), F.count("_v").alias("n"))


def gridded(rows: DataFrame, value: str, shape: dict[str, int], low: float, high: float) -> DataFrame:
    """Mean by cell of a grid of equal intervals over the data's range, and ``level``: low to high recast to 0 to 255, clipped."""
    for c, n in shape.items():
        rows = binning.equal_width(rows, c, n).withColumnRenamed("bin", f"{c}_bin").drop("bin_mid")
    found = rows.groupBy(*(f"{c}_bin" for c in shape)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return found.withColumn("level", F.bround(255 * (F.least(F.greatest(F.col("mean"), F.lit(low)), F.lit(high)) - low) / (high - low)).cast("int"))


def rolling_mean(rows: DataFrame, value: str, width: int, by: str = "particle", order: str = "frame") -> DataFrame:
    """Mean of the last ``width`` rows of each group in order; null until there are so many."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(1 - width, 0)
    return rows.withColumn(f"{value}_rolling", F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def distance_moved(tracks: DataFrame, ref: int, cur: int) -> DataFrame:
    """Euclidean displacement between two frames, and over the reference height."""
    side = lambda k, s: tracks.where(F.col("frame") == k).select("particle", *(F.col(c).alias(f"{c}{s}") for c in "xyz"))
    rows = side(ref, 0).join(side(cur, 1), "particle")
    rows = rows.select("particle", "z0", F.sqrt(F.expr(" + ".join(f"({c}1 - {c}0) * ({c}1 - {c}0)" for c in "xyz"))).alias("disp"))
    return rows.select("particle", "disp", F.try_divide("disp", "z0").alias("ratio"))


def yield_criterion(rows: DataFrame, stress: str = "stress", modulus: str = "modulus", energy: float = 0.97) -> DataFrame:
    """Von Mises yield quantities: strain, second invariant, distortion energy, and thermal energy over it."""
    half = F.col(stress) / F.sqrt(F.lit(3.0))
    found = rows.withColumns({"e_vm": F.sqrt(F.try_divide(half, F.col(modulus))), "j2": half * half, "wd": F.try_divide(half * half, 2 * F.col(modulus))})
    return found.withColumn("thermal_ratio", F.try_divide(F.lit(energy), F.col("wd")))


def tensor_matrix(*six: Column) -> Column:
    """Rows of the symmetric matrix of xx, yy, zz, xy, xz, yz."""
    xx, yy, zz, xy, xz, yz = six
    return F.array(F.array(xx, xy, xz), F.array(xy, yy, yz), F.array(xz, yz, zz))


def tensor_flat(m: Column) -> Column:
    """xx, yy, zz, xy, xz, yz of a matrix's rows."""
    return F.array(*(F.get(F.get(m, i), j) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))))


def property_columns(rows: DataFrame, name: str, width: int) -> DataFrame:
    """An array column of 1, 3, 4 or 6 components as columns named by its shape: scalar, vector, quaternion or symmetric tensor."""
    #: Suffixes by number of components.
    suffixes = {1: [""], 3: [".x", ".y", ".z"], 4: [".x", ".y", ".z", ".w"], 6: [".xx", ".yy", ".zz", ".xy", ".xz", ".yz"]}
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), *(F.get(F.col(name), k).alias(name + s) for k, s in enumerate(suffixes[width])))


def projection(voxel: DataFrame, by: list[str]) -> DataFrame:
    """Mean along z by place (by = y, x), or over each slice (by = z)."""
    return voxel.groupBy(*by).agg(F.avg("v").alias("mean"))


def flat_field(slices: DataFrame, by: list[str]) -> DataFrame:
    """(raw - dark) times the mean of (flat - dark) over (flat - dark), by slice; null where flat equals dark."""
    mean = slices.groupBy(*by).agg(F.avg(F.col("flat") - F.col("dark")).alias("_m"))
    return slices.join(mean, by).withColumn("v", F.try_divide((F.col("raw") - F.col("dark")) * F.col("_m"), F.col("flat") - F.col("dark"))).drop("_m")


def sub_grid(voxel: DataFrame, size: dict[str, int], samples: dict[str, int]) -> DataFrame:
    """Voxels on a regular grid of every (size // samples)th place along each axis."""
    for c, n in size.items():
        voxel = voxel.where(F.col(c) % max(1, n // samples[c]) == 0)
    return voxel
